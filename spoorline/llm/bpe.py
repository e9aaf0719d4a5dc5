"""Byte-level BPE by merge replay over all words of a block of texts.

Texts are cut by the vocabulary's pattern. The distinct words of a block, not the texts, are
merged: an inverted index holds, for each merge rank, the positions of the token pairs that
make it. Ranks are taken in rising order over the whole block; each merge touches only its
two neighbours, whose new pairs go back into the index. Words keep their ids for the next blocks
of the same task, in a table of bounded size. A word's ids do not depend on the block it is
in, so blocks and executors may be dealt in any way.

Null texts count as empty and have no ids. The vocabulary file is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import defaultdict
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame

from spoorline.llm.common import map_rows

#: Words whose ids a task keeps; the table is emptied beyond that.
KEEP_WORDS = 600_000


class Vocabulary:
    """Token bytes and ranks of a rank file, and the rank that a pair of tokens merges to."""

    KEEP_PAIRS = 1_000_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.first = [self.ranks[bytes([b])] for b in range(256)]
        self.merged = _Merged(self)


class _Merged(dict):
    """Rank that tokens ``left`` and ``right`` make, by ``left << 32 | right``; -1: none."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def __missing__(self, pair: int) -> int:
        if len(self) > Vocabulary.KEEP_PAIRS:
            self.clear()
        token = self.vocab.bytes_of[pair >> 32] + self.vocab.bytes_of[pair & 0xFFFFFFFF]
        rank = self[pair] = self.vocab.ranks.get(token, -1)
        return rank


def replay(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Ids of each word, all words merged together in the order of ranks.

    The words lie in one row of tokens with a mark (-1) behind each, so that neighbours never
    cross words. A word that is a token by itself needs no merge.
    """
    merged, first, ranks = vocab.merged, vocab.first, vocab.ranks
    out: list[list[int]] = [[ranks[w]] if w in ranks else [] for w in words]
    todo = [i for i, ids in enumerate(out) if not ids]
    tokens: list[int] = []
    for i in todo:
        tokens += [first[b] for b in words[i]]
        tokens.append(-1)
    n = len(tokens)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))  # -1 reads the last mark
    makes = [
        merged[left << 32 | right] if left >= 0 <= right else -1
        for left, right in zip(tokens, tokens[1:], strict=False)
    ]
    makes.append(-1)
    index: dict[int, list[int]] = defaultdict(list)
    for at, rank in enumerate(makes):
        if rank >= 0:
            index[rank].append(at)
    queue = list(index)
    heapify(queue)
    while queue:
        rank = heappop(queue)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        for k, at in enumerate(places):
            if makes[at] != rank:
                continue
            gone = after[at]
            to = after[gone]
            prior = before[at]
            tokens[at] = rank
            tokens[gone] = makes[gone] = -2
            after[at] = to
            before[to] = at
            right, left = tokens[to], tokens[prior]
            new = makes[at] = merged[rank << 32 | right] if right >= 0 else -1
            lower = False
            if new >= 0:
                if new not in index:
                    heappush(queue, new)
                index[new].append(at)
                lower = new < rank
            if left >= 0:
                new = makes[prior] = merged[left << 32 | rank]
                if new >= 0:
                    if new not in index:
                        heappush(queue, new)
                    index[new].append(prior)
                    lower |= new < rank
            if lower:  # a lower rank came up: it goes first, the rest of this one waits
                index[rank].extend(places[k + 1 :])
                heappush(queue, rank)
                break
    at = 0
    for i in todo:
        stop = at + len(words[i])
        out[i] = [t for t in tokens[at:stop] if t >= 0]
        at = stop + 1
    return out


class Encoder:
    """Encodes blocks of texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        self.vocab = Vocabulary(path)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEEP_WORDS:
            self.known = {}
        known, cut = self.known, self.cut
        words = [cut(t) for t in texts]
        fresh = list(set().union(*words).difference(known)) if words else []
        ids = replay([w.encode() for w in fresh], self.vocab)
        known.update(zip(fresh, (array("I", i).tobytes() for i in ids), strict=True))
        return [b"".join(map(known.__getitem__, w)) for w in words]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.bytes_of.__getitem__, array("I", ids)))


def encode(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Key, ids (binary, unsigned 32-bit little-endian) and decoded bytes of every text."""

    def make():
        encoder = Encoder(path, pattern)

        def work(rows):
            ids = encoder.encode([t or "" for _, t in rows])
            return {key: [k for k, _ in rows], "ids": ids, "decoded": list(map(encoder.decode, ids))}

        return work

    return map_rows(docs, make, f"{key} bigint, ids binary, decoded binary", [key, text])


def encode_digests(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """As `encode`, with counts and digests made in the same task so that ids stay there."""

    def make():
        encoder = Encoder(path, pattern)

        def work(rows):
            ids = encoder.encode([t or "" for _, t in rows])
            return {
                key: [k for k, _ in rows],
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids],
            }

        return work

    schema = f"{key} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs, make, schema, [key, text])
