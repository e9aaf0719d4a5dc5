"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a word is the sum, over all ways to cut it into pieces, of the product of their
probabilities; a forward pass over the characters computes the sum without listing them. A text's
score is the product over its words. Training is expectation maximisation of the same model:
a forward and a backward pass give the expected count of each piece in each distinct word,
weighted by the word's count in a language.

Words are cut at white space, led by the vocabulary's word mark. Words longer than ``MAX_WORD``
characters are scored in blocks of that length, so that every character counts. Characters
outside the vocabulary have a small fixed probability. The score of a prediction is its share
among the languages, equal priors. Null texts and texts without a letter are ``und`` with
score 0, as is everything if there is nothing to learn from. Ties go to the language first in
alphabetical order.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import map_rows
from spoorline.session import materialize

MARK = "▁"
MAX_WORD = 24
#: Longer pieces of the vocabulary are left out; they hold runs of white space and the like.
MAX_PIECE = 16
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
#: Added to the expected count of every piece.
SMOOTH = 0.1
#: Words whose scores a task keeps; the table is emptied beyond that.
KEEP_WORDS = 500_000
UNDETERMINED = "und"
#: In place of a piece id: a piece begins like this; none does; no entry of the table.
BEGUN, NO_PIECE, EMPTY = -1, -2, -3
#: Words of one length that are computed together.
GROUP = 16_384

words_of = re.compile(r"\S+").findall


def pieces_of_model(path: str) -> list[str]:
    """The text pieces of a sentencepiece model, in their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        and len(model.id_to_piece(i)) <= MAX_PIECE
    ]


class PieceTable:
    """Ids of pieces by a 64-bit hash of their characters, for many strings at once."""

    FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, ids: dict[str, int]):
        bits = max(4, (4 * len(ids) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.ids = np.full(1 << bits, EMPTY, np.int64)
        hashes = np.array([self.hash_of(piece) for piece in ids], np.uint64)
        values = np.fromiter(ids.values(), np.int64, len(ids))
        slots, left = self._slot(hashes), np.arange(len(ids))
        while len(left):  # the first to come takes a free slot, the others go on to the next
            _, first = np.unique(slots[left], return_index=True)
            first = left[first]
            first = first[self.ids[slots[first]] == EMPTY]
            self.keys[slots[first]], self.ids[slots[first]] = hashes[first], values[first]
            left = np.setdiff1d(left, first, assume_unique=True)
            slots[left] = (slots[left] + 1) % len(self.ids)

    @classmethod
    def hash_of(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(cls.FACTOR) + ord(c) + 1) % (1 << 64)
        return h

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * self.SPREAD) >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each hash, NO_PIECE where there is none."""
        slots = self._slot(hashes)
        out = self.ids[slots]
        other = np.flatnonzero((out != EMPTY) & (self.keys[slots] != hashes))
        while len(other):
            slots[other] = (slots[other] + 1) % len(self.ids)
            out[other] = self.ids[slots[other]]
            other = other[(out[other] != EMPTY) & (self.keys[slots[other]] != hashes[other])]
        out[out == EMPTY] = NO_PIECE
        return out


class Lattice:
    """All piece edges of many words of one length, and sums over their segmentations.

    An edge holds the words that have it and their pieces. From each start, words drop out as
    soon as no piece begins with what they have there.
    """

    def __init__(self, words: list[str], table: PieceTable, unknown: int):
        self.n, self.length = len(words), len(words[0])
        self.edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        codes = np.array(words, dtype=f"<U{self.length}").view(np.uint32)
        codes = np.ascontiguousarray(codes.reshape(self.n, self.length).T).astype(np.uint64) + np.uint64(1)
        everywhere = np.arange(self.n)
        for start in range(self.length):
            at, hashes = everywhere, np.zeros(self.n, np.uint64)
            for end in range(start + 1, min(self.length, start + MAX_PIECE) + 1):
                hashes = hashes * table.FACTOR + codes[end - 1][at]
                pieces = table.find(hashes)
                going_on = pieces != NO_PIECE
                if end == start + 1:
                    pieces[pieces < 0] = unknown
                hit = pieces >= 0
                if hit.any():
                    self.edges.append((start, end, at[hit], pieces[hit]))
                if not going_on.all():
                    at, hashes = at[going_on], hashes[going_on]
                    if not len(at):
                        break

    def forward(self, probs: np.ndarray) -> np.ndarray:
        sums = np.zeros((self.length + 1, self.n, probs.shape[1]))
        sums[0] = 1.0
        for start, end, words, pieces in self.edges:  # by start, so that sums[start] is whole
            sums[end][words] += sums[start][words] * probs[pieces]
        return sums

    def expected(self, probs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts by language for words that occur ``counts`` times in each."""
        ahead = self.forward(probs)
        behind = np.zeros_like(ahead)
        behind[self.length] = counts / ahead[self.length]
        out = np.zeros_like(probs)
        for start, end, words, pieces in reversed(self.edges):
            onward = behind[end][words] * probs[pieces]
            behind[start][words] += onward
            share = ahead[start][words] * onward
            np.add.at(out, pieces, share)
        return out


class PieceModel:
    """Piece probabilities by language: a row per piece, then one for unknown characters."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.pieces = pieces
        begun = {p[:k] for p in pieces for k in range(1, len(p))}
        self.table = PieceTable(dict.fromkeys(begun, BEGUN) | {p: i for i, p in enumerate(pieces)})
        self.unknown = len(pieces)
        self.probs = probs

    @staticmethod
    def from_counts(pieces: list[str], counts: np.ndarray) -> PieceModel:
        """``counts``: expected count by piece and language."""
        smoothed = counts + SMOOTH
        probs = smoothed / smoothed.sum(axis=0)
        k = counts.shape[1]
        return PieceModel(pieces, np.vstack([probs, np.full((1, k), UNKNOWN)]))

    def by_length(self, words: list[str]):
        groups: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w)].append(i)
        for at in groups.values():
            for j in range(0, len(at), GROUP):
                part = at[j : j + GROUP]
                yield part, Lattice([words[i] for i in part], self.table, self.unknown)

    def log_probs(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.probs.shape[1]))
        for part, lattice in self.by_length(words):
            out[part] = np.log(lattice.forward(self.probs)[lattice.length])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        out = np.zeros_like(self.probs)
        for part, lattice in self.by_length(words):
            out += lattice.expected(self.probs, counts[part])
        return out[: self.unknown]


def blocks_of(word: str) -> list[str]:
    """The word with its mark, in blocks of at most ``MAX_WORD`` characters."""
    whole = MARK + word
    return [whole[i : i + MAX_WORD] for i in range(0, len(whole), MAX_WORD)]


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """How often each word occurs in the texts of each language: lang, word, n."""

    def make():
        def work(rows):
            counts: dict[str, Counter] = defaultdict(Counter)
            for name, body in rows:
                counts[name].update(words_of(body or ""))
            flat = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
            return {
                "lang": [f[0] for f in flat],
                "word": [f[1] for f in flat],
                "n": [f[2] for f in flat],
            }

        return work

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    per_slice = map_rows(known, make, "lang string, word string, n bigint", [lang, text], rows=8192)
    return per_slice.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, pieces: list[str], rounds: int = 2) -> tuple[list[str], PieceModel] | None:
    """Languages in order and their piece model; None without labelled text.

    Word counts cover every labelled text. Each round sends the driver one row per piece and
    language, which the vocabulary bounds.
    """
    counts = materialize(word_counts(docs), "words")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    at = {name: i for i, name in enumerate(langs)}
    spark = docs.sparkSession
    model = PieceModel.from_counts(pieces, np.zeros((len(pieces), len(langs))))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, model.probs))

        def expect(batches, shared=shared):
            names, probs = shared.value
            # one language at a time: the others have no counts in its words
            singles = {}
            total = np.zeros((len(names), len(at)))
            for pdf in batches:
                for name, part in pdf.groupby("lang"):
                    k = at[name]
                    if k not in singles:
                        singles[k] = PieceModel(names, probs[:, [k]])
                    blocks, counts = [], []
                    for w, n in zip(part["word"], part["n"], strict=True):
                        for b in blocks_of(w):
                            blocks.append(b)
                            counts.append(n)
                    found = singles[k].expected(blocks, np.array(counts, float)[:, None])
                    total[:, k] += found[:, 0]
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        sums = (
            counts.mapInPandas(expect, "piece bigint, lang bigint, n double")
            .groupBy("piece", "lang")
            .agg(F.sum("n").alias("n"))
            .toPandas()
        )
        expected = np.zeros((len(pieces), len(langs)))
        expected[sums["piece"].to_numpy(int), sums["lang"].to_numpy(int)] = sums["n"]
        model = PieceModel.from_counts(pieces, expected)
        shared.unpersist()
    return langs, model


def predict(
    docs: DataFrame,
    trained: tuple[list[str], PieceModel] | None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """lang_pred and score of every text, by its key."""
    langs, model = trained or ([], None)
    shared = docs.sparkSession.sparkContext.broadcast(
        model and (model.pieces, model.probs)
    )

    def make():
        inner = shared.value and PieceModel(*shared.value)
        rows_of: dict[str, int] = {}
        table = np.zeros((0, len(langs)))

        def work(rows):
            nonlocal rows_of, table
            texts = [t or "" for _, t in rows]
            lettered = [any(map(str.isalpha, t)) for t in texts]
            out = {key: [k for k, _ in rows], "lang_pred": [], "score": []}
            if len(rows_of) > KEEP_WORDS:
                rows_of, table = {}, table[:0]
            words = [words_of(t) for t in texts] if inner else []
            fresh = list(set().union(*words).difference(rows_of)) if inner else []
            if fresh:
                blocks, owner = [], []
                for i, w in enumerate(fresh):
                    for b in blocks_of(w):
                        blocks.append(b)
                        owner.append(i)
                logs = np.zeros((len(fresh), len(langs)))
                np.add.at(logs, owner, inner.log_probs(blocks))
                base = len(table)
                rows_of.update((w, base + i) for i, w in enumerate(fresh))
                table = np.vstack([table, logs])
            for i, has in enumerate(lettered):
                if not has or not inner:
                    out["lang_pred"].append(UNDETERMINED)
                    out["score"].append(0.0)
                    continue
                at = np.fromiter(map(rows_of.__getitem__, words[i]), np.int64, len(words[i]))
                sums = table[at].sum(axis=0)
                shares = np.exp(sums - sums.max())
                best = int(np.argmax(sums))
                out["lang_pred"].append(langs[best])
                out["score"].append(float(shares[best] / shares.sum()))
            return out

        return work

    schema = f"{key} bigint, lang_pred string, score double"
    return map_rows(docs, make, schema, [key, text], rows=8192)


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
