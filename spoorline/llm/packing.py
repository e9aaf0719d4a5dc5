"""Best-fit packing, certified by lower bounds.

Texts become token ids plus an end id. A document longer than a sequence is cut into full
pieces, all but the first, which takes what is left over; a full piece is a sequence by itself.
The other pieces are dealt to partitions of bounded size and packed best-fit decreasing. For
each partition, dual feasible functions give a lower bound of its bins. A partition that
meets its bound is certified: its bins stay. Partitions with a gap take the bins that are
not full apart and exchange those documents, as do the one worst-filled bin of each certified
partition; what was exchanged is dealt anew and packed again, until one partition is left or
no round gains a bin.

Null text counts as empty (the end id alone). An empty table gives an empty result. Documents
with equal ids are separate documents; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import map_rows
from spoorline.session import materialize

#: Pieces that one task packs at a time.
PART_ROWS = 65_536
#: Rounds of exchange at most; each packs only what the one before could not certify.
ROUNDS = 5

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
NAMES = [column.split()[0] for column in PIECES.split(", ")]


def tiktoken_ids(path: str, pattern: str, special: dict[str, int] | None = None) -> Callable:
    """A factory of encoders by a rank file; tokens of ``special`` have their ids wherever they stand.

    Without ``special``, texts that look like special tokens are ordinary.
    """

    def make():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        encoding = tiktoken.Encoding(
            "packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {}
        )
        if not special:
            return lambda texts: [encoding.encode_ordinary(t) for t in texts]
        return lambda texts: [encoding.encode(t, allowed_special="all") for t in texts]

    return make


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, which cut a text before anything else does."""
    with open(path, "rb") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: only added tokens that match as they are can be split at")
    contents = [t["content"] for t in tokens]
    if any(a != b and a in b for a in contents for b in contents):
        raise ValueError(f"{path}: an added token lies within another")
    return {t["content"]: t["id"] for t in tokens}


def tokenizer_ids(path: str, ranks_path: str, pattern: str) -> Callable:
    """A factory of encoders to the ids of a tokenizer file at its defaults, added tokens included.

    ``ranks_path`` is its vocabulary in the form that the faster library reads.
    """
    return tiktoken_ids(ranks_path, pattern, added_tokens(path))


def cut_pieces(
    docs: DataFrame, encoder: Callable, size: int, end_id: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, crc32 of its ids."""

    def make():
        encode = encoder()

        def work(rows):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for (id_, _), ids in zip(rows, encode([t or "" for _, t in rows]), strict=True):
                raw = np.asarray([*ids, end_id], dtype="<u4").tobytes()
                n = len(raw) // 4
                first = n % size or size
                bounds = [0, *range(first, n + 1, size)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out["doc_id"].append(id_)
                    out["piece"].append(piece)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * a : 4 * b]))
            return out

        return work

    return map_rows(docs, make, PIECES, [key, text], rows=64)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that pieces need at least; ``counts`` by length, 0 to ``size``.

    The largest over dual feasible functions: the identity, and for each threshold t the
    function that takes lengths over size - t as 1, drops those under t, and keeps the rest.
    """
    lengths = np.arange(size + 1)
    total, number = np.cumsum(counts * lengths), np.cumsum(counts)
    best = -(-int(total[-1]) // size)
    t = np.arange(1, size // 2 + 1)
    big = number[-1] - number[size - t]
    middle = total[size - t] - total[t - 1]
    best = max(best, int((big + -(-middle // size)).max(initial=0)))
    for k in range(2, 11):  # u(k): multiples of 1/(k+1) as they are, others rounded down to 1/k
        scaled = lengths * (k + 1)
        value = np.where(scaled % size == 0, lengths * k, scaled // size * size)
        best = max(best, -(-int((counts * value).sum()) // (size * k)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, best-fit decreasing; ties in the order given."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, made = 0, 0  # bit r of rooms: a bin with room r is open
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            here = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, here, made = size, made, made + 1
        bins[i], offsets[i] = here, size - room
        if room > need:
            open_by_room[room - need].append(here)
            rooms |= 1 << (room - need)
    return bins, offsets


def pack_part(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Bins, offsets, which pieces may be exchanged, bins used, their lower bound."""
    bins, offsets = best_fit(lengths, size)
    used = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, weights=lengths, minlength=used)
    bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
    loose = fill < size
    if used == bound and used:
        loose &= np.arange(used) == fill.argmin()
    return bins, offsets, loose[bins], used, bound


ROUND_SCHEMA = PIECES + ", row bigint, part bigint, bin bigint, offset bigint, loose boolean, used bigint, bound bigint"


def pack_round(pieces: DataFrame, parts: int, size: int, number: int) -> DataFrame:
    """Pack every partition of this round's deal."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        bins, offsets, loose, used, bound = pack_part(pdf["length"].to_numpy(), size)
        return pdf.assign(bin=bins, offset=offsets, loose=loose, used=used, bound=bound)

    dealt = pieces.withColumn(
        "part", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts))
    )
    return dealt.groupBy("part").applyInPandas(pack, ROUND_SCHEMA)


def pack(
    docs: DataFrame,
    encoder: Callable,
    size: int = 1024,
    end_id: int = 2,
    part_rows: int = PART_ROWS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Pieces with sequence_id and offset: no sequence over ``size`` tokens, offsets gapless."""
    cut = cut_pieces(docs, encoder, size, end_id)
    pieces = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    out = pieces.where(F.col("length") == size).select(
        *NAMES, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    left, before = pieces.where(F.col("length") < size), None
    count, opened = left.count(), 0
    for number in range(rounds):
        if not count:
            break
        parts = -(-count // part_rows)
        packed = materialize(pack_round(left, parts, size, number), "packed").withColumn(
            "sequence_id", F.lit(number << 58) + F.shiftleft("part", 24) + F.col("bin")
        )
        found = packed.groupBy("part").agg(
            F.max("used").alias("used"),
            F.countDistinct(F.when(F.col("loose"), F.col("bin"))).alias("open"),
        )
        used, now_open = found.agg(F.sum("used"), F.sum("open")).first()
        if before is not None and used > opened:  # the exchange lost bins: the former ones stay
            return out.unionByName(before.select(*NAMES, "sequence_id", "offset"))
        stuck = before is not None and used == opened
        last = parts == 1 or stuck or number + 1 == rounds or now_open < 2
        kept = packed if last else packed.where(~F.col("loose"))
        out = out.unionByName(kept.select(*NAMES, "sequence_id", "offset"))
        if last:
            break
        before = packed.where("loose")
        left, opened = before.select(*NAMES, "row"), now_open
        count = left.count()
    return out
