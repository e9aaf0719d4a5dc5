"""Grouping of spelling variants: words one edit apart, by products of letter counts.

Two words one insertion, deletion or replacement apart have letter counts at a squared distance
of 1 or 2, and their lengths differ by one at most. So the words of a block are a matrix of
letter counts, its product with itself gives all squared distances, and only pairs at two or
less are compared letter by letter. A block holds the words of two adjacent lengths that share
half of the shorter word, its beginning or its end: one edit leaves one of the halves as it is, so
no pair is lost and words that share nothing are never multiplied. Blocks over ``TILE`` words are
cut into tiles, and every pair of tiles is a task's work of its own. A pair found through both
halves counts once, through the beginning.

Cases: a null text has no words; a null doc_id counts as empty text in the hash. Repeated rows
count as often as they are there. Texts are read whole; words of any length are compared
(longer ones in smaller tiles). Of near words with equal counts the smallest in code-point order
is the form. An empty table gives no row. Only doc_id and text are read, so other columns do
not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import number_rows
from spoorline.llm.common import SLICE, slices
from spoorline.session import materialize

MIN_LENGTH = 5
MIN_COUNT = 3
#: Runs whose hash is divisible by this lose a letter.
DAMAGE = 97
#: The form has at least this many times the word's count.
TIMES = 2
#: Words a task counts before it hands them on.
KEEP, KEEP_BYTES = 400_000, 64 << 20
#: Letters of a long text that are split at a time.
PART = 4 << 20
#: Words of a block multiplied at once, and letters of a tile's padded texts.
TILE, TILE_LETTERS = 1024, 1 << 22
#: Words of small blocks that share one product.
JOINT = 256
#: Candidate pairs compared letter by letter at a time, times the longer length.
COMPARE = 1 << 23
#: Longer words are counted in double precision, as single precision holds integers up to 2**24.
SINGLE = 4000

_LETTERS = [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]
#: Latin-1 bytes: A-Z to lower case, everything but letters to a space.
_FOLD = bytes((c + 32 if c < 97 else c) if c in _LETTERS else 32 for c in range(256))
_COLUMN = np.zeros(256, np.int64)
_COLUMN[_LETTERS[26:]] = np.arange(len(_LETTERS) - 26)
N_LETTERS = len(_LETTERS) - 26


def runs_of(text: str) -> Iterator[list[bytes]]:
    """Lower-cased runs as Latin-1 bytes, of a long text in parts; a character outside Latin-1 ends a run."""
    letters = text.encode("latin-1", "replace").translate(_FOLD)
    start = 0
    while len(letters) - start > PART:
        end = letters.find(b" ", start + PART)
        if end < 0:
            break
        yield letters[start:end].split()
        start = end
    yield letters[start:].split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        wide: dict[bytes, bytes] = {}
        held = 0

        def flush():
            words = [w.decode("latin-1") for w in total]
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())],
                names=["word", "n"],
            )
            total.clear()
            wide.clear()
            return out

        for batch in batches:
            for part in slices(batch, SLICE):
                ids, texts = (part.column(c).to_pylist() for c in ("doc_id", "text"))
                for doc_id, text in zip(ids, texts, strict=True):
                    if not text:
                        continue
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    found: Counter[bytes] = Counter()
                    for runs in runs_of(text):
                        found.update([r for r in runs if len(r) >= MIN_LENGTH])
                    for run, n in found.items():
                        if run.isascii():
                            h = zlib.crc32(run, seed)
                        else:
                            utf8 = wide.get(run) or wide.setdefault(run, run.decode("latin-1").encode())
                            h = zlib.crc32(utf8, seed)
                        if h % DAMAGE == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < MIN_LENGTH:
                                continue
                        total[run] += n
                        held += len(run)
                    if len(total) > KEEP or held > KEEP_BYTES:
                        yield flush()
                        held = 0
        yield flush()

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(
        task, "word string, n long"
    )
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def blocks(words: DataFrame) -> DataFrame:
    """The places of every word: (block, tail, word, n), two adjacent lengths a block.

    ``block`` names the shorter length, the half and whether it is the end (``tail``).
    """
    length = F.length("word")
    places = []
    for shorter in (length, length - 1):
        half = F.floor(shorter / 2).cast("int")
        for tail in (False, True):
            text = F.right("word", half) if tail else F.left("word", half)
            places.append(
                F.struct(
                    shorter.cast("int").alias("shorter"), F.lit(tail).alias("tail"), text.alias("half")
                )
            )
    return words.select("word", "n", F.explode(F.array(*places)).alias("b")).select("b.*", "word", "n")


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words, left and length; the rest of a row is zero."""
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max())
    letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
    return letters.reshape(len(words), width), lengths


def _counts(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    kind = np.float32 if lengths.max() <= SINGLE else np.float64
    rows = np.repeat(np.arange(len(lengths)), lengths) * N_LETTERS
    held = np.arange(letters.shape[1]) < lengths[:, None]
    flat = np.bincount(rows + _COLUMN[letters[held]], minlength=len(lengths) * N_LETTERS)
    return flat.reshape(len(lengths), N_LETTERS).astype(kind)


def one_edit(a, a_len, b, b_len) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``b`` (as long as ``a``'s or one longer) are one edit away; equal first letters."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    at = np.arange(width)
    inside = at < a_len[:, None]
    same = (a == b) & inside
    lead = np.where(same.all(1), width, np.argmin(same, 1))
    lead = np.minimum(lead, a_len)
    swapped = (b_len == a_len) & ((inside & ~same).sum(1) == 1)
    # after the first difference the longer one goes on a letter later
    late = (a[:, : width - 1] != b[:, 1:]) & inside[:, : width - 1] & (at[: width - 1] >= lead[:, None])
    grown = (b_len == a_len + 1) & ~late.any(1)
    return swapped | grown, lead


class _Near:
    """Near words of one tile's words: how many, and the best of them so far."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.best = np.full(n, -1)

    def add(self, i: np.ndarray, j: np.ndarray, ns: np.ndarray, order: np.ndarray) -> None:
        """``j`` are near ``i``; ``order`` ranks words by falling count, then code points."""
        np.add.at(self.count, i, 1)
        rank = np.full(len(self.best), len(order))
        known = self.best >= 0
        rank[known] = order[self.best[known]]
        np.minimum.at(rank, i, order[j])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        hit = rank < len(order)
        self.best[hit] = back[rank[hit]]


def near_in_tile(
    words: list[bytes], ns: np.ndarray, shorter: np.ndarray, tail: np.ndarray, group: np.ndarray, split: int
) -> _Near:
    """Near words among rows of equal ``group``; only from before to behind ``split`` if it is not 0."""
    n = len(words)
    letters, lengths = _padded(words)
    x = _counts(letters, lengths)
    norm = (x * x).sum(1)
    order = np.empty(n, np.int64)
    order[sorted(range(n), key=lambda i: (-ns[i], words[i]))] = np.arange(n)
    near = _Near(n)
    rows, columns = (slice(0, split), slice(split, n)) if split else (slice(0, n), slice(0, n))
    distance = norm[rows, None] + norm[None, columns] - 2 * (x[rows] @ x[columns].T)
    close = (distance <= 2) & (group[rows, None] == group[None, columns])
    # the pair stands from its shorter word, equal ones once; two of the longer length have a block of their own
    first, second = lengths[rows, None], lengths[None, columns]
    short = shorter[rows, None]
    if split:
        close &= (np.minimum(first, second) == short) & (np.abs(first - second) <= 1)
    else:
        close &= (first == short) & ((second == short + 1) | ((second == first) & (np.arange(n)[:, None] < np.arange(n))))
    i, j = np.nonzero(close)
    if split:
        j = j + split
        turned = lengths[i] > lengths[j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
    step = max(1, COMPARE // letters.shape[1])
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        yes, lead = one_edit(letters[a], lengths[a], letters[b], lengths[b])
        yes &= ~(tail[a] & (lead >= lengths[a] // 2))  # found through the beginning
        a, b = a[yes], b[yes]
        near.add(np.concatenate([a, b]), np.concatenate([b, a]), ns, order)
    return near


def _near_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile pair and block; every tile pair has at most two tiles of words."""
    names = ["key", "side", "shorter", "tail", "word", "n"]
    rows: list[tuple] = []

    def solve(chunk: list[tuple]) -> pa.RecordBatch:
        key, side, shorter, tail, words, ns = zip(*chunk, strict=True)
        ids: dict = {}
        group = np.array([ids.setdefault(k, len(ids)) for k in key])
        ns = np.array(ns)
        latin = [w.encode("latin-1") for w in words]
        near = near_in_tile(
            latin, ns, np.array(shorter), np.array(tail), group, side.index(1) if 1 in side else 0
        )
        some = np.nonzero(near.count)[0]
        best = near.best[some]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words[k] for k in some], pa.string()),
                pa.array(near.count[some], pa.int64()),
                pa.array(-ns[best], pa.int64()),
                pa.array([words[k] for k in best], pa.string()),
            ],
            names=["word", "n_near", "minus_n", "near"],
        )

    def ready(whole: bool) -> Iterator[list[tuple]]:
        """Complete groups, small ones together."""
        nonlocal rows
        start = 0
        while start < len(rows):
            end, width, alone = start, 0, False
            while end < len(rows):
                stop = end
                while stop < len(rows) and rows[stop][0] == rows[end][0]:
                    stop += 1
                if stop == len(rows) and not whole:
                    break
                width = max(width, *(len(r[4]) for r in rows[end:stop]))
                parted = rows[stop - 1][1] == 1
                if end > start and (stop - start > JOINT or parted or width * (stop - start) > TILE_LETTERS):
                    break
                end, alone = stop, parted
                if alone:
                    break
            if end == start:
                break
            yield rows[start:end]
            start = end
        rows = rows[start:]

    for batch in batches:
        for part in slices(batch, 4096):
            rows += zip(*(part.column(c).to_pylist() for c in names), strict=True)
            for chunk in ready(False):
                yield solve(chunk)
    for chunk in ready(True):
        yield solve(chunk)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): how many near words, and the most frequent of them."""
    placed = blocks(words)
    keys = ["shorter", "tail", "half"]
    letters = F.max(F.length("word"))
    sizes = materialize(
        placed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("size"), letters.alias("longest"))
        .where("size > 1")
        # fewer words a tile if they are very long
        .withColumn("tile", F.greatest(F.lit(1), F.least(F.lit(TILE), F.lit(TILE_LETTERS) / F.col("longest"))).cast("long"))
        .withColumn("tiles", F.ceil(F.col("size") / F.col("tile"))),
        "spelling-blocks",
    )
    small = sizes.where("tiles = 1").select(*keys)
    one = placed.join(small, keys).select(
        F.concat_ws("/", "shorter", "tail", "half").alias("key"), F.lit(0).alias("side"), "shorter", "tail", "word", "n"
    )
    big = sizes.where("tiles > 1").select(*keys, "tile", "tiles")
    numbered, _ = number_rows(placed.join(big, keys), keys, ["word"], "no")
    t = F.floor(F.col("no") / F.col("tile"))
    # tile t meets every tile u: as the left side where t <= u, as the right where t > u
    pairs = numbered.withColumn("t", t).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("t", "u"), F.greatest("t", "u")
    many = pairs.select(
        F.concat_ws("/", "shorter", "tail", "half", low, high).alias("key"),
        (F.col("t") > F.col("u")).cast("int").alias("side"),
        "shorter",
        "tail",
        "word",
        "n",
    )
    work = one.unionByName(many)
    partial = (
        work.repartition("key")
        .sortWithinPartitions("shorter", "key", "side", "word")
        .mapInArrow(_near_task, "word string, n_near long, minus_n long, near string")
    )
    best = F.min(F.struct("minus_n", "near"))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near").alias("form"), (-F.col("b.minus_n")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of their chain of forms.

    Every step doubles how far a word looks; counts at least double along a chain, so a few steps do.
    """
    far = forms.select("word", F.col("form").alias("root"))
    while True:
        far = materialize(far, "spelling-far")
        up = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        looked = far.join(up, "root", "left")
        if looked.where("next IS NOT NULL").isEmpty():
            return far
        far = looked.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = materialize(count_words(docs), "spelling-words")
    near = near_words(words)
    has = F.col("form_n") >= TIMES * F.col("n")
    judged = materialize(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has, F.col("form")).alias("form"),
            F.when(has, F.col("form_n")).alias("form_n"),
        ),
        "spelling-near",
    )
    rooted = roots(judged.where("form IS NOT NULL"))
    return judged.join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
