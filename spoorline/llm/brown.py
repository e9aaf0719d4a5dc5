"""Language-model scores by Brown class-based bigrams.

A text is its words, lower-cased in A-Z, and one end. The probability of a token is that of its
class after the class before (transition) times its own within its class (emission). Classes come
from exchange clustering, which moves words to the class that raises the likelihood of the class
bigrams most:

1. The ``CORE`` most frequent words are exchanged one after another, several sweeps, on the matrix
   of their bigrams. All other words are one class of their own, the end another.
2. Every other word, however rare, is moved out of that class by the same criterion: from the
   classes at its left and right over the whole corpus. These moves do not depend on each
   other, so they run wherever a word's occurrences meet.

Then every text becomes a sequence of class codes. Words in the ``LEXICON`` most frequent ones are
looked up in a table each task holds; the rest meet their class in a join. Transitions are counted
over all sequences of training texts.

Smoothing: emissions are discounted by a constant (estimated from the words seen once and twice);
what is taken off in a class is the probability of a word never seen. Transitions are mixed
with the frequency of the classes, by the number of different classes that follow
(Witten-Bell). After an unseen word the class frequencies alone decide. The probabilities of all
words, the unseen one and the end sum to one after any class.

The base score is that of add-one unigrams over the same counts.

Cases: a null text is empty, a text of one end. A null doc_id is empty text in the hash; repeated
rows count and are scored each. Words of equal count enter the core and the lexicon in the order
of their bytes. With nothing to learn from every score is 0. Long texts are split ``PART``
bytes at a time, and only their class codes are held whole. An empty table gives no row. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spoorline.llm.common import slices
from spoorline.session import materialize

#: Words that are exchanged one after another; the matrix of a task is the square of it.
CORE = 1024
CLASSES = 64
SWEEPS = 6
#: Words a task holds to look up; longer words than ``LOOKED_UP`` bytes are left to the join.
LEXICON, LOOKED_UP = 1 << 18, 64
#: Rows and bytes of text split at a time.
ROWS, PART = 256, 2 << 20
#: Occurrences and words a task gathers before it hands them on.
GATHERED, KEEP = 2_000_000, 400_000
#: Counts up to this have their gain in a table.
TABLED = 16

#: Stands for the end in a list of words; no word has a space.
END = b" "
#: Class codes: 0 to CLASSES - 1, then words without a class yet (or never seen), then the end.
OPEN, STOP, CODES = CLASSES, CLASSES + 1, CLASSES + 2
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


# --- texts as words


def word_parts(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in parts, the last one with the end."""
    text = text or b""
    start = 0
    while len(text) - start > PART:
        cut = _SPACE.search(text, start + PART)
        if not cut:
            break
        yield text[start : cut.start()].lower().split()
        start = cut.start()
    yield [*text[start:].lower().split(), END]


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """All texts of a task as lists of words with ends, about ``PART`` bytes a list."""
    for batch in batches:
        for part in slices(batch, ROWS):
            words, held = [], 0
            for text in part.column("text").cast(pa.binary()).to_pylist():
                for some in word_parts(text):
                    words += some
                    held += len(text or b"") + 1
                    if held > PART:
                        yield words
                        words, held = [], 0
            if words:
                yield words


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("text")


# --- counts


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts, ends left out."""

    def task(batches):
        total: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                names=["word", "n"],
            )
            total.clear()
            return out

        held = 0
        for words in stretches(batches):
            total.update(words)
            del total[END]
            held += sum(map(len, words))
            if len(total) > KEEP or held > 64 * PART:
                yield flush()
                held = 0
        yield flush()

    parts = texts(train).mapInArrow(task, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def count_pairs(train: DataFrame, core: list[bytes]) -> DataFrame:
    """(cell, n): bigrams of core words, of all others as one and of ends; cell = left * size + right."""
    size = len(core) + 2
    number = {w: i for i, w in enumerate(core)} | {END: size - 1}
    known = train.sparkSession.sparkContext.broadcast(number)  # at most CORE words

    def task(batches):
        get, cells = known.value.get, []

        def flush():
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            cells.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"]
            )

        before = size - 1
        for words in stretches(batches):
            ids = np.fromiter(map(get, words, repeat(size - 2)), np.int64, len(words))
            left = np.concatenate([[before], ids[:-1]])
            before = int(ids[-1])
            cells.append((left * size + ids).astype(np.int32))
            if sum(map(len, cells)) > GATHERED:
                yield flush()
        if cells:
            yield flush()

    parts = texts(train).mapInArrow(task, "cell int, n long")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"))


# --- exchange


def _f(x):
    """x log x."""
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    """What the exchange raises: log likelihood of class bigrams up to a constant."""
    return _f(n).sum() - _f(n.sum(0)).sum() - _f(n.sum(1)).sum()


def exchange(w: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each core word from the bigram matrix (core, others, end).

    Words start in turns by frequency; each is moved to its best class until a sweep moves none.
    """
    core = len(w) - 2
    of = np.concatenate([np.arange(core) % classes, [classes, classes + 1]])
    codes = classes + 2
    belongs = np.eye(codes)[of]
    w = w.astype(np.float64)
    right, left = w @ belongs, w.T @ belongs  # of each word: counts of the classes that follow, precede
    n = belongs.T @ right
    for _ in range(sweeps):
        moved = 0
        for v in range(core):
            a, s = of[v], w[v, v]
            r, l = right[v].copy(), left[v].copy()
            r[a] -= s
            l[a] -= s
            n[a, :] -= r
            n[:, a] -= l
            n[a, a] -= s
            out, into = n.sum(1), n.sum(0)
            gain = (_f(n + r[None, :]) - _f(n)).sum(1) + (_f(n + l[:, None]) - _f(n)).sum(0)
            own = np.diag(n)
            gain += _f(own + r + l + s) - _f(own + r) - _f(own + l) + _f(own)
            gain -= _f(out + r.sum() + s) - _f(out) + _f(into + l.sum() + s) - _f(into)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            n[b, :] += r
            n[:, b] += l
            n[b, b] += s
            if b != a:
                moved += 1
                of[v] = b
                right[:, a] -= w[:, v]
                right[:, b] += w[:, v]
                left[:, a] -= w[v, :]
                left[:, b] += w[v, :]
        if not moved:
            break
    return of[:core]


def core_classes(pairs: DataFrame, size: int) -> DataFrame:
    """(kind, i, j, n): the class j of each core word i, and the class bigrams they make."""

    def task(batches):
        w = np.zeros(size * size)
        for b in batches:
            w[b.column("cell").to_numpy()] = b.column("n").to_numpy()
        w = w.reshape(size, size)
        of = exchange(w, CLASSES, SWEEPS)
        belongs = np.eye(CODES)[np.concatenate([of, [OPEN, STOP]])]
        n = (belongs.T @ w @ belongs).round().astype(np.int64)
        i, j = np.nonzero(n)
        rows = [
            np.concatenate([np.zeros(len(of)), np.ones(len(i))]),
            np.concatenate([np.arange(len(of)), i]),
            np.concatenate([of, j]),
            np.concatenate([np.zeros(len(of)), n[i, j]]),
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64)) for x in rows], names=["kind", "i", "j", "n"]
        )

    # at most the square of CORE + 2 cells
    return pairs.repartition(1).mapInArrow(task, "kind long, i long, j long, n long")


# --- all other words


def neighbours(train: DataFrame, core: dict[bytes, int]) -> DataFrame:
    """(word, codes): of the words outside the core, the class codes before and after each occurrence.

    A row has the occurrences of one word in a stretch of a task, two bytes each.
    """
    known = train.sparkSession.sparkContext.broadcast(core | {END: STOP})

    def task(batches):
        get = known.value.get
        names: dict[bytes, int] = {}
        at, around, gathered = [], [], 0

        def flush():
            ids = np.concatenate(at)
            order = np.argsort(ids, kind="stable")
            ends = 2 * np.cumsum(np.bincount(ids, minlength=len(names)))
            codes = np.concatenate(around)[order].tobytes()
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            column = pa.Array.from_buffers(
                pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(codes)]
            )
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(names), pa.binary()), column], names=["word", "codes"]
            )
            names.clear()
            at.clear()
            around.clear()
            return out

        # two tokens are carried on: the last one's right neighbour is not known yet
        tail, codes_before = [], np.array([STOP], np.uint8)
        held = 0
        for words in stretches(batches):
            words = tail + words
            new = np.fromiter(map(get, words[len(tail) :], repeat(OPEN)), np.uint8, len(words) - len(tail))
            codes = np.concatenate([codes_before, new])  # codes[i + 1] is of words[i]
            inner = np.nonzero(codes[1:-1] == OPEN)[0]
            if len(inner):
                here = [words[i] for i in inner]
                at.append(np.fromiter((names.setdefault(x, len(names)) for x in here), np.int64, len(here)))
                around.append(np.stack([codes[inner], codes[inner + 2]], 1))
                gathered += len(here)
                held += sum(map(len, here))
            tail, codes_before = words[-1:], codes[-2:]
            if gathered > GATHERED or len(names) > KEEP or held > 64 * PART:
                yield flush()
                gathered, held = 0, 0
        # a task's last word is an end, which needs no class
        if at:
            yield flush()

    return texts(train).mapInArrow(task, "word binary, codes binary")


class Mover:
    """Best classes of many words at once, the class bigrams of the core being fixed."""

    def __init__(self, n: np.ndarray):
        self.near = np.concatenate([n[:, :CLASSES], n[:CLASSES, :].T]).astype(np.float64)
        self.out, self.into = n.sum(1)[:CLASSES].astype(float), n.sum(0)[:CLASSES].astype(float)
        self.base = _f(self.near)
        self.table = np.stack([_f(self.near + x) - self.base for x in range(TABLED + 1)])

    def classes(self, counts: np.ndarray) -> np.ndarray:
        """``counts``: words by codes before, then codes after."""
        best = np.zeros(len(counts), np.int64)
        total = counts[:, :CODES].sum(1)
        for at in range(0, len(counts), 2048):
            some, n = counts[at : at + 2048], total[at : at + 2048, None]
            row, code = np.nonzero(some)
            x = some[row, code]
            gain = self.table[np.minimum(x, TABLED), code]
            big = np.nonzero(x > TABLED)[0]
            gain[big] = _f(self.near[code[big]] + x[big, None]) - self.base[code[big]]
            starts = np.searchsorted(row, np.arange(len(some)))
            gain = np.add.reduceat(gain, starts, axis=0)
            gain -= _f(self.out + n) - _f(self.out) + _f(self.into + n) - _f(self.into)
            best[at : at + 2048] = gain.argmax(1)
        return best


def place_words(around: DataFrame, n: np.ndarray) -> DataFrame:
    """(word, n, class) of the words outside the core."""
    bigrams = around.sparkSession.sparkContext.broadcast(n)  # CODES squared numbers

    def task(batches):
        mover = Mover(bigrams.value)
        last, carried = None, None

        def out(words, counts):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()),
                    pa.array(counts[:, :CODES].sum(1), pa.int64()),
                    pa.array(mover.classes(counts), pa.int32()),
                ],
                names=["word", "n", "class"],
            )

        for batch in batches:
            for part in slices(batch, 4096):
                words = part.column("word").to_pylist()
                codes = part.column("codes").to_pylist()
                rows, names = np.empty(len(words), np.int64), []
                for i, x in enumerate(words):
                    if not names or x != names[-1]:
                        names.append(x)
                    rows[i] = len(names) - 1
                places = np.frombuffer(b"".join(codes), np.uint8).astype(np.int64).reshape(-1, 2)
                row = np.repeat(rows, [len(c) // 2 for c in codes]) * 2 * CODES
                cells = np.concatenate([row + places[:, 0], row + CODES + places[:, 1]])
                counts = np.bincount(cells, minlength=len(names) * 2 * CODES).reshape(-1, 2 * CODES)
                if names[0] == last:
                    counts[0] += carried
                elif last is not None:
                    yield out([last], carried[None])
                last, carried = names[-1], counts[-1].copy()
                if len(names) > 1:
                    yield out(names[:-1], counts[:-1])
        if last is not None:
            yield out([last], carried[None])

    return around.repartition("word").sortWithinPartitions("word").mapInArrow(task, "word binary, n long, class int")


# --- the model


@dataclass
class Model:
    """Words with count and class, and what tasks need of them; ``ends``: training texts."""

    words: DataFrame
    ends: int
    tokens: int
    types: int
    totals: np.ndarray
    sizes: np.ndarray
    discount: float

    def unseen(self) -> np.ndarray:
        """Probability of an unseen word in each class."""
        return self.discount * self.sizes / np.maximum(self.totals, 1)


def train(docs: DataFrame) -> Model:
    """Counts and classes from all texts of ``docs``."""
    spark = docs.sparkSession
    counted = materialize(count_words(docs), "brown-counts")
    short = counted.where(F.octet_length("word") <= LOOKED_UP)
    top = [bytes(r.word) for r in short.orderBy(F.desc("n"), "word").limit(CORE).collect()]
    pairs = materialize(count_pairs(docs, top), "brown-pairs")
    placed = core_classes(pairs, len(top) + 2).collect()  # CORE rows and CODES squared
    of = {top[r.i]: r.j for r in placed if r.kind == 0}
    n = np.zeros((CODES, CODES), np.int64)
    for r in placed:
        if r.kind == 1:
            n[r.i, r.j] = r.n
    rest = place_words(neighbours(docs, of), n)
    core = spark.createDataFrame([(bytearray(w), c) for w, c in of.items()], "word binary, class int")
    words = counted.join(F.broadcast(core), "word").select("word", "n", "class").unionByName(rest)
    words = materialize(words, "brown-words")
    per = words.groupBy("class").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("types"),
        F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice"),
    ).collect()
    totals, sizes = np.zeros(CODES), np.zeros(CODES)
    for r in per:
        totals[r["class"]], sizes[r["class"]] = r.n, r.types
    ends = docs.count()
    once, twice = sum(r.once for r in per), sum(r.twice for r in per)
    return Model(
        words=words,
        ends=ends,
        tokens=int(totals.sum()) + ends,
        types=int(sizes.sum()) + (ends > 0),
        totals=totals,
        sizes=sizes,
        discount=once / (once + 2 * twice) if once and twice else 0.5,
    )


def lexicon(model: Model) -> tuple[bytes, np.ndarray, np.ndarray]:
    """At most ``LEXICON`` words with counts and classes: all from a count on that a histogram proves.

    The words are joined by spaces.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    short = model.words.where(F.octet_length("word") <= LOOKED_UP).withColumn("step", step)
    steps = short.groupBy("step").count().collect()  # at most 8 * 63 rows
    least, held = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["count"]
        if held > LEXICON:
            break
        least = r["step"]
    if least is None:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = short.where(F.col("step") >= least).select("word", "n", "class").toArrow()
    return (
        b" ".join(got.column("word").to_pylist()),
        got.column("n").to_numpy(),
        got.column("class").to_numpy().astype(np.int64),
    )


def sequences(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, codes and sums of every row; words outside the lexicon are left in ``rest``."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon(model))
    totals, discount, ends = model.totals, model.discount, model.ends
    schema = StructType(
        [
            docs.schema["doc_id"],
            *StructType.fromDDL(
                "key long, codes binary, emitted double, based double, known long, rest array<struct<at:int,word:binary>>"
            ).fields,
        ]
    )
    rest_type = pa.list_(pa.struct([("at", pa.int32()), ("word", pa.binary())]))

    def task(batches):
        words, n, code = held.value
        number = {w: i for i, w in enumerate(words.split(b" "))} if len(n) else {}
        number[END] = len(n)
        get = number.get
        emitted = np.concatenate([np.log10((n - discount) / totals[code]), [0.0]])
        based = np.log10(np.concatenate([n, [ends]]) + 1.0)
        code = np.concatenate([code, [STOP]]).astype(np.uint8)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, ROWS):
                columns: dict[str, list] = {f.name: [] for f in schema.fields[1:]}
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    seen, codes, rest, sums, known, at = [], [], [], [0.0, 0.0], 0, 0
                    for seen in word_parts(text):
                        ids = np.fromiter(map(get, seen, repeat(-1)), np.int64, len(seen))
                        there = ids >= 0
                        mine = ids[there]
                        out = np.full(len(ids), OPEN, np.uint8)
                        out[there] = code[mine]
                        codes.append(out.tobytes())
                        sums[0] += emitted[mine].sum()
                        sums[1] += based[mine].sum()
                        known += len(mine)
                        if len(mine) < len(ids):
                            rest += [{"at": at + i, "word": seen[i]} for i in np.nonzero(~there)[0].tolist()]
                        at += len(ids)
                    row = (key, b"".join(codes), *sums, known if ends else 0, rest)
                    for name, value in zip(columns, row, strict=True):
                        columns[name].append(value)
                    key += 1
                types = [pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), rest_type]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)],
                    ],
                    names=schema.names,
                )

    first = materialize(docs.select("doc_id", "text").mapInArrow(task, schema), "brown-sequences")
    rest = first.select("key", F.explode("rest").alias("r")).select("key", "r.at", "r.word")
    discounted = F.col("n") - F.lit(discount)
    totals = F.array(*[F.lit(float(t)) for t in totals[:CLASSES]])
    share = F.log10(discounted / F.element_at(totals, F.col("class") + 1))
    found = (
        rest.join(model.words, "word")
        .groupBy("key")
        .agg(
            F.sum(share).alias("emitted2"),
            F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("based2"),
            F.count(F.lit(1)).alias("known2"),
            F.collect_list(F.struct("at", F.col("class").alias("code"))).alias("late"),  # of one text
        )
    )

    def fill(batches):
        for batch in batches:
            for part in slices(batch, ROWS):
                codes = []
                for c, late in zip(*(part.column(x).to_pylist() for x in ("codes", "late")), strict=True):
                    if late:
                        whole = np.frombuffer(c, np.uint8).copy()
                        whole[[x["at"] for x in late]] = [x["code"] for x in late]
                        c = whole.tobytes()
                    codes.append(c)
                arrays = {n: part.column(n) for n in part.schema.names if n != "late"} | {"codes": pa.array(codes, pa.binary())}
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    def both(name):
        return (F.col(name) + F.coalesce(f"{name}2", F.lit(0))).alias(name)

    joined = first.drop("rest").join(found, "key", "left").select(
        "doc_id", "codes", both("emitted"), both("based"), both("known"), "late"
    )
    out = StructType([f for f in joined.schema.fields if f.name != "late"])
    return materialize(joined.mapInArrow(fill, out), "brown-codes")


def transitions(coded: DataFrame) -> np.ndarray:
    """Class bigrams of the sequences, led by an end."""

    def task(batches):
        n = np.zeros(CODES * CODES, np.int64)
        for batch in batches:
            for part in slices(batch, ROWS):
                codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).astype(np.int64)
                # every sequence ends with an end, which leads the next one
                left = np.concatenate([[STOP], codes[:-1]])
                n += np.bincount(left * CODES + codes, minlength=CODES * CODES)
        cell = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n[cell])], names=["cell", "n"])

    parts = coded.select("codes").mapInArrow(task, "cell int, n long")
    out = np.zeros(CODES * CODES, np.int64)
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most CODES squared rows
        out[r.cell] = r.n
    return out.reshape(CODES, CODES)


def smoothed(n: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """log10 transition probabilities; the column of OPEN is an unseen word in any class."""
    n = n.astype(float)
    n[OPEN, :] = n[:, OPEN] = 0  # no training word is unseen
    use = np.ones(CODES, bool)
    use[OPEN] = False
    frequency = np.where(use, n.sum(0) + 1e-9, 0)
    frequency /= frequency.sum()
    follow = (n > 0).sum(1)[:, None]
    p = (n + follow * frequency) / np.maximum(n.sum(1)[:, None] + follow, 1)
    p[follow[:, 0] == 0] = frequency
    p[:, OPEN] = p[:, :CLASSES] @ unseen[:CLASSES]
    return np.log10(np.maximum(p, 1e-300))


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    coded = sequences(docs, model)
    marked = coded.withColumn("held_out", held_out)
    table = smoothed(transitions(marked.where(~F.col("held_out"))), model.unseen())
    if not model.ends:
        table[:] = 0.0  # nothing learnt

    def task(batches):
        for batch in batches:
            for part in slices(batch, ROWS):
                moved = []
                for c in part.column("codes").to_pylist():
                    codes = np.frombuffer(c, np.uint8)
                    moved.append((len(c), float(table[np.concatenate([[STOP], codes[:-1]]), codes].sum())))
                n, log = zip(*moved, strict=True)
                names = ["doc_id", "held_out", "n", "moved", "emitted", "based", "known"]
                own = {"n": pa.array(n, pa.int64()), "moved": pa.array(log, pa.float64())}
                yield pa.RecordBatch.from_arrays([own.get(x) or part.column(x) for x in names], names=names)

    fields = {f.name: f for f in marked.schema.fields}
    schema = StructType(
        [
            fields["doc_id"],
            fields["held_out"],
            *StructType.fromDDL("n long, moved double").fields,
            *[fields[x] for x in ("emitted", "based", "known")],
        ]
    )
    scored = marked.mapInArrow(task, schema)
    total = F.col("moved") + F.col("emitted")
    return scored.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("based") - F.col("n") * F.log10(F.lit(float(model.tokens + model.types + 1)))).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n")).alias("perplexity"),
    )
