"""Exact BM25 top-k search over sharded inverted indexes with block-max pruning.

Documents are dealt to shards of bounded size. Each shard builds an inverted index whose
documents are ordered so that similar ones share a block; every term keeps its largest impact per
block. Queries stream through a shard: block bounds (the sum of the largest impacts) are computed
first, the most promising block is scored, and then only the blocks whose bound reaches the k-th
score so far, as WAND with block maxima does. Frequent terms are bounded and scored as dense
products in single precision, rare ones by their postings; whatever comes within the error margin
of the k-th score is scored again in double precision, term by term. Document frequencies,
document count and mean length are those of the whole table, so the shards' results merge
exactly. As many tasks as there are cores go through their shards one after another and hand on
the k best of each query only, so what is merged grows with the queries alone; the k-th score of
the shards before bounds the blocks of the next one from the start. A task is sent each query once, not
once a shard, and keeps it while its shards go by. Queries of more than `KEEP_TERMS` terms are dealt to
groups, and each group gets tasks of its own that read all documents: memory stays bounded, and what
is shuffled grows with queries x cores and documents x groups, not with queries x shards.

A query is the whole text of its row: each distinct word counts as often as it occurs. Words
are runs of anything but white space, A-Z in lower case, compared by 64-bit hashes. Ties go to
the smaller document id, null ids first. Only documents with a positive score are returned, so
null and empty texts are neither found nor find anything. Repeated rows are found each. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorline.llm.common import map_rows, slices
from spoorline.llm.ngram_join import _Hashes, words_of
from spoorline.session import materialize

K1, B = 1.2, 0.75
#: Documents of a shard, documents of a block, terms kept dense, queries scored together.
SHARD_ROWS, BLOCK, DENSE, BATCH = 6144, 1024, 1024, 256
#: Words whose hashes a task keeps.
KEEP_WORDS = 200_000
#: Terms of all queries that a task keeps, 16 bytes each; with more, the queries are dealt to groups.
KEEP_TERMS = 1 << 24
#: What a query itself takes, in terms; each of its k best takes one more.
QUERY_TERMS = 20
#: Relative error that single-precision sums may have; scores this near are computed again.
MARGIN = 5e-4


class Terms:
    """Word hashes of texts, with a bounded table of words."""

    def __init__(self):
        self.known = _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > KEEP_WORDS:
            self.known = _Hashes()
        found = words_of((text or "").encode().lower())
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found)).view(np.int64)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df; the row of a null term holds the number of words of all texts instead."""

    def make():
        terms = Terms()

        def work(rows):
            all_terms = [terms(t) for (t,) in rows]
            distinct = np.concatenate([np.unique(t) for t in all_terms])
            found, n = np.unique(distinct, return_counts=True)
            total = sum(map(len, all_terms))
            return {"term": [None, *found.tolist()], "df": [total, *n.tolist()]}

        return work

    parts = map_rows(docs, make, "term bigint, df bigint", ["text"], rows=8192)
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, n: the distinct terms of each query."""

    def make():
        terms = Terms()

        def work(rows):
            out = {"query": [], "term": [], "n": []}
            for id_, text in rows:
                found, n = np.unique(terms(text), return_counts=True)
                out["query"] += [id_] * len(found)
                out["term"] += found.tolist()
                out["n"] += n.tolist()
            return out

        return work

    return map_rows(queries, make, "query bigint, term bigint, n bigint", ["query", "text"])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of many ranges, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)


class Shard:
    """Inverted index of some documents, in blocks."""

    def __init__(self, ids: list, texts: list[np.ndarray], mean_length: float):
        self.ids = ids
        n = len(ids)
        lengths = np.array([len(t) for t in texts])
        doc = np.repeat(np.arange(n), lengths)
        every = np.concatenate(texts) if n else np.zeros(0, np.int64)
        texts.clear()  # large; the index holds what is needed
        self.terms, pair = np.unique(every, return_inverse=True)
        del every
        width = max(1, len(self.terms))
        pair += doc * width
        del doc
        pair, tf = np.unique(pair, return_counts=True)
        doc, term = (pair // width).astype(np.int32), (pair % width).astype(np.int32)
        del pair
        norm = K1 * (1 - B + B * lengths / mean_length)
        impact = tf * (K1 + 1) / (tf + norm[doc])
        # forward index, by document and term
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.doc_terms, self.doc_impact = term, impact
        df = np.bincount(term, minlength=len(self.terms))
        self.dense = np.argsort(-df, kind="stable")[:DENSE]
        column = np.full(len(self.terms), -1)
        column[self.dense] = np.arange(len(self.dense))
        self.column = column
        frequent = column[term] >= 0
        matrix = np.zeros((n, len(self.dense)), np.float32)
        matrix[doc[frequent], column[term[frequent]]] = impact[frequent]
        self.order = self._similar(matrix)
        self.matrix = matrix[self.order]
        del matrix
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        self.largest = np.array(
            [self.matrix[i * BLOCK : (i + 1) * BLOCK].max(axis=0) for i in range(self.blocks)]
        ).T
        # postings of the other terms by term, then place; entries are their stretches per block
        rare = np.flatnonzero(~frequent)
        rare = rare[np.lexsort((place[doc[rare]], term[rare]))]
        self.at, self.impact = place[doc[rare]], impact[rare]
        entry = term[rare].astype(np.int64) * self.blocks + self.at // BLOCK
        self.entry, start = np.unique(entry, return_index=True)
        self.start = start
        self.size = np.diff(np.append(start, len(rare)))
        self.entry_max = np.maximum.reduceat(self.impact, start) if len(start) else np.zeros(0)
        self.entry_block = self.entry % max(1, self.blocks)
        self.term_entry = np.searchsorted(self.entry, np.arange(len(self.terms) + 1) * self.blocks)

    @staticmethod
    def _similar(matrix: np.ndarray, rounds: int = 6, kinds: int = 8) -> np.ndarray:
        """An order of rows in which rows with the same leading direction lie together."""
        basis = np.random.default_rng(0).random((matrix.shape[1], kinds)).astype(np.float32)
        for _ in range(rounds):
            basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
        turned = np.abs(matrix @ basis[:, 1:]) if basis.shape[1] > 1 else matrix @ basis
        return np.lexsort((turned.max(axis=1), turned.argmax(axis=1)))

    def search(self, queries: list[tuple], k: int, least: np.ndarray | None = None) -> Iterator[tuple]:
        """(query, document id, score) of the k best of each query; queries: id, terms, weights.

        ``least``: scores, by query, below which nothing is wanted.
        """
        n = len(self.ids)
        if not n or not len(self.terms):
            return
        weight = np.zeros((len(queries), len(self.dense)), np.float32)
        bound = np.zeros((len(queries), self.blocks))
        rare, own = [], []
        for i, (_, terms, weights) in enumerate(queries):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            known = self.terms[at] == terms
            at, w = at[known], weights[known]
            own.append((at, w))
            col = self.column[at]
            weight[i, col[col >= 0]] = w[col >= 0]
            at, w = at[col < 0], w[col < 0]
            size = self.term_entry[at + 1] - self.term_entry[at]
            entries = ranges(self.term_entry[at], size)
            each = np.repeat(w, size)
            bound[i] = np.bincount(self.entry_block[entries], each * self.entry_max[entries], self.blocks)
            rare.append((entries, each))
        bound += weight @ self.largest
        bound *= 1 + MARGIN
        scores = np.zeros((len(queries), n))
        asked = np.zeros(len(queries)) if least is None else least * (1 - MARGIN)
        todo = np.zeros(bound.shape, bool)
        todo[np.arange(len(queries)), bound.argmax(axis=1)] = bound.max(axis=1) >= asked
        self._score(todo, weight, rare, scores)
        floor = np.maximum(self._floor(scores, k), asked)
        more = (bound >= floor[:, None]) & (bound > 0) & ~todo
        self._score(more, weight, rare, scores)
        floor = np.maximum(self._floor(scores, k), asked)
        for i, (id_, *_) in enumerate(queries):
            near = np.flatnonzero((scores[i] >= floor[i]) & (scores[i] > 0))
            for d in near.tolist():
                doc = int(self.order[d])
                yield id_, self.ids[doc], self._exact(doc, *own[i])

    def _score(self, todo: np.ndarray, weight: np.ndarray, rare: list, scores: np.ndarray) -> None:
        """Add the scores of the chosen blocks by query."""
        n = scores.shape[1]
        for i in np.flatnonzero(todo.any(axis=1)).tolist():
            entries, each = rare[i]
            chosen = todo[i][self.entry_block[entries]]
            entries, each = entries[chosen], each[chosen]
            size = self.size[entries]
            at = ranges(self.start[entries], size)
            scores[i] += np.bincount(self.at[at], np.repeat(each, size) * self.impact[at], n)
        for b in range(self.blocks):
            these = np.flatnonzero(todo[:, b])
            if len(these):
                part = slice(b * BLOCK, (b + 1) * BLOCK)
                scores[these, part] += weight[these] @ self.matrix[part].T

    @staticmethod
    def _floor(scores: np.ndarray, k: int) -> np.ndarray:
        """A score that the k-th best reaches for certain, by query."""
        if scores.shape[1] <= k:
            return np.zeros(len(scores))
        return np.partition(scores, -k, axis=1)[:, -k] * (1 - MARGIN)

    def _exact(self, doc: int, terms: np.ndarray, weights: np.ndarray) -> float:
        span = slice(self.first[doc], self.first[doc + 1])
        own, impact = self.doc_terms[span], self.doc_impact[span]
        at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
        hit = own[at] == terms
        return float(np.sum(weights[hit] * impact[at[hit]]))


FOUND = "query bigint, doc_id bigint, score double"


class Best:
    """The k best documents of each query so far."""

    def __init__(self, k: int):
        self.k, self.slot = k, {}
        self.n = np.zeros(0, np.int64)
        self.score, self.id, self.named = np.zeros((0, k)), np.zeros((0, k), np.int64), np.zeros((0, k), bool)

    def least(self, queries: list[int]) -> np.ndarray:
        """The k-th score of each query, 0 while there are fewer."""
        for q in queries:
            self.slot.setdefault(q, len(self.slot))
        if len(self.slot) > len(self.n):
            more = max(BATCH, len(self.slot))  # doubles
            self.n = np.pad(self.n, (0, more))
            self.score, self.id, self.named = (
                np.pad(a, ((0, more), (0, 0))) for a in (self.score, self.id, self.named)
            )
        at = [self.slot[q] for q in queries]
        return np.where(self.n[at] == self.k, self.score[at, -1], 0.0)

    def add(self, found: list[tuple]) -> None:
        """Rows of queries that `least` was asked for; those of a query stand together."""
        for query, rows in groupby(found, lambda r: r[0]):
            _, ids, scores = zip(*rows, strict=True)
            s = self.slot[query]
            n = self.n[s]
            score = np.append(self.score[s, :n], scores)
            id_ = np.append(self.id[s, :n], [0 if i is None else i for i in ids])
            named = np.append(self.named[s, :n], [i is not None for i in ids])
            first = np.lexsort((id_, named, -score))[: self.k]
            self.n[s] = n = len(first)
            self.score[s, :n], self.id[s, :n], self.named[s, :n] = score[first], id_[first], named[first]

    def batches(self, rows: int = 8192) -> Iterator[pa.RecordBatch]:
        """query, doc_id, score of all; then nothing is kept."""
        queries = np.fromiter(self.slot, np.int64, len(self.slot))
        for at in range(0, len(queries), rows):
            part = slice(at, min(at + rows, len(queries)))
            held = np.arange(self.k) < self.n[part, None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(queries[part], self.n[part])),
                    pa.array(self.id[part][held], mask=~self.named[part][held]),
                    pa.array(self.score[part][held]),
                ],
                names=["query", "doc_id", "score"],
            )
        self.__init__(self.k)


def _search_task(mean_length: float, count: int, k: int):
    """Rows of a partition by shard: build the index of its documents, then search in it.

    A query is kept: it is asked of the shard it came in, and of all that follow.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, current, best = Terms(), object(), Best(k)
        ids, texts, held = [], [], {}

        def ask():
            shard = Shard(ids, texts, mean_length)
            queries = list(held.values())
            for at in range(0, len(queries), BATCH):
                part = queries[at : at + BATCH]
                best.add(list(shard.search(part, k, best.least([q for q, *_ in part]))))

        for batch in batches:
            for part in slices(batch, BATCH):
                *plain, own_terms, own_ns, own_dfs = part.columns
                for i, (number, query, id_, text) in enumerate(
                    zip(*(c.to_pylist() for c in plain), strict=True)
                ):
                    if number != current:
                        if ids:
                            ask()
                        current, ids, texts = number, [], []
                    if query is None:
                        ids.append(id_)
                        texts.append(terms(text))
                    elif query not in held:
                        asked, n, df = (c[i].values.to_numpy() for c in (own_terms, own_ns, own_dfs))
                        # a copy, as a view would keep the whole batch
                        held[query] = query, asked.copy(), n * np.log1p((count - df + 0.5) / (df + 0.5))
        if ids:
            ask()
        yield from best.batches()

    return task


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, doc_id, score, rank: the k documents with the highest scores for each query.

    ``docs`` has doc_id and text, ``queries`` has query (not null) and text. Rows of a query that is there
    several times count once; if their texts differ, the smallest is asked.
    """
    queries = queries.groupBy("query").agg(F.min("text").alias("text"))
    docs = docs.select("doc_id", "text")
    df = materialize(document_frequencies(docs), "frequencies")
    count = docs.count()
    words = df.where("term IS NULL").agg(F.sum("df")).first()[0] or 0
    shards = max(1, -(-count // SHARD_ROWS))
    weighted = (
        query_terms(queries.select("query", "text"))
        .join(df.where("term IS NOT NULL"), "term")
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("term", "n", "df"))).alias("t"))
        .select("query", *[F.col(f"t.{c}").alias(f"{c}s") for c in ("term", "n", "df")])
    )
    weighted = materialize(weighted, "queries")
    kept = weighted.agg(F.sum(F.size("terms") + QUERY_TERMS + k)).first()[0] or 0
    groups = max(1, -(-kept // KEEP_TERMS))
    tasks = min(shards, max(1, docs.sparkSession.sparkContext.defaultParallelism))
    nothing = F.lit(None)
    dealt = docs.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"),
        nothing.cast("bigint").alias("query"),
        "doc_id",
        "text",
        *[nothing.cast("array<bigint>").alias(c) for c in ("terms", "ns", "dfs")],
    ).withColumn("task", F.pmod("shard", F.lit(tasks)).cast("int"))
    asked = weighted.select(
        F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("group"),
        nothing.cast("bigint").alias("shard"),
        "query",
        nothing.cast("bigint").alias("doc_id"),
        nothing.cast("string").alias("text"),
        "terms",
        "ns",
        "dfs",
        F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"),
    )
    # queries have no shard, so they come before all documents
    part = F.col("group") * tasks + F.col("task")
    together = dealt.unionByName(asked).repartitionById(tasks * groups, part)
    together = together.sortWithinPartitions("shard").drop("group", "task")
    mean_length = max(1.0, words / max(1, count))
    found = together.mapInArrow(_search_task(mean_length, count, k), FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
