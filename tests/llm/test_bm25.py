"""BM25 search against scoring every document, with small shards and blocks."""

import math
import random
import re
from collections import Counter

import pyarrow as pa

from spoorline.llm import bm25 as S

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, queries, k):
    bags = [(i, Counter(WORD.findall((t or "").encode().lower()))) for i, t in rows]
    n, mean = len(bags), max(1.0, sum(sum(c.values()) for _, c in bags) / len(bags))
    df = Counter(w for _, c in bags for w in c)
    out = {}
    for q, text in queries:
        scored = []
        for i, c in bags:
            length = sum(c.values())
            s = sum(
                m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (S.K1 + 1) / (c[w] + S.K1 * (1 - S.B + S.B * length / mean))
                for w, m in Counter(WORD.findall((text or "").encode().lower())).items()
                if w in c
            )
            if s > 0:
                scored.append((-round(s, 6), i is not None, i or 0))
        if scored:
            out[q] = [(-s, i if known else None) for s, known, i in sorted(scored)[:k]]
    return out


def test_equals_scoring_everything(spark, monkeypatch):
    random.seed(13)
    vocab = [f"w{int(random.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i, " ".join(random.choice(vocab) for _ in range(random.choice([0, 1, 5, 60])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "W1 w1"), (1003, "w1 W1"), (None, "w2 w2 w3"), (1004, "w1 " * 20_000)]
    rows.append(rows[5])
    queries = [(i, t) for i, t in rows if i is not None and i % 20 == 0] + [(7000, "no such word"), (7001, None), (7002, "w1")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, shard int")
    asked = spark.createDataFrame(queries, "query bigint, text string")
    want = brute(rows, queries, 10)
    for shard, block, dense in ((8192, 1024, 1024), (40, 8, 5)):
        monkeypatch.setattr(S, "SHARD_ROWS", shard)
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "DENSE", dense)
        got: dict = {}
        for r in S.search(docs, asked).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((round(r.score, 6), r.doc_id))
        assert set(got) == set(want)
        for q in want:
            assert [s for s, _ in got[q]] == [s for s, _ in want[q]]
            last = want[q][-1][0]
            assert sorted(str(x) for x in got[q] if x[0] > last) == sorted(str(x) for x in want[q] if x[0] > last)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a")], "query bigint, text string")
    assert S.search(none, asked).count() == 0
    assert S.search(none.union(spark.createDataFrame([(1, "a")], none.schema)), asked.limit(0)).count() == 0


def test_repeated_queries_count_once(spark):
    docs = spark.createDataFrame([(i, f"w{i % 5} common") for i in range(40)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "w1 common")], "query bigint, text string")
    once = sorted(tuple(r) for r in S.search(docs, asked).collect())
    assert sorted(tuple(r) for r in S.search(docs, asked.union(asked)).collect()) == once


def test_a_query_is_sent_once_a_task_whatever_the_shards(spark, monkeypatch):
    """What is shuffled must not grow with queries x shards; groups of queries change no result."""
    rows = [(i, f"w{i % 7} x{i} common") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    asked = docs.where("doc_id % 10 = 0").selectExpr("doc_id AS query", "text")
    want = sorted((r["query"], r["rank"], r.doc_id) for r in S.search(docs, asked).collect())
    monkeypatch.setattr(S, "SHARD_ROWS", 10)
    sent = []
    task = S._search_task

    def counting(*args):
        inner, rows_in = task(*args), spark.sparkContext.accumulator(0)
        sent.append(rows_in)

        def counted(batches):
            def each():
                for b in batches:
                    rows_in.add(b.num_rows - b.column("query").null_count)
                    yield b

            return inner(each())

        return counted

    monkeypatch.setattr(S, "_search_task", counting)
    tasks = spark.sparkContext.defaultParallelism
    for keep in (1 << 24, 500):
        monkeypatch.setattr(S, "KEEP_TERMS", keep)
        got = sorted((r["query"], r["rank"], r.doc_id) for r in S.search(docs, asked).collect())
        assert got == want
        assert sent.pop().value == 40 * tasks  # 40 shards


def test_a_task_hands_on_k_rows_a_query_whatever_its_shards():
    rows = []
    known = S.Terms()
    for shard in range(5):
        rows += [(shard, None, 100 * shard + i, "w1 " * (i + 1) + f"x{i} y", None, None, None) for i in range(20)]
        asked = known("w1 y").tolist()
        rows += [(shard, q, None, None, asked, [1, 1], [90, 90]) for q in (1, 2)]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3]
    names = ["shard", "query", "doc_id", "text", "terms", "ns", "dfs"]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    got = [r for b in S._search_task(12.0, 100, 3)(iter([whole])) for r in b.to_pylist()]
    assert len(got) == 2 * 3
    every = [r for i in range(5) for b in S._search_task(12.0, 100, 3)(iter([whole.slice(22 * i, 22)])) for r in b.to_pylist()]
    best = sorted((r["query"], -r["score"], r["doc_id"]) for r in every)
    want = [r for q in (1, 2) for r in [b for b in best if b[0] == q][:3]]
    assert sorted((r["query"], -r["score"], r["doc_id"]) for r in got) == want
