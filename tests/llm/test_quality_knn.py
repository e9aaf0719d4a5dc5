"""Quality votes: exact neighbours, held-out accuracy, edge cases."""

import random

import numpy as np

from spoorline.llm import quality_knn as Q


def test_scores_follow_exact_neighbours():
    rng = np.random.default_rng(7)
    shares = rng.random((40, Q.DIMS)).astype(np.float32) * (rng.random((40, Q.DIMS)) < 0.02)
    labels = (rng.random(40) < 0.5).astype(float)
    model = Q.fit(shares, labels)
    fresh = rng.random((9, Q.DIMS)).astype(np.float32) * (rng.random((9, Q.DIMS)) < 0.02)
    got = model.score(fresh)
    for value, v in zip(got, model.project(fresh), strict=True):
        sims = model.vectors @ v
        near = np.argsort(-sims)[: Q.NEIGHBOURS]
        votes = np.clip(sims[near], 0, 1).astype(float) ** Q.SHARPNESS
        assert abs(value - (votes * labels[near]).sum() / votes.sum()) < 1e-5


def rows(n, seed):
    random.seed(seed)
    out = []
    for i in range(n):
        good = random.random() < 0.7
        words = [random.choice(["the", "of", "and", "word", "tale", "sea"]) for _ in range(random.randint(20, 60))]
        text = " ".join(words) if good else " ".join(w + random.choice(["***", "$$$"]) for w in words)
        out.append((i, text, int(good)))
    return out


def test_held_out_accuracy_and_edge_cases(spark):
    data = rows(120, 8)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in data], "doc_id bigint, text string, _label string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(5, None), (None, 1), (9999, 0)], "doc_id bigint, quality int")
    model = Q.train(docs.where("doc_id < 80"), labels)
    more = spark.createDataFrame([(500, None), (501, ""), (502, "!"), (503, "sea " * 30_000), (503, "sea")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in Q.score(docs.select("doc_id", "text").unionByName(more), model).collect()}
    assert all((got[i] >= 0.5) == bool(q) for i, _, q in data if i >= 80)
    assert got[500] == got[501] == 0.5
    assert all(0 <= s <= 1 for s in got.values())
    assert Q.train(docs, labels.where("quality = 1")) is None
    assert {r.score for r in Q.score(docs, None).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).count() == 0


def test_repeated_rows_do_not_widen_the_sample(spark):
    rows = [(1, "one text of it")] * 1000 + [(i, f"text number {i % 7}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    assert len(Q.train(docs, labels, per_label=5).labels) <= 10
    assert Q.shape_of("a1" * 100) == "a0" * 100  # the whole word
