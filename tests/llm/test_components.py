"""Components against union by hand; links are dropped once their ends have met."""

import random

from spoorline.llm import components as C


def roots(pairs):
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def test_links_shrink_and_roots_are_the_smallest(spark, monkeypatch):
    random.seed(5)
    sparse = [(random.randrange(400), random.randrange(400)) for _ in range(260)]
    path = [(1000 + (7 * i) % 211, 1000 + (7 * (i + 1)) % 211) for i in range(210)]
    hub = [(3000, 2000 + i) for i in range(50)]  # its smallest leaf takes it, the others follow
    dense = [(4000 + i, 4000 + j) for i in range(30) for j in range(30)]
    pairs = [*sparse, *path, *hub, *dense, (5000, 5000)]
    counts, old = [], C.materialize

    def counted(df, tag):
        out = old(df, tag)
        if tag == "edges":
            counts.append(out.count())
        return out

    monkeypatch.setattr(C, "materialize", counted)
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert {r.node: r.root for r in C.components(df).collect()} == roots(pairs)
    assert counts[-1] == 0 and sum(counts) < 2 * counts[0]
    assert C.components(df.limit(0)).count() == 0
