"""Jaccard join against all pairs, on families of copies, shared passages and edge cases."""

import random
import re
from collections import defaultdict

from spoorline.llm import ngram_join as J
from spoorline.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.append((i, s))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            sa, sb = sets[a][1], sets[b][1]
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb) and root(a) != root(b):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[root(k)].append(i)
    return sorted(((i, len(s), min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets)), key=str)


def fixture(seed):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(300)]

    def doc(n):
        return [random.choice(vocab) for _ in range(n)]

    texts = []
    for size, copies in ((3, 4), (6, 5), (20, 12), (60, 40), (150, 8), (150, 1)):
        base = doc(size)
        for _ in range(copies):
            w = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 4])):
                w[random.randrange(len(w))] = random.choice(vocab)
            texts.append(" ".join(w + (doc(random.randint(0, 8)) if random.random() < 0.3 else [])))
    passage = doc(40)
    texts += [" ".join(doc(random.choice([8, 20, 90])) + passage) for _ in range(50)]
    texts += [None, "", " \n", "a b", "A B", "a  b c", "É b", "é b"]
    random.shuffle(texts)
    rows = list(enumerate(texts))
    return [*rows, rows[3], rows[3], (None, "lonely words here"), (7, texts[9])]


def test_components_equal_all_pairs(spark, monkeypatch):
    for seed, hot, block in ((1, J.FREQUENT, J.BLOCK_NODES), (2, 5, 4)):
        monkeypatch.setattr(J, "FREQUENT", hot)
        monkeypatch.setattr(J, "BLOCK_NODES", block)
        rows = fixture(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, node string")
        got = sorted(map(tuple, J.near_duplicates(df).collect()), key=str)
        assert got == brute(rows)


def test_empty_table(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_chains_are_one_component(spark):
    chain = spark.range(300).selectExpr("id a", "id + 1 b")
    rows = components(chain.unionByName(spark.sql("SELECT 1000L a, 1001L b"))).collect()
    assert {r.root for r in rows if r.node <= 300} == {0}
    assert {r.root for r in rows if r.node >= 1000} == {1000}
