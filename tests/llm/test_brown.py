"""Class-based scores: exchange against the likelihood, the model against a plain computation."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spoorline.llm import brown as B
from spoorline.llm.langid import fold

def held():
    return fold("doc_id", 7) == 2


def rows(seed, n=220):
    random.seed(seed)
    sets = [[f"{p}{i}" for i in range(40)] for p in ("noun", "Verb", "adj")]
    out = []
    for i in range(n):
        text = []
        for _ in range(random.randint(0, 60)):
            for group in sets:
                text.append(group[min(int(random.expovariate(0.2)), 39)] if random.random() < 0.97 else f"rare{random.randrange(10**4)}")
        out.append((i, random.choice([" ", "\n", " \t"]).join(text)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "   "), (None, "noun1 Verb2"), (5, out[5][1]), (5, out[5][1])]


def frame(spark, data):
    return spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id bigint, text string, codes int")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(B, "CORE", 30)
    monkeypatch.setattr(B, "LEXICON", 60)
    monkeypatch.setattr(B, "PART", 500)
    monkeypatch.setattr(B, "GATHERED", 700)


def class_bigrams(w, of, codes):
    n = np.zeros((codes, codes))
    for i, a in enumerate(of):
        for j, b in enumerate(of):
            n[a, b] += w[i, j]
    return n


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(4)
    size, classes = 26, 4
    kind = np.arange(size) % 3
    w = rng.poisson(1 + 30 * ((kind[:, None] + 1) % 3 == kind[None, :]))
    of = np.concatenate([B.exchange(w, classes, 50), [classes, classes + 1]])
    start = np.concatenate([np.arange(size - 2) % classes, [classes, classes + 1]])
    best = B.likelihood(class_bigrams(w, of, classes + 2))
    assert best > B.likelihood(class_bigrams(w, start, classes + 2))
    for v in range(size - 2):
        for c in range(classes):
            other = of.copy()
            other[v] = c
            assert B.likelihood(class_bigrams(w, other, classes + 2)) <= best + 1e-6


def plain_counts(data):
    train = [(t or "") for i, t in data if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    texts = [B.re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for t in train]
    return texts, Counter(w for t in texts for w in t)


def test_other_words_move_where_the_likelihood_is_best(spark):
    data = rows(1)
    texts, counts = plain_counts(data)
    model = B.train(frame(spark, data).where(~held()))
    of = {r.word.decode(): r["class"] for r in model.words.collect()}
    core = sorted(counts, key=lambda w: (-counts[w], w.encode()))[: B.CORE]
    code = {w: of[w] for w in core}
    n, around = np.zeros((B.CODES, B.CODES)), defaultdict(Counter)
    for t in texts:
        codes = [B.STOP, *[code.get(w, B.OPEN) for w in t], B.STOP]
        for a, b in zip(codes, codes[1:], strict=False):
            n[a, b] += 1
        for k, w in enumerate(t):
            if w not in code:
                around[w][codes[k], 0] += 1
                around[w][codes[k + 2], 1] += 1
    f = lambda x: x * math.log(max(x, 1))
    for w in random.sample(sorted(around), 40):
        gains = []
        for c in range(B.CLASSES):
            g = 0.0
            for (code_, side), x in around[w].items():
                cell = n[c, code_] if side else n[code_, c]
                g += f(cell + x) - f(cell)
            for total in (n[c].sum(), n[:, c].sum()):
                g -= f(total + counts[w]) - f(total)
            gains.append(g)
        assert gains[of[w]] >= max(gains) - 1e-6
    assert {w: 0 for w in of} == {w: 0 for w in counts}


def test_equals_a_plain_computation(spark):
    data = rows(2)
    df = frame(spark, data)
    texts, counts = plain_counts(data)
    model = B.train(df.where(~held()))
    of = {r.word.decode(): (r.n, r["class"]) for r in model.words.collect()}
    assert {w: n for w, (n, _) in of.items()} == counts
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    totals, sizes, pairs = Counter(), Counter(), Counter()
    for n, c in of.values():
        totals[c] += n
        sizes[c] += 1
    for t in texts:
        codes = [B.STOP, *[of[w][1] for w in t], B.STOP]
        pairs.update(zip(codes, codes[1:], strict=False))
    into = Counter()
    for (_, b), n in pairs.items():
        into[b] += n
    all_ = sum(into.values())

    def p_class(a, b):
        if a == B.OPEN:
            return into[b] / all_
        follow = sum(1 for (x, _) in pairs if x == a)
        n = sum(v for (x, _), v in pairs.items() if x == a)
        return (pairs[a, b] + follow * into[b] / all_) / (n + follow)

    table = {(a, b): p_class(a, b) for a in [*totals, B.STOP, B.OPEN] for b in [*totals, B.STOP]}
    for a in [*totals, B.STOP, B.OPEN]:
        table[a, B.OPEN] = sum(table[a, b] * d * sizes[b] / totals[b] for b in totals)
        whole = sum(table[a, b] * sum((n - d) / totals[b] for n, c in of.values() if c == b) for b in totals)
        assert abs(whole + table[a, B.OPEN] + table[a, B.STOP] - 1) < 1e-9
    tokens, types = sum(counts.values()) + len(texts), len(counts) + 1
    got = B.score(df, model, held()).collect()
    assert len(got) == len(data)
    want = defaultdict(list)
    for i, t in data:
        words = B.re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        base = math.log10((len(texts) + 1) / (tokens + types + 1))
        score, before = 0.0, B.STOP
        for w in words:
            n, c = of.get(w, (0, B.OPEN))
            base += math.log10((n + 1) / (tokens + types + 1))
            score += math.log10(table[before, c]) + (math.log10((n - d) / totals[c]) if n else 0)
            before = c
        score += math.log10(table[before, B.STOP])
        want[i].append((len(words) + 1, sum(w in of for w in words) + 1, round(base, 6), round(score, 6)))
    have = defaultdict(list)
    for r in got:
        assert r.train_tokens == tokens
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2)
        have[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_nothing_to_learn_and_no_rows(spark):
    df = frame(spark, [(1, "a b a"), (2, None)])
    model = B.train(df.limit(0))
    rows_ = {r.doc_id: r for r in B.score(df, model, held()).collect()}
    assert (rows_[1].n_tokens, rows_[1].n_known, rows_[1].score, rows_[1].base_score) == (4, 0, 0.0, 0.0)
    assert B.score(df.limit(0), B.train(df), held()).count() == 0


def test_a_long_word_and_parts(spark):
    long = "z" * 3000
    df = frame(spark, [(i, f"{long} a b {long}") for i in range(30)])
    out = B.score(df, B.train(df.where(~held())), held()).collect()
    assert {(r.n_tokens, r.n_known) for r in out} == {(5, 5)}
