"""Language identification: sums over segmentations by listing them, and held-out accuracy."""

import math
import random

import numpy as np

from spoorline.llm import langid as L


def listed(word, probs):
    """The sum over all ways to cut a word, by listing them."""
    if not word:
        return 1.0
    total = 0.0
    for end in range(1, min(len(word), L.MAX_PIECE) + 1):
        p = probs.get(word[:end], L.UNKNOWN if end == 1 else 0.0)
        total += p * listed(word[end:], probs) if p else 0.0
    return total


def test_forward_and_expected_counts():
    random.seed(6)
    pieces = [L.MARK, L.MARK + "a", "a", "b", "ab", "ba", "aba", "bb"]
    rng = np.random.default_rng(6)
    model = L.PieceModel.from_counts(pieces, rng.random((len(pieces), 2)))
    words = [L.MARK + "".join(random.choice("abz") for _ in range(random.randint(0, 7))) for _ in range(60)]
    logs = model.log_probs(words)
    for k in range(2):
        probs = dict(zip(pieces, model.probs[:, k], strict=False))
        for w, value in zip(words, logs[:, k], strict=True):
            assert math.isclose(value, math.log(listed(w, probs)), rel_tol=1e-9)
    known = [w for w in words if "z" not in w]
    one = L.PieceModel(pieces, model.probs[:, [0]])
    found = one.expected(known, np.ones((len(known), 1)))[:, 0]
    assert math.isclose(sum(n * len(p) for n, p in zip(found, pieces, strict=True)), sum(map(len, known)))


PIECES = [L.MARK, *"abcdefghijklmnopqrstuvwxyz", "th", "he", "qu", "la", L.MARK + "the", L.MARK + "la"]


def texts(n, seed):
    random.seed(seed)
    out = []
    for i in range(n):
        lang, words = random.choice([("en", ["the", "then", "that", "hen"]), ("fr", ["la", "que", "qui", "lala"])])
        out.append((i, " ".join(random.choice(words) for _ in range(random.randint(3, 30))), lang))
    return out


def test_held_out_accuracy_and_edge_cases(spark):
    schema = "doc_id bigint, text string, lang string, score string"
    train = spark.createDataFrame([(*r, "clash") for r in texts(80, 1)] + [(900, None, "en", ""), (901, "x", None, "")], schema)
    trained = L.train(train, PIECES)
    assert trained[0] == ["en", "fr"]
    rows = [*texts(40, 2), (100, None, None), (101, "", None), (102, "12 !?", None), (103, "the" * 5000, None), (104, "the", None), (104, "the", None)]
    got = {}
    for r in L.predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), trained).collect():
        assert 0 <= r.score <= 1
        got[r.doc_id] = r
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:40])
    assert [got[i].lang_pred for i in range(100, 105)] == ["und", "und", "und", "en", "en"]
    assert got[100].score == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.train(empty, PIECES) is None
    rows = spark.createDataFrame([(1, "the")], "doc_id bigint, text string")
    assert [tuple(r) for r in L.predict(rows, None).collect()] == [(1, "und", 0.0)]


def test_fold_is_crc32_of_the_key_as_text(spark):
    import zlib

    got = spark.range(50).select("id", L.fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)
