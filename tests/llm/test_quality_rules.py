"""Quality rules against a plain computation."""

import math
import random
import re
from collections import Counter

from spoorline.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def rows(seed, n=150):
    random.seed(seed)
    parts = ["a", "b", "c", "the", "é", "#x", "***", "|", "<b>", " ", "  ", "\n", "\t", "\x0b", " ", "\r\n", "wörd."]
    out = [(i, "".join(random.choice(parts) + " " * random.randint(0, 1) for _ in range(random.randint(0, 200)))) for i in range(n)]
    return [*out, (1000, None), (1001, ""), (1002, " \n"), (1003, "same " * 4000), (1003, "same " * 4000), (None, "x y z")]


def test_counts_and_base_rule(spark):
    data = rows(9)
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id bigint, text string, _weights int")
    got = R.judge(df, df.where("doc_id < 50").select("doc_id")).select("_doc.*", "_rules.*", "_failed", "_kept").collect()
    assert len(got) == len(data)
    for r in got:
        want = plain(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r._failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r._kept == (not r._failed and r.score >= R.THRESHOLD)
    assert R.judge(df.limit(0), df.select("doc_id")).count() == 0


def test_score_is_the_mean_log_ratio(spark):
    data = [(i, t) for i, t in rows(10, 40)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    trusted = df.where("doc_id < 20").select("doc_id")
    grams = {(r.doc_id, r.text): r.g for r in df.select("doc_id", "text", R.buckets(df["text"]).alias("g")).collect()}
    raw, target = Counter(), Counter()
    for i, t in data:
        raw.update(grams[i, t])
        if i is not None and i < 20:
            target.update(grams[i, t])

    def share(c, b):
        n = sum(c.values())
        return (c[b] + n * R.SMOOTH / R.BUCKETS) / (n * (1 + R.SMOOTH))

    for r in R.judge(df, trusted).select("_doc.*", "_rules.score").collect():
        g = grams[r.doc_id, r.text]
        want = sum(math.log(share(target, b) / share(raw, b)) for b in g) / len(g) if g else 0.0
        assert abs(r.score - want) < 1e-5
    # nothing trusted: only the base limits decide
    assert {r.score for r in R.judge(df, trusted.limit(0)).select("_rules.score").collect()} == {0.0}


def test_ids_beyond_the_broadcast_limit_are_joined_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(rows(11, 30), "doc_id bigint, text string")
    trusted = df.where("doc_id < 20").select("doc_id")
    a = R.log_ratios(df, trusted).first()[0]
    monkeypatch.setattr(R, "BROADCAST_IDS", 3)
    assert R.log_ratios(df, trusted).first()[0] == a


def test_junk_goes_and_prose_stays(spark):
    random.seed(12)
    words = ["the", "of", "sea", "tale", "and", "light", "stone"]
    prose = [" ".join(random.choice(words) + random.choice(["", "", "", ".", ","]) for _ in range(random.randint(60, 200))) for _ in range(60)]
    junk = [" ".join(random.choice(words) + random.choice(["***", "$$$"]) for _ in range(100)) for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id bigint, text string")
    got = {r.doc_id: r._kept for r in R.judge(df, df.where("doc_id < 30").select("doc_id")).select("_doc.doc_id", "_kept", "_failed").where("NOT _failed").collect()}
    assert all(kept == (i < 60) for i, kept in got.items())
    assert sum(got.values()) > 10
