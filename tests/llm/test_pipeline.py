"""The pipeline's stages on a small table with every odd case, each against a plain computation."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from spoorline.llm.secrets import redact_text
from tests.llm.test_line_dedup import brute as kept_lines
from tests.llm.test_ngram_join import brute as components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "_kept", "node"]


def rows():
    random.seed(21)
    vocab = ["sea", "tale", "and", "light", "stone", "of", "the", "river", "under", "moon"] + [f"w{i}" for i in range(200)]

    def prose(n):
        words = [random.choice(vocab) for _ in range(n)]
        return " ".join(w + random.choice(["", "", "", "", ".", ","]) for w in words)

    passage = prose(60)
    out = [(i, prose(random.randint(60, 160))) for i in range(60)]
    out += [(100 + i, out[i][1]) for i in range(5)]  # copies
    out += [(110 + i, out[20][1].replace("sea", f"x{i}")) for i in range(4)]  # near copies
    out += [(120 + i, prose(80) + "\n" + passage) for i in range(4)]  # a shared passage
    out += [(130, " ".join(random.choice(vocab) + "***" for _ in range(90)))]  # junk
    out += [(140, prose(70) + ' token = "abcdef123456"'), (141, None), (142, ""), (143, "few words"), (None, prose(90))]
    out += [(150, "word " * 30_000), out[3], out[3], (4, prose(90)), (None, out[6][1]), (None, prose(95))]
    return [(i, t, "en", "src", None if t is None else len(t), 1, "x") for i, t in out]


def table(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _kept int, node string"
    spark.createDataFrame(rows(), schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(130, 0)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages(spark, tmp_path):
    docs, folder = table(spark, tmp_path)

    good = P.quality_rules(spark, docs, folder)
    assert good.columns == COLUMNS
    ids = {r.doc_id for r in good.collect()}
    assert ids.isdisjoint({130, 141, 142, 143, 150})  # junk, no text, few words, repeated words
    assert set(range(60)) <= ids and {120, 140, None} <= ids  # clean documents stay
    good.write.parquet(f"{tmp_path}/1")

    good = spark.read.parquet(f"{tmp_path}/1")
    fewer = P.line_dedup(spark, good, folder)
    assert fewer.columns == COLUMNS
    before = pairs(good)
    left = [(i, new) for (i, old), new in zip(before, kept_lines(before), strict=True) if new.strip() or not old.strip()]
    assert pairs(fewer) == sorted(left, key=str)
    assert fewer.where("n_chars <> length(text)").count() == 0
    fewer.write.parquet(f"{tmp_path}/2")

    # near duplicates are looked for in a table that still has them
    # rows of equal id are told apart by their texts; of equal rows one stays
    different = sorted(set(pairs(good)), key=str)
    members = components(list(enumerate(t for _, t in different)))
    group = {i: c for i, _, c in members}
    heads: dict = {}
    for i, (doc_id, text) in enumerate(different):
        rank = (doc_id is None, doc_id or 0)
        heads[group[i]] = min(heads.get(group[i], (rank, doc_id, text)), (rank, doc_id, text), key=lambda h: h[0])
    stay = sorted(((d, t) for _, d, t in heads.values()), key=str)
    assert pairs(P.ngram_join(spark, good, folder)) == stay
    single = P.ngram_join(spark, spark.read.parquet(f"{tmp_path}/2"), folder)
    assert single.columns == COLUMNS

    safe = P.secret_scans(spark, single, folder)
    assert pairs(safe) == sorted(((i, redact_text(t)) for i, t in pairs(single)), key=str)
    assert not any("abcdef123456" in t for _, t in pairs(safe))

    packed = P.best_fit_packing(spark, safe, folder)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in pairs(safe)}


def test_run_and_empty_tables(spark, tmp_path):
    docs, folder = table(spark, tmp_path)
    assert P.run(spark, folder).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    empty = docs.limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0, name
    assert len(P.STAGES) == 5
