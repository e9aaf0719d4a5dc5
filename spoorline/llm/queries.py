"""Queries over the operators with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spoorline.llm.langid import fold, pieces_of_model, predict, train

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out")
    )
    pieces = pieces_of_model(public_tokenizers.path("piece_bpe_32k.model"))
    trained = train(docs.where(~F.col("held_out")), pieces)
    return predict(docs, trained).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every row whose id is divisible by 100, against all rows."""
    from spoorline.llm.bm25 import search

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "text")
    return search(docs, queries).select(
        F.col("query").alias("query_id"), "rank", "doc_id", F.round("score", 6).alias("score")
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm.quality_rules import judge

    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, labels.where("quality = 1").select("doc_id")).select(
        "_doc.doc_id",
        *[f"_rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.round("_rules.score", 6).alias("score"),
    )


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm.secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm.chat import format_turns, read_back, with_conflict

    return read_back(format_turns(with_conflict(table(spark, sf_dir, "conversations"))), in_order=True)


def op2_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm.langid import fold
    from spoorline.llm.quality_knn import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 3) == 1
    model = train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spoorline.llm.bpe import encode_digests

    return encode_digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spoorline.llm.packing import pack, tokenizer_ids

    encoder = tokenizer_ids(
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return pack(table(spark, sf_dir, "documents"), encoder)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm.line_dedup import dedup_lines

    kept = F.coalesce("_kept", F.lit(""))
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "_doc.doc_id",
        F.col("_gone").cast("long").alias("n_gone"),
        F.length(kept).cast("long").alias("kept_chars"),
        F.md5(kept.cast("binary")).alias("kept_md5"),
    )


def op11_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm.brown import score, train
    from spoorline.llm.langid import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 7) == 2
    return score(docs, train(docs.where(~held_out)), held_out)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm.spelling import group_variants

    return group_variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_votes": op2_quality_votes,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_search": op4_exact_search,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scans": op7_secret_scans,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_class_lm": op11_class_lm,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}

OP10_SQL = r"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS rid,
        string_split(regexp_replace(coalesce(text, ''), '([.!?] |\n)', '\1' || chr(1), 'g'), chr(1)) AS parts
    FROM documents
), all_lines AS (
    SELECT doc_id, rid, unnest(parts) AS raw, unnest(range(len(parts))) AS line FROM docs
), lines AS (
    SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM all_lines
), counted AS (
    SELECT doc_id, rid, line, t, len(regexp_split_to_array(t, '[\x20\x09-\x0D]+')) AS words,
        row_number() OVER (PARTITION BY rid ORDER BY line) AS n
    FROM lines WHERE t <> ''
), full_lines AS (
    SELECT *, sum(words) OVER (PARTITION BY rid ORDER BY line) AS upto FROM counted
), near AS (
    SELECT x.rid, x.n AS a, y.n AS b FROM full_lines x JOIN full_lines y
    ON x.rid = y.rid AND y.n BETWEEN x.n AND x.n + 24 AND y.upto - x.upto + x.words >= 25
), runs AS (
    SELECT rid, a, min(b) AS b FROM near GROUP BY rid, a UNION SELECT rid, max(a), b FROM near GROUP BY rid, b
), texts AS (
    SELECT l.doc_id, r.rid, min(l.line) AS from_line, max(l.line) AS to_line, string_agg(l.t, chr(10) ORDER BY l.n) AS run
    FROM runs r JOIN full_lines l ON l.rid = r.rid AND l.n BETWEEN r.a AND r.b GROUP BY l.doc_id, r.rid, r.a, r.b
), later AS (
    SELECT rid, from_line, to_line FROM texts
    QUALIFY rank() OVER (PARTITION BY run ORDER BY doc_id, from_line) > 1
), gone AS (
    SELECT DISTINCT l.rid, l.line FROM lines l JOIN later g ON l.rid = g.rid AND l.line BETWEEN from_line AND to_line
)
SELECT l.doc_id,
    count(g.line) AS n_gone,
    length(coalesce(string_agg(raw, '' ORDER BY l.line) FILTER (g.line IS NULL), '')) AS kept_chars,
    md5(coalesce(string_agg(raw, '' ORDER BY l.line) FILTER (g.line IS NULL), '')) AS kept_md5
FROM lines l LEFT JOIN gone g ON l.rid = g.rid AND l.line = g.line
GROUP BY l.doc_id, l.rid
"""

OP13_SQL = r"""
WITH base AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), texts AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM base
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS g, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, coalesce(g, false) AS good, coalesce(x, false) AS toxic, [
        len(ws) < 200,
        100 * len(list_distinct(ws)) < 50 * len(ws),
        100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
        regexp_matches(t, '[#$%&*|]'),
        coalesce(doc_id > first_id, false)] AS fails, count(*) AS n
    FROM texts LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), places AS (
    SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders
), outcomes AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, good, toxic, n,
        fails[instr('ABCDE', substr(filter_order, step, 1))] AS failing,
        len(list_filter(range(1, step), lambda s: fails[instr('ABCDE', substr(filter_order, s::INT, 1))])) > 0 AS gone,
        len(list_filter(fails, lambda y: y)) AS n_fails
    FROM masks, places
), steps AS (
    SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (failing AND n_fails = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (failing AND NOT gone AND good), 0)::BIGINT AS good_lost,
        coalesce(sum(n) FILTER (failing AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
    FROM outcomes GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM steps
"""

ORACLE: dict[str, str] = {"op10_line_dedup": OP10_SQL, "op13_filter_audit": OP13_SQL}
