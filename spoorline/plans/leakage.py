"""Overlap between training and test sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.functions.text import mask_literals, sequence_fingerprint
from spoorline.operators.attribution import SESSION


def query_statements(nodes: DataFrame) -> DataFrame:
    """The statements of session graphs: one per Query node, so start and end count once."""
    return nodes.where("node_type = 'Query' AND query <> ''").select(
        *SESSION, "timestamp_unix", "event_id", "query"
    )


def session_fingerprints(statements: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per session: fingerprint of its statements, exact and with literals masked."""
    texts = {"sql": F.col("query"), "sql_norm": mask_literals(F.col("query"))}
    return sequence_fingerprint(statements, SESSION, order, texts)


def match_counts(test: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Test sessions whose fingerprint occurs in the pool, per template and in total.

    ``template`` is null in the total row.
    """
    index = pool.groupBy(key).agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    hits = test.join(index, key, "left")
    matched = F.col("_lo").isNotNull()
    conflict = matched & ((F.col("_lo") != F.col("y")) | (F.col("_hi") != F.col("y")))
    return hits.rollup("template").agg(
        F.grouping("template").cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(matched).alias("matched"),
        F.count_if(F.col("y") == 1).alias("malicious"),
        F.count_if(matched & (F.col("y") == 1)).alias("malicious_matched"),
        F.count_if(conflict).alias("label_conflicts"),
    )


def match_tables(
    sessions: DataFrame, keys: Sequence[str], pools: Mapping[str, Sequence[str]], test: str = "test"
) -> DataFrame:
    """`match_counts` of the ``test`` split for every key and pool of splits, in one pass.

    Keys become rows; the index has one row per key and value, with the classes seen in each pool.
    """
    shown = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])
    long = sessions.select("template", "y", "split", F.inline(shown))
    known = {p: F.when(F.col("split").isin(list(parts)), F.col("y")) for p, parts in pools.items()}
    index = long.groupBy("key", "value").agg(
        *[f(y).alias(f"{n}_{p}") for p, y in known.items() for n, f in (("lo", F.min), ("hi", F.max))]
    )
    seen = F.array(*[F.struct(F.lit(p).alias("pool"), F.col(f"lo_{p}").alias("lo"), F.col(f"hi_{p}").alias("hi")) for p in pools])
    hits = long.where(F.col("split") == test).join(index, ["key", "value"], "left")
    matched = F.col("lo").isNotNull()
    conflict = matched & ((F.col("lo") != F.col("y")) | (F.col("hi") != F.col("y")))
    every = ["key", "pool", "template"]
    return (
        hits.select("key", "template", "y", F.inline(seen))
        .groupingSets([every, every[:2]], *every)
        .agg(
            F.grouping("template").cast("int").alias("is_total"),
            F.count(F.lit(1)).alias("sessions"),
            F.count_if(matched).alias("matched"),
            F.count_if(F.col("y") == 1).alias("malicious"),
            F.count_if(matched & (F.col("y") == 1)).alias("malicious_matched"),
            F.count_if(conflict).alias("label_conflicts"),
        )
    )


def statement_coverage(held: DataFrame, kept: DataFrame) -> DataFrame:
    """Masked statements of the held-out sessions × kept templates that contain them.

    A statement that occurs nowhere else has one row with a null template.
    """
    wanted = held.select(mask_literals(F.col("query")).alias("statement")).distinct()
    have = kept.select(mask_literals(F.col("query")).alias("statement"), "template").distinct()
    return wanted.join(have, "statement", "left")


def coverage_totals(covered: DataFrame) -> DataFrame:
    """Held-out statements in all and those unseen in the kept templates."""
    per = covered.groupBy("statement").agg(F.count("template").alias("_in"))
    return per.agg(
        F.count(F.lit(1)).alias("statements"), F.count_if(F.col("_in") == 0).alias("unseen")
    )


def class_exclusive(values: DataFrame, value: str = "value") -> DataFrame:
    """Values that occur in sessions of one class only, with the number of sessions."""
    counts = values.groupBy(value).agg(
        F.count_if(F.col("y") == 1).alias("malicious"), F.count_if(F.col("y") == 0).alias("benign")
    )
    only = F.when(F.col("benign") == 0, F.lit("malicious_only")).when(
        F.col("malicious") == 0, F.lit("benign_only")
    )
    return counts.withColumn("exclusive", only).where(F.col("exclusive").isNotNull())


def pattern_sessions(statements: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Per template and pattern: sessions with a masked statement that contains it."""
    masked = mask_literals(F.col("query"))
    hits = F.array_compact(
        F.array(*[F.when(masked.rlike(rx), F.lit(name)) for name, rx in patterns.items()])
    )
    return (
        statements.select("template", *SESSION, F.explode(hits).alias("pattern"))
        .distinct()
        .groupBy("template", "pattern")
        .agg(F.count(F.lit(1)).alias("sessions"))
    )


def templates_per_split(sessions: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Templates × splits with the number of sessions (0 if none)."""
    return sessions.groupBy("template").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in splits]
    )


def only_in(sessions: DataFrame, split: str, other: str) -> DataFrame:
    """Templates of one split that the other one lacks."""
    def of(s):
        return sessions.where(F.col("split") == s).select("template")

    return of(split).distinct().exceptAll(of(other).distinct())
