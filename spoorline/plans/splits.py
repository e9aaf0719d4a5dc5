"""Splits without overlap, template folds, samples and label joins.

An order by seed is an order by md5 of the id and the seed, so that it is the
same on every engine and at every number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, number_rows


def seeded(*ids: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", *ids, F.lit(str(seed))))


def family_disjoint(
    dev: DataFrame,
    test: DataFrame,
    ratio: float = 0.8,
    seed: int = 42,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """Families of dev without those of test, each in train or validation.

    Fails if fewer than two families remain.
    """
    rest = dev.select("family").distinct().join(test.select("family"), "family", "left_anti")
    ranked = rest.select("family", F.lit(1).alias("_g"), seeded(F.col("family"), seed=seed).alias("_h"))
    placed, n = number_rows(ranked, ["_g"], ["_h", "family"], "_at", seg_rows)
    if n < 2:
        raise ValueError("fewer than two families remain")
    n_train = max(1, min(int(n * ratio), n - 1))
    part = F.when(F.col("_at") < n_train, F.lit("train")).otherwise(F.lit("val"))
    return placed.select("family", part.alias("split"))


def with_split(rows: DataFrame, families: DataFrame) -> DataFrame:
    return rows.join(families, "family")


def split_statistics(rows: DataFrame, group: Sequence[str] = ("split",)) -> DataFrame:
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("y") == 1).alias("malicious"),
        F.count_if(F.col("y") == 0).alias("benign"),
        F.bround(F.avg("y"), 3).alias("malicious_ratio"),
    )


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def disjointness(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split; empty if the splits are disjoint."""
    return (
        rows.groupBy(key)
        .agg(F.countDistinct(split).alias("splits"))
        .where(F.col("splits") > 1)
    )


def template_classes(rows: DataFrame) -> DataFrame:
    """Per template: its class, and whether sessions of both classes occur."""
    return rows.groupBy("template").agg(
        F.max("y").alias("y"), (F.min("y") != F.max("y")).alias("conflict")
    )


def rotated_folds(templates: DataFrame) -> DataFrame:
    """Fold i tests malicious template i and benign i mod n, and validates on the next two.

    One row per fold and template that it tests or validates on; a fold trains on all others.
    Input: (template, y), one row per template; their number is that of scenario kinds, not
    of sessions.
    """
    by_class = Window.partitionBy("y").orderBy("template")
    placed = templates.select("template", "y", (F.row_number().over(by_class) - 1).alias("at"))
    sizes = templates.groupBy("y").agg(F.count(F.lit(1)).cast("int").alias("n"))
    folds = placed.where("y = 1").select(F.col("template").alias("fold"), F.col("at").alias("i"))
    steps = [F.struct(F.lit(p).alias("part"), F.lit(s).alias("step")) for p, s in (("test", 0), ("val", 1))]
    parts = F.explode(F.array(*steps))
    wanted = folds.select("fold", "i", parts.alias("p")).select("fold", "i", "p.*")
    # each fold takes one place of either class, modulo the class's size
    at = F.pmod(F.col("i") + F.col("step"), F.col("n"))
    wanted = wanted.withColumn("y", F.explode(F.array(F.lit(0), F.lit(1)))).join(sizes, "y")
    wanted = wanted.select("fold", "y", at.alias("at"), "part")
    return wanted.join(placed, ["y", "at"]).select("fold", "template", "y", "part").groupBy(
        "fold", "template", "y"
    ).agg(F.min("part").alias("part"))  # a class of one template is tested


def fold_counts(folds: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows and malicious rows per fold and part; training rows are those of no other part."""
    per = rows.groupBy("template").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y") == 1).alias("_m")
    )
    own = folds.join(per, "template").groupBy("fold", "part").agg(
        F.sum("_n").alias("graphs"), F.sum("_m").alias("malicious")
    )
    whole = per.agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"), F.lit(1).alias("_one"))
    used = own.groupBy("fold").agg(F.sum("graphs").alias("_g"), F.sum("malicious").alias("_u"))
    train = used.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").select(  # one row of totals
        "fold", F.lit("train").alias("part"), (F.col("_n") - F.col("_g")).alias("graphs"),
        (F.col("_m") - F.col("_u")).alias("malicious"),
    )
    return own.unionByName(train.where("graphs > 0"))


def keyword_holdout(rows: DataFrame, name: str, keyword: str) -> DataFrame:
    held = F.lower(F.col(name)).contains(keyword.lower())
    return rows.withColumn("split", F.when(held, "val").otherwise("train"))


def run_split(rows: DataFrame, run_no: str, last_train: int = 42, test: str | None = None) -> DataFrame:
    part = F.when(F.col(run_no) <= last_train, F.lit("train")).otherwise(F.lit("val"))
    if test:
        part = F.when(F.col(test), F.lit("test")).otherwise(part)
    return rows.withColumn("split", part)


def undersample(rows: DataFrame, key: str, keep: float = 0.2, seed: int = 42) -> DataFrame:
    """All positives and a fixed share of the negatives, chosen by hash."""
    draw = F.conv(F.substring(seeded(F.col(key), seed=seed), 1, 8), 16, 10).cast("long")
    return rows.where((F.col("y") == 1) | (draw < int(keep * (1 << 32))))


def sample_per_run(rows: DataFrame, run: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each run, the first in seeded order; each task keeps n of a run before any shuffle."""
    first = Window.partitionBy(run).orderBy("_h", key)
    hashed = rows.withColumn("_h", seeded(F.col(key).cast("string"), seed=seed))
    return hashed.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= n).drop("_at", "_h")


def with_family(labels: DataFrame, families: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels with their family; fails while running if one is missing."""
    missing = F.raise_error(F.concat(F.lit("no family for "), F.concat_ws("/", *keys)))
    return labels.join(families, list(keys), "left").withColumn(
        "family", F.coalesce("family", missing.cast("string"))
    )


def without_family(rows: DataFrame, families: DataFrame, keys: Sequence[str], family: str) -> DataFrame:
    """Rows of every other family; rows without a known family stay."""
    named = rows.join(families.select(*keys, "family"), list(keys), "left")
    return named.where(F.col("family").isNull() | (F.col("family") != family))


def graph_file_matches(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions with the number of their graph files: 0 is missing, above 1 has extras."""
    found = files.groupBy("run", "pid").agg(F.count(F.lit(1)).alias("files"))
    return sessions.join(found, ["run", "pid"], "left").select(
        "run",
        "pid",
        F.coalesce("files", F.lit(0)).alias("files"),
        F.greatest(F.coalesce("files", F.lit(0)) - 1, F.lit(0)).alias("extra"),
    )


def graph_file_facts(name: Column) -> dict[str, Column]:
    """Run, pid, prefix and label from a graph file name."""
    rx = r"enriched_(run_\d+)_(\d+)_(?:p(\d+)_)?(Benign|Malicious)\.graphml$"

    def part(i):
        return F.nullif(F.regexp_extract(name, rx, i), F.lit(""))

    return {
        "run": part(1),
        "pid": part(2).cast("long"),
        "prefix": part(3).cast("int"),
        "label": part(4),
        "y": F.when(part(4) == "Malicious", 1).when(part(4) == "Benign", 0),
    }


def class_from_name(name: Column, y: Column, detailed: Column | None = None) -> Column:
    """Class of a graph: its detailed label, else by the binary label.

    ``detailed`` is None where no detailed labels are given at all; then the file name's tail
    comes before the binary label.
    """
    stem = F.regexp_replace(name, r"^enriched_session_|\.graphml$", "")
    tail = F.regexp_extract(stem, r"^[^_]*_(.*)$", 1)
    by_file = F.nullif(F.regexp_replace(tail, "_", " "), F.lit(""))
    binary = F.when(y == 0, F.lit("Normal")).otherwise(F.lit("Malicious"))
    return F.coalesce(by_file if detailed is None else detailed, binary)


def by_count(rows: DataFrame, column: str) -> DataFrame:
    """Values by falling count."""
    return rows.groupBy(column).count().orderBy(F.desc("count"), column)
