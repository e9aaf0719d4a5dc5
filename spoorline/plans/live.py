"""Evaluation of live verdicts: labels, planned sessions, early alerts, synthetic twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import medians


def template_of(instance: Column) -> Column:
    """The template of an instance id: its trailing number removed."""
    return F.regexp_replace(instance, r"_\d+$", "")


def split_label(label: Column) -> tuple[Column, Column]:
    """Class and key of "Class:key"; the key is "" if there is none."""
    return F.split(label, ":", 2)[0], F.coalesce(F.get(F.split(label, ":", 2), F.lit(1)), F.lit(""))


def binary_label(label: Column) -> Column:
    """1 for attack or malicious in any case and spacing, else 0."""
    return F.when(F.lower(F.trim(label)).isin("attack", "malicious"), 1).otherwise(0)


def source_class(key: Column, planned: Column) -> Column:
    """Where a session came from: pgbench, scenario, its own key, or other."""
    return (
        F.when(key == "pgbench", F.lit("pgbench"))
        .when(planned, F.lit("scenario"))
        .otherwise(F.coalesce(F.nullif(key, F.lit("")), F.lit("other")))
    )


def last_per_session(records: DataFrame, key: str, position: str) -> DataFrame:
    """The latest record of every key."""
    return _pick(records, key, F.max_by, position)


def first_per_session(records: DataFrame, key: str, position: str) -> DataFrame:
    return _pick(records, key, F.min_by, position)


def _pick(records: DataFrame, key: str, by, position: str) -> DataFrame:
    row = F.struct(*[c for c in records.columns if c != key])
    return records.groupBy(key).agg(by(row, position).alias("_r")).select(key, "_r.*")


def last_rows(records: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the last by ``position``; without that column, the greatest row."""
    if position in records.columns:
        return last_per_session(records, key, position)
    row = F.struct(*[c for c in records.columns if c != key])
    return records.groupBy(key).agg(F.max(row).alias("_r")).select(key, "_r.*")


def live_verdicts(
    scores: DataFrame, labels: DataFrame, manifest: DataFrame, position: str = "pos"
) -> DataFrame:
    """Scores ⋈ labels ⟕ plan on the label's key.

    Repeated rows of a session or key give one verdict: the last by ``position`` stands. Keys
    that no plan has do not take part in the join, so that a frequent one does not gather.
    """
    cls, key = split_label(F.col("label"))
    scores, labels = (last_rows(t, "session_id", position) for t in (scores, labels))
    named = labels.select("session_id", cls.alias("cls"), key.alias("key"))
    plan = last_rows(manifest, "key", position).withColumnRenamed("key", "_key")
    plan = plan.withColumn("_planned", F.lit(True)).drop(position)
    plannable = F.when(~F.col("key").isin("pgbench", ""), F.col("key"))
    joined = scores.drop(position).join(named, "session_id")
    joined = joined.join(plan, plannable == F.col("_key"), "left").drop("_key")
    planned = F.col("_planned").isNotNull()
    return joined.withColumns(
        {
            "y": (F.col("cls") == "Malicious").cast("int"),
            "source": source_class(F.col("key"), planned),
            "family": F.when(planned, template_of(F.coalesce("scenario_id", F.lit("")))).otherwise(
                F.col("key")
            ),
        }
    ).drop("_planned")


def coverage(scores: DataFrame, labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions that do not line up: scored without label, planned but not scored, with errors."""
    _, key = split_label(F.col("label"))
    scored = labels.join(scores.select("session_id"), "session_id", "left_semi")
    scored_keys = scored.select(key.alias("key")).distinct()
    unlabelled = scores.join(labels.select("session_id"), "session_id", "left_anti").select(
        F.lit("unlabelled").alias("problem"), F.col("session_id").cast("string").alias("item")
    )
    missing = manifest.join(scored_keys, "key", "left_anti").select(
        F.lit("never_scored").alias("problem"), F.col("key").alias("item")
    )
    errors = manifest.where(F.size("errors") > 0).select(
        F.lit("errors").alias("problem"), F.col("key").alias("item")
    )
    return unlabelled.unionByName(missing).unionByName(errors)


def early_alarms(verdicts: DataFrame, alerts: DataFrame, theta: float) -> DataFrame:
    """Sessions that alerted while running, against their final verdict."""
    first = alerts.select(
        "session_id", F.col("risk").alias("alert_risk"), F.col("n_events").alias("alert_events")
    )
    return verdicts.join(first, "session_id", "full_outer").withColumns(
        {
            "alerted": F.col("alert_risk").isNotNull(),
            "early_only": F.col("alert_risk").isNotNull() & (F.col("risk") < theta),
        }
    )


def twin_agreement(live: DataFrame, synthetic: DataFrame, theta: float) -> DataFrame:
    """Live sessions next to the same session of the synthetic corpus, per family and in all (``ALL``)."""
    twin = synthetic.select("dataset", "run", "synthetic_backend_pid", F.col("risk").alias("twin_risk"))
    delta = F.col("risk") - F.col("twin_risk")
    same = (F.col("risk") >= theta) == (F.col("twin_risk") >= theta)
    pairs = live.join(twin, ["dataset", "run", "synthetic_backend_pid"])
    pairs = pairs.withColumn("family", F.explode(F.array("family", F.lit("ALL"))))
    out = pairs.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(same).alias("same_verdict"),
        F.avg(delta).alias("mean_delta"),
        F.avg(F.abs(delta)).alias("mean_abs_delta"),
        F.count_if(~same).alias("flips"),
    )
    for column, name in (("twin_risk", "twin_median"), ("risk", "live_median")):
        out = out.join(medians(pairs, ["family"], column, name), "family")
    return out
