"""Verdict metrics: confusion, ranking, thresholds, per-group reports, seed summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, Fold, medians, number_rows, running

METRICS = ("precision", "recall", "f1", "accuracy", "fpr")
SUMMARY_KEYS = ("recall", "fpr", "precision", "f1", "roc_auc", "pr_auc")


def _cells(y: Column, flagged: Column) -> dict[str, Column]:
    hit = y == 1
    return {
        "tp": F.count_if(hit & flagged),
        "fp": F.count_if(~hit & flagged),
        "fn": F.count_if(hit & ~flagged),
        "tn": F.count_if(~hit & ~flagged),
    }


def _over(a: Column, b: Column) -> Column:
    """a / b, with a denominator of at least one."""
    return a / F.greatest(F.lit(1), b)


def rates(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """Precision, recall, F1, accuracy and FPR from tp, fp, fn, tn; empty denominators give 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = _over(tp, tp + fp), _over(tp, tp + fn)
    out = {
        "precision": prec,
        "recall": rec,
        "f1": 2 * prec * rec / F.greatest(F.lit(1e-9), prec + rec),
        "accuracy": _over(tp + tn, tp + fp + fn + tn),
        "fpr": _over(fp, fp + tn),
    }
    if digits is not None:
        out = {n: F.bround(e, digits) for n, e in out.items()}
    return counts.withColumns(out)


def confusion(
    rows: DataFrame,
    theta: float | Column,
    group: Sequence[str] = (),
    score: str = "risk",
    digits: int | None = None,
) -> DataFrame:
    """Confusion counts and rates; a score equal to θ counts as flagged."""
    cells = _cells(F.col("y"), F.col(score) >= theta)
    counts = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("y") == 1).alias("n_malicious"),
        *[e.alias(n) for n, e in cells.items()],
    )
    return rates(counts, digits)


def live_rates(rows: DataFrame, theta: float | Column, group=(), score: str = "risk") -> DataFrame:
    """Like `confusion`, but FPR is null without negatives and the rest null without positives."""
    cells = _cells(F.col("y"), F.col(score) >= theta)
    counts = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in cells.items()]
    )
    return _live_ratios(counts)


def _live_ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    some = (tp + fn) > 0
    prec = F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0))
    rec = tp / F.nullif(tp + fn, F.lit(0))
    return counts.withColumns(
        {
            "fpr": fp / F.nullif(fp + tn, F.lit(0)),
            "precision": F.when(some, prec),
            "recall": rec,
            "f1": F.when(
                some, F.coalesce(2 * prec * rec / F.nullif(prec + rec, F.lit(0.0)), F.lit(0.0))
            ),
        }
    )


def all_and_by(rows: DataFrame, theta: float | Column, by: str, score: str = "risk") -> DataFrame:
    """Live rates of each value of ``by`` and of all rows ("ALL")."""
    cells = _cells(F.col("y"), F.col(score) >= theta)
    counts = (
        rows.rollup(by)
        .agg(
            F.grouping(by).alias("_all"),
            F.count(F.lit(1)).alias("n"),
            *[e.alias(n) for n, e in cells.items()],
        )
        .withColumn(by, F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col(by)))
        .drop("_all")
    )
    return _live_ratios(counts)


def class_rates(rows: DataFrame, theta: float, normal: str = "Normal") -> DataFrame:
    """Detection rate per class; for the normal class the share that is not flagged."""
    right = F.when(F.col("true_class") == normal, F.col("risk") < theta).otherwise(
        F.col("risk") >= theta
    )
    return (
        rows.groupBy("true_class")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct"))
        .withColumn("rate", F.bround(_over(F.col("correct"), F.col("total")), 4))
    )


def group_report(
    rows: DataFrame, group: Sequence[str], theta: float, scores: Sequence[str] = ("risk",)
) -> DataFrame:
    """Per group: size, flagged rows, and the exact minimum, median and maximum of the scores."""
    extremes = [e(s).alias(f"{s}_{n}") for s in scores for n, e in (("min", F.min), ("max", F.max))]
    out = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk") >= theta).alias("flagged"), *extremes
    )
    for s in scores:
        out = out.join(medians(rows, group, s, f"{s}_median"), list(group))
    return out


def ranking(
    rows: DataFrame,
    group: Sequence[str],
    score: str = "risk",
    digits: int | None = None,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """ROC-AUC with averaged ties, average precision, extremes and margin, per group.

    Rows are reduced to one per distinct score before any ordering.
    """
    per = rows.groupBy(*group, F.col(score).alias("_s")).agg(
        F.count_if(F.col("y") == 1).alias("_pos"), F.count_if(F.col("y") == 0).alias("_neg")
    )
    placed, largest = number_rows(per, group, ["_s"], "_at", seg_rows)
    below = running(
        placed,
        group,
        "_at",
        {"_pb": Fold("sum", F.col("_pos")), "_nb": Fold("sum", F.col("_neg"))},
        largest,
        seg_rows,
    )
    total = per.groupBy(*group).agg(
        F.sum("_pos").alias("_p"),
        F.sum("_neg").alias("_n"),
        F.min(F.when(F.col("_pos") > 0, F.col("_s"))).alias("min_malicious_score"),
        F.max(F.when(F.col("_neg") > 0, F.col("_s"))).alias("max_benign_score"),
    )
    both = total.where("_p > 0 AND _n > 0")
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    above_pos = p - F.col("_pb")
    above = p + n - F.col("_pb") - F.col("_nb")
    keys = list(group)
    out = (
        below.join(both, keys)
        .groupBy(*keys, "_p", "_n", "min_malicious_score", "max_benign_score")
        .agg(
            F.sum(F.col("_pos") * (F.col("_nb") + F.col("_neg") / 2)).alias("_wins"),
            F.sum(F.col("_pos") * above_pos / above).alias("_ap"),
        )
        .withColumns({"roc_auc": F.col("_wins") / (p * n), "pr_auc": F.col("_ap") / p})
    )
    margin = F.col("min_malicious_score") - F.col("max_benign_score")
    cols = {"roc_auc": F.col("roc_auc"), "pr_auc": F.col("pr_auc"), "margin": margin}
    if digits is not None:
        cols = {c: F.bround(e, digits) for c, e in cols.items()}
    return out.withColumns(cols).select(
        *keys, "roc_auc", "pr_auc", "min_malicious_score", "max_benign_score", "margin"
    )


def threshold_sweep(
    rows: DataFrame, thetas: Sequence[float], group: Sequence[str] = (), score: str = "risk"
) -> DataFrame:
    """Confusion counts at every threshold, from one pass over the rows.

    Rows are counted by how many thresholds they reach; that small table is
    then summed up per threshold.
    """
    steps = F.array(*[F.lit(float(t)) for t in sorted(thetas)])
    reached = F.size(F.filter(steps, lambda t: t <= F.col(score)))
    per = rows.groupBy(*group, reached.alias("_reached")).agg(
        F.count_if(F.col("y") == 1).alias("_pos"), F.count_if(F.col("y") == 0).alias("_neg")
    )
    flagged = F.col("_reached") > F.col("_i")
    return (
        per.select("*", F.posexplode(steps).alias("_i", "theta"))
        .groupBy(*group, "theta")
        .agg(
            F.sum(F.col("_pos") + F.col("_neg")).alias("n"),
            F.sum(F.when(flagged, F.col("_pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(flagged, F.col("_neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(flagged, 0).otherwise(F.col("_pos"))).alias("fn"),
            F.sum(F.when(flagged, 0).otherwise(F.col("_neg"))).alias("tn"),
        )
    )


def tune_theta(
    rows: DataFrame,
    thetas: Sequence[float],
    group: Sequence[str] = (),
    score: str = "risk",
    max_fpr: float | None = None,
) -> DataFrame:
    """The middle one of the thresholds with the best F1; with ``max_fpr`` the lowest that keeps it."""
    swept = rates(threshold_sweep(rows, thetas, group, score))
    if max_fpr is not None:
        ok = swept.where(F.col("fpr") <= max_fpr)
        return ok.groupBy(*group).agg(
            F.min("theta").alias("theta"), F.min_by("f1", "theta").alias("f1")
        )
    marks = F.array_sort(F.collect_list(F.struct(F.round("f1", 12).alias("f1"), "theta")))
    best = F.filter("_m", lambda m: m["f1"] == F.element_at("_m", -1)["f1"])
    middle = F.element_at("_b", F.floor((F.size("_b") + 1) / 2).cast("int"))
    return (
        swept.groupBy(*group)
        .agg(marks.alias("_m"))  # one entry per threshold
        .withColumn("_b", best)
        .select(
            *group, middle["theta"].alias("theta"), middle["f1"].alias("f1"),
            F.size("_b").cast("long").alias("tied"),
        )
    )


def error_rows(rows: DataFrame, theta: float) -> DataFrame:
    """Missed malicious sessions and false alarms."""
    flagged = F.col("risk") >= theta
    kind = F.when((F.col("y") == 1) & ~flagged, F.lit("missed")).when(
        (F.col("y") == 0) & flagged, F.lit("false_alarm")
    )
    return rows.withColumn("error", kind).where(F.col("error").isNotNull())


def false_alarms(rows: DataFrame, theta: float, n: int, key: Sequence[str]) -> DataFrame:
    """The n false alarms of the highest risk."""
    wrong = rows.where((F.col("y") == 0) & (F.col("risk") >= theta))
    return wrong.orderBy(F.desc("risk"), *key).limit(n)


def holdout_parts(rows: DataFrame, family: str) -> DataFrame:
    """Rows labelled by report part: all, held-out family against benign, seen templates."""
    held = F.col("template") == family
    parts = F.array_compact(
        F.array(
            F.lit("all_test"),
            F.when(held | (F.col("y") == 0), F.lit("heldout_vs_benign")),
            F.when(~held, F.lit("seen_templates")),
        )
    )
    return rows.select("*", F.explode(parts).alias("part"))


def layers(rows: DataFrame, scores: Sequence[str]) -> DataFrame:
    """One row per scoring layer, to judge each layer alone and fused."""
    entries = F.array(
        *[F.struct(F.lit(s).alias("layer"), F.col(s).alias("layer_score")) for s in scores]
    )
    return rows.select("*", F.explode(entries).alias("_l")).select("*", "_l.*").drop("_l")


def mean_std(column: str) -> list[Column]:
    """Mean and sample deviation (0 for one value, null for none), rounded to 4 digits."""
    std = F.when(F.count(column) > 0, F.coalesce(F.stddev_samp(column), F.lit(0.0)))
    return [
        F.bround(F.avg(column), 4).alias(f"{column}_mean"), F.bround(std, 4).alias(f"{column}_std")
    ]


def fold_summary(runs: DataFrame, keys: Sequence[str] = SUMMARY_KEYS) -> DataFrame:
    """Per fold: mean and deviation of every metric over the seeds."""
    cols = [c for k in keys for c in mean_std(k)]
    return runs.groupBy("fold").agg(F.count(F.lit(1)).alias("seeds"), *cols)


def macro_summary(runs: DataFrame, keys: Sequence[str] = SUMMARY_KEYS) -> DataFrame:
    """Mean over folds of each seed that has all folds, then mean and deviation over seeds."""
    folds = runs.agg(F.countDistinct("fold").alias("_folds"))
    per_seed = (
        runs.groupBy("seed")
        .agg(F.countDistinct("fold").alias("_have"), *[F.avg(k).alias(k) for k in keys])
        .join(F.broadcast(folds), F.col("_have") == F.col("_folds"))  # one row
    )
    return per_seed.agg(
        F.count(F.lit(1)).alias("seeds"), *[c for k in keys for c in mean_std(k)]
    )


def pooled_confusion(runs: DataFrame) -> DataFrame:
    """Confusion counts summed over the folds of each seed."""
    return runs.groupBy("seed").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def config_summary(runs: DataFrame, config: str, metrics: Sequence[str]) -> DataFrame:
    """Config × metric: mean, deviation, minimum and maximum over the seeds."""
    long = runs.unpivot([config], list(metrics), "metric", "value")
    std = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    return (
        long.where(F.col("value").isNotNull())
        .groupBy(config, "metric")
        .agg(
            F.count(F.lit(1)).alias("seeds"),
            F.bround(F.avg("value"), 4).alias("mean"),
            F.bround(std, 4).alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


def timing_summary(timings: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Mean, median and maximum of every stage time."""
    long = timings.select(*group, *columns).unpivot(list(group), list(columns), "stage", "ms")
    keys = [*group, "stage"]
    out = long.where(F.col("ms").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("ms").alias("mean_ms"),
        F.max("ms").alias("max_ms"),
    )
    return out.join(medians(long, keys, "ms", "median_ms"), keys)


#: Size of a quantile sketch, and the error of the ranks it gives (0.7 % with 99 % confidence).
SKETCH_K, SKETCH_ERROR = 400, 0.01


def timing_sketches(times: DataFrame, group: Sequence[str], value: str = "ms") -> DataFrame:
    """Per group: number, sum, maximum and a quantile sketch of ``value``, which merge."""
    return times.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total_ms"),
        F.max(value).alias("max_ms"),
        F.kll_sketch_agg_double(value, SKETCH_K).alias("sketch"),
    )


def merge_sketches(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """`timing_sketches` of many batches as one."""
    return parts.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum("total_ms").alias("total_ms"),
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"),
    )


def sketch_summary(merged: DataFrame, ranks: dict[str, float] | None = None) -> DataFrame:
    """Mean, maximum and quantiles; a quantile's rank is right up to `SKETCH_ERROR`."""
    ranks = ranks or {"median_ms": 0.5, "p95_ms": 0.95}
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(r)).alias(n) for n, r in ranks.items()]
    kept = [c for c in merged.columns if c not in ("total_ms", "sketch")]
    return merged.select(*kept, (F.col("total_ms") / F.col("n")).alias("mean_ms"), *quantiles)
