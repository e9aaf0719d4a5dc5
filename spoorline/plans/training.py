"""Many session scorers in one job: one logistic regression per fold and seed.

All models take the same Newton step at the same time. A step is one aggregation over the
session rows, keyed by (fold, seed): the sums of gradient and second derivatives. A row
belongs to the training part of most folds, so it is repeated inside the aggregation, where sums are
kept per task; the repeated rows are neither written nor shuffled. Only the sums, one row a model,
come to the driver, which solves the small systems and gives the weights back as a table.

The number of folds is that of malicious templates, the number of seeds a parameter, that of
features fixed by the caller; none of them grows with the sessions. A seed stands for the sample of
training rows that a model sees (``in_sample``), as the fit itself has no chance in it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.operators.risk import MODEL_WEIGHT, RULE_WEIGHT, fuse
from spoorline.plans import evaluation as E
from spoorline.session import materialize

MODEL = ["fold", "seed"]
L2 = 0.01


def fold_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row in each fold, with its part: test or val as `splits.rotated_folds` says, else train."""
    entry = F.struct("fold", "part")
    own = folds.groupBy("template").agg(F.map_from_entries(F.collect_list(entry)).alias("_own"))  # one a fold
    names = folds.agg(F.array_sort(F.collect_set("fold")).alias("_folds"), F.lit(1).alias("_one"))
    held = rows.join(own, "template", "left").withColumn("_one", F.lit(1)).join(F.broadcast(names), "_one")  # one row of names
    part = F.coalesce(F.element_at("_own", F.col("fold")), F.lit("train"))
    return held.withColumn("fold", F.explode("_folds")).withColumn("part", part).drop("_own", "_folds", "_one")


def _dot(features: Sequence[str]) -> Column:
    total = F.get("w", F.lit(0))
    for i, f in enumerate(features, 1):
        total = total + F.get("w", F.lit(i)) * F.col(f)
    return total


def probability(features: Sequence[str]) -> Column:
    """Of class 1, from ``w`` (intercept first) and the features."""
    return 1.0 / (1.0 + F.exp(-_dot(features)))


def train_models(
    rows: DataFrame, features: Sequence[str], l2: float = L2, steps: int = 25, tolerance: float = 1e-10
) -> DataFrame:
    """fold, seed and weights ``w`` of the models of ``rows`` (fold, seed, y, features).

    The mean loss with a ridge on all weights but the intercept. Models of one class only are left out.
    """
    spark = rows.sparkSession
    d = len(features) + 1
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    p = probability(features)
    error, curve = p - F.col("y"), p * (1.0 - p)
    places = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.avg(error * x[i]).alias(f"g{i}") for i in range(d)]
    sums += [F.avg(curve * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in places]
    both = rows.groupBy(*MODEL).agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo < hi")
    weights = {tuple(r): np.zeros(d) for r in both.select(*MODEL).collect()}  # folds times seeds
    ridge = np.diag([0.0] + [l2] * (d - 1))
    kind = rows.select(*MODEL).schema

    def table() -> DataFrame:
        data = [(*k, w.tolist()) for k, w in weights.items()]
        return spark.createDataFrame(data, f"fold {kind['fold'].dataType.simpleString()}, seed {kind['seed'].dataType.simpleString()}, w array<double>")

    for _ in range(steps):
        moved = 0.0
        for r in rows.join(F.broadcast(table()), MODEL).groupBy(*MODEL).agg(*sums).collect():
            w = weights[r.fold, r.seed]
            gradient = np.array([r[f"g{i}"] for i in range(d)]) + ridge @ w
            hessian = np.zeros((d, d))
            for i, j in places:
                hessian[i, j] = hessian[j, i] = r[f"h{i}_{j}"]
            step = np.linalg.solve(hessian + ridge, gradient)
            weights[r.fold, r.seed] = w - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return table()


def fold_scores(
    rows: DataFrame,
    folds: DataFrame,
    features: Sequence[str],
    seeds: Sequence[int],
    in_sample: Column,
    l2: float = L2,
    w_rule: float = RULE_WEIGHT,
    w_model: float = MODEL_WEIGHT,
) -> tuple[DataFrame, DataFrame]:
    """Trained weights, and the test and validation rows of each model with `gat_score` and `risk`.

    ``rows`` have template, y, rule_score and the features; ``in_sample`` may use their columns and ``seed``.
    """
    # every step of the fit reads both again
    every = fold_rows(materialize(rows, "fold-rows"), materialize(folds, "folds"))
    seed = F.explode(F.array(*[F.lit(s) for s in seeds]))
    every = every.withColumn("seed", seed)
    weights = train_models(every.where("part = 'train'").where(in_sample), features, l2)
    judged = every.where("part <> 'train'").join(F.broadcast(weights), MODEL)
    judged = judged.withColumn("gat_score", probability(features)).drop("w")
    return weights, judged.withColumn("risk", fuse(F.col("rule_score"), F.col("gat_score"), w_rule, w_model))


def fold_reports(judged: DataFrame, thetas: Sequence[float]) -> DataFrame:
    """Per fold and seed: θ tuned on the validation rows, and rates of the test rows at it."""
    judged = materialize(judged, "fold-scores")
    tuned = E.tune_theta(judged.where("part = 'val'"), thetas, MODEL).select(*MODEL, "theta")
    test = judged.where("part = 'test'")
    counts = E.confusion(test.join(tuned, MODEL), F.col("theta"), [*MODEL, "theta"])
    return counts.join(E.ranking(test, MODEL), MODEL, "left")
