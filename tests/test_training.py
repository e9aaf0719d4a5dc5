"""Models of all folds and seeds at once against single fits."""

import numpy as np
from pyspark.sql import functions as F

from spoorline.plans import training as T


def single_fit(x, y, l2):
    """Plain Newton on one model until nothing moves."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [l2] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(x) + ridge, x.T @ (p - y) / len(x) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-12:
            return w
    raise AssertionError("no end")


def rows(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = (x @ [1.5, -1.0, 0.3] + rng.normal(size=n) > 0).astype(int)
    template = [f"t{int(v) * 4 + i % 4}" for i, v in enumerate(y)]
    data = [(i, t, int(v), 0.1, *map(float, r)) for i, (t, v, r) in enumerate(zip(template, y, x, strict=True))]
    return spark.createDataFrame(data, "id long, template string, y int, rule_score double, a double, b double, c double")


FOLDS = [("f0", "t4", "test"), ("f0", "t0", "test"), ("f0", "t5", "val"), ("f0", "t1", "val"), ("f1", "t5", "test"), ("f1", "t1", "test"), ("f1", "t6", "val")]


def test_all_models_equal_single_fits(spark):
    df = rows(spark)
    folds = spark.createDataFrame(FOLDS, "fold string, template string, part string")
    weights, judged = T.fold_scores(df, folds, ["a", "b", "c"], [0, 1], F.expr("(id + seed) % 4 <> 0"), 0.05)
    got = {(r.fold, r.seed): r.w for r in weights.collect()}
    assert len(got) == 4
    plain = df.collect()
    for (fold, seed), w in got.items():
        out = {t for f, t, _ in FOLDS if f == fold}
        some = [r for r in plain if r.template not in out and (r.id + seed) % 4]
        want = single_fit(np.array([[r.a, r.b, r.c] for r in some]), np.array([r.y for r in some]), 0.05)
        assert np.abs(np.array(w) - want).max() < 1e-6
    scored = judged.collect()
    assert {(r.fold, r.template, r.part) for r in scored} == set(FOLDS)
    r = scored[0]
    z = got[r.fold, r.seed] @ np.array([1, r.a, r.b, r.c])
    assert abs(r.gat_score - 1 / (1 + np.exp(-z))) < 1e-9
    assert abs(r.risk - (1 - (1 - 0.75 * 0.1) * (1 - 0.75 * r.gat_score))) < 1e-9
    reports = T.fold_reports(judged, [0.3, 0.5, 0.7])
    assert {(r.fold, r.seed) for r in reports.collect()} == set(got)


def test_models_of_one_class_are_left_out(spark):
    df = rows(spark).withColumn("y", F.lit(1)).withColumn("fold", F.lit("f")).withColumn("seed", F.lit(0))
    assert T.train_models(df, ["a"]).count() == 0
