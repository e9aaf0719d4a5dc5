import random
import statistics

import pytest

from spoorline.plans import evaluation as E
from spoorline.plans import live, splits
from spoorline.plans.prefixes import prefix_points


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(2), rng.randrange(12) / 10) for _ in range(80)]
    data += [("one", 1, 0.5), ("one", 1, 0.7)]
    return data, spark.createDataFrame(data, "g string, y long, risk double")


@pytest.mark.parametrize("seg", [3, 1 << 20])
def test_ranking_against_pairs(rows, seg):
    data, df = rows
    got = {r.g: r for r in E.ranking(df, ["g"], seg_rows=seg).collect()}
    assert set(got) == {"a", "b"}  # one class only has no ranking
    for g in "ab":
        pos = [s for h, y, s in data if h == g and y]
        neg = [s for h, y, s in data if h == g and not y]
        auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        ap, seen = 0.0, 0
        for t in sorted({s for h, _, s in data if h == g}, reverse=True):
            tp, flagged = sum(p >= t for p in pos), sum(s >= t for s in pos + neg)
            ap += (tp - seen) / len(pos) * tp / flagged
            seen = tp
        assert got[g].roc_auc == pytest.approx(auc) and got[g].pr_auc == pytest.approx(ap)


def test_sweep_counts_ties_as_flagged(rows):
    data, df = rows
    for r in E.threshold_sweep(df, [0.2, 0.5, 0.9]).collect():
        assert r.tp == sum(y == 1 and s >= r.theta for _, y, s in data)
        assert r.tn == sum(y == 0 and s < r.theta for _, y, s in data)


def test_tuning_takes_the_middle(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.1)], "y long, risk double")
    assert E.tune_theta(df, [i / 20 for i in range(1, 20)]).first().theta == 0.45


def test_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0.1)], "y long, risk double")
    r = E.confusion(df, 0.5).first()
    assert (r.precision, r.recall, r.f1, r.accuracy, r.fpr) == (0, 0, 0, 1, 0)
    r = E.live_rates(df, 0.5).first()
    assert (r.precision, r.recall, r.f1, r.fpr) == (None, None, None, 0)
    r = E.live_rates(df.withColumn("y", df.y + 1), 0.5).first()
    assert (r.precision, r.recall, r.f1, r.fpr) == (0, 0, 0, None)


def test_summaries(spark):
    runs = [("f", 1, 0.5), ("f", 2, 0.7), ("g", 1, 0.1)]
    df = spark.createDataFrame(runs, "fold string, seed long, recall double")
    per = {r.fold: r for r in E.fold_summary(df, ["recall"]).collect()}
    assert per["f"].recall_std == pytest.approx(statistics.stdev([0.5, 0.7]), abs=1e-4)
    assert per["g"].recall_std == 0
    macro = E.macro_summary(df, ["recall"]).first()
    assert (macro.seeds, macro.recall_mean, macro.recall_std) == (1, 0.3, 0)


def test_live_labels_and_duplicates(spark):
    scores = spark.createDataFrame([(1, 0.2, 0), (1, 0.9, 5), (2, 0.4, 1), (3, 0.4, 1)], "session_id long, risk double, pos long")
    last = live.last_per_session(scores, "session_id", "pos")
    labels = spark.createDataFrame([(1, "Malicious:k1"), (2, "Benign")], "session_id long, label string")
    plan = spark.createDataFrame([("k1", "bank_x_0007", []), ("k9", "bank_y_1", ["e"])], "key string, scenario_id string, errors array<string>")
    got = {r.session_id: (r.y, r.source, r.family, r.risk) for r in live.live_verdicts(last, labels, plan).collect()}
    assert got == {1: (1, "scenario", "bank_x", 0.9), 2: (0, "other", "", 0.4)}
    gaps = {(r.problem, r.item) for r in live.coverage(last, labels, plan).collect()}
    assert gaps == {("unlabelled", "3"), ("never_scored", "k9"), ("errors", "k9")}


def test_prefix_points(spark):
    from pyspark.sql import functions as F

    for most, pad in ((3, 2), (5, 0), (2, 2), (6, 1)):
        got = spark.range(0, 30).select("id", prefix_points(F.col("id").cast("int"), most, pad).alias("k")).collect()
        for r in got:
            want = [i for i in range(1, pad + 1) if i < r.id]
            rest, room = list(range(pad + 1, r.id)), most - len(want)
            if room > 0 and rest:
                step = len(rest) / room
                picks = [rest[min(len(rest) - 1, int(i * step + step / 2))] for i in range(room)]
                want += sorted(set(picks))
            assert r.k == want[:most], (r.id, most, pad)


def test_splits_fail_on_bad_input(spark):
    df = spark.createDataFrame([("only",)], "family string")
    none = df.limit(0)
    with pytest.raises(Exception, match="fewer than two families"):
        splits.family_disjoint(df, none).collect()
    labels = spark.createDataFrame([(1,)], "pid long")
    with pytest.raises(Exception, match="no family for 1"):
        splits.with_family(labels, spark.createDataFrame([], "pid long, family string"), ["pid"]).collect()


def test_repeated_rows_give_one_verdict(spark):
    scores = spark.createDataFrame([(1, 0.2, 0), (1, 0.9, 5)], "session_id long, risk double, pos long")
    labels = spark.createDataFrame([(1, "Malicious:k1"), (1, "Malicious:k1")], "session_id long, label string")
    plan = spark.createDataFrame([("k1", "bank_x_7"), ("k1", "bank_x_7")], "key string, scenario_id string")
    got = [(r.session_id, r.y, r.family, r.risk) for r in live.live_verdicts(scores, labels, plan).collect()]
    assert got == [(1, 1, "bank_x", 0.9)]
