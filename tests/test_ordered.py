import random

import pytest
from pyspark.sql import functions as F

from spoorline.functions.ordered import Fold, medians, number_rows, running
from spoorline.functions.text import sequence_fingerprint


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab"), i, rng.randrange(5) if rng.random() < 0.4 else None) for i in range(60)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "g string, t long, v long")


@pytest.mark.parametrize("seg", [4, 1000])
@pytest.mark.parametrize("reverse", [False, True])
def test_numbers_and_running_values(rows, seg, reverse):
    data, df = rows
    placed, largest = number_rows(df, ["g"], ["t"], "seq", seg)
    assert largest == max(sum(r[0] == g for r in data) for g in "ab")
    folds = {
        "s": Fold("sum", F.col("v"), inclusive=True),
        "l": Fold("last", F.col("v")),
        "m": Fold("max", F.col("v")),
        "n": Fold("min", F.col("v"), inclusive=True),
    }
    got = {
        (r.g, r.t): (r.seq, r.s, r.l, r.m, r.n)
        for r in running(placed, ["g"], "seq", folds, largest, seg, reverse).collect()
    }
    assert len(got) == len(data)
    for g in "ab":
        mine = sorted((r for r in data if r[0] == g), key=lambda r: r[1])
        index = {r[1]: i for i, r in enumerate(mine)}
        past = []
        for r in reversed(mine) if reverse else mine:
            known = [x for x in past if x is not None]
            upto = known + ([r[2]] if r[2] is not None else [])
            want = (
                index[r[1]], sum(upto), known[-1] if known else None,
                max(known) if known else None, min(upto) if upto else None,
            )
            assert got[g, r[1]] == want
            past.append(r[2])


@pytest.mark.parametrize("seg", [3, 1000])
def test_medians(rows, seg):
    import statistics

    data, df = rows
    got = {r.g: r.m for r in medians(df, ["g"], "v", "m", seg).collect()}
    for g in "ab":
        assert got[g] == statistics.median([r[2] for r in data if r[0] == g and r[2] is not None])


def test_fingerprints_of_long_groups(spark):
    words = [("x", i, f"w{i % 7}") for i in range(50)] + [("y", i, f"w{i % 7}") for i in range(50)]
    words += [("z", i, f"w{i % 7}") for i in range(49)] + [("o", 0, "w0"), ("p", 5, "w0")]
    df = spark.createDataFrame(words, "g string, t long, q string")
    found = []
    for seg in (3, 8, 1000):
        out = sequence_fingerprint(df, ["g"], ["t"], {"fp": F.col("q")}, seg).collect()
        fp = {r.g: r.fp for r in out}
        assert fp["x"] == fp["y"] != fp["z"] and fp["o"] == fp["p"] and len(fp) == 5
        found.append(fp)
    assert found[0] == found[1] == found[2]  # the same value at every size of a segment
