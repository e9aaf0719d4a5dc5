"""Starts of sessions inside one spec."""

import json

from spoorline.plans import quality
from spoorline.sources import logs


def spec(no, *sessions):
    rows = [
        {"session_label": label, "concurrent_with": beside, "delay_after_previous_seconds": 1.0,
         "timing": {"tempo": "steady", "step_gaps_seconds": [2.0, 4.0]},
         "events": [{"step_id": f"e{i}", "sql": "SELECT 1"} for i in range(n)]}
        for label, n, beside in sessions
    ]
    return "r", json.dumps({"scenario_id": f"s{no}", "time_of_day": "00:01", "sessions": rows})


def starts(spark, *specs):
    df = quality.session_starts(logs.json_specs(spark.createDataFrame(list(specs), "run_id string, text string")))
    return df, {(r.scenario_id, r.session_no): (r.start_s, r.error is None) for r in df.collect()}


def test_chains_rings_and_odd_names(spark):
    chain = [("a", 5, None)] + [(f"c{i}", 5, "a" if i == 0 else f"c{i - 1}") for i in range(9)]
    _, got = starts(
        spark,
        spec(0, *chain),
        spec(1, ("x", 3, "y"), ("y", 3, "x"), ("z", 3, "x"), ("me", 3, "me"), ("w", 3, None)),
        spec(2, ("a", 3, None), ("a", 1, None), ("b", 1, "a"), ("c", 1, "nobody"), (None, 0, None), ("d", 1, None)),
        ("r", json.dumps({"scenario_id": "s3", "time_of_day": "00:01", "sessions": []})),
        ("r", "no spec"),
    )
    want = {("s0", 0): (60.0, True)} | {("s0", i): (60.0 + 6.0 * i, True) for i in range(1, 10)}
    want |= {("s1", i): (None, False) for i in range(4)} | {("s1", 4): (61.0, True)}
    want |= {("s2", 0): (60.0, True), ("s2", 1): (67.0, True), ("s2", 2): (63.0, True), ("s2", 3): (67.0, True)}
    want |= {("s2", 4): (68.0, True), ("s2", 5): (69.0, True)}
    assert got == want


def test_specs_of_one_name_do_not_mix(spark):
    a = spec(0, ("a", 3, None), ("b", 1, "a"))
    _, got = starts(spark, a, spec(1, ("b", 1, None)))
    df, _ = starts(spark, a, a)
    assert got["s0", 1] == (63.0, True) and df.count() == 4


def test_schedule_stays_in_the_row_and_parses_once(spark):
    df, _ = starts(spark, spec(0, ("a", 3, None), ("b", 1, "a")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("from_json") == 1
