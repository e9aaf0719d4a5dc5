import random

import pytest

from spoorline.operators.attribution import attribute
from tests.logs_fixture import a, frame, k, numbered, replay


def _pairs(df, **kw):
    return {(r.run_id, r.event_id): r.session_key for r in attribute(df, **kw).collect()}


def _random_log(rng, n, reparent):
    rows, home = [], {}
    for i in range(n):
        run = rng.choice("pq")
        ts = rng.randrange(600) / 4
        if rng.random() < 0.25:
            rows.append(a(ts, rng.choice([1, 2, 3]), run=run))
            continue
        pid = rng.randrange(0, 22)
        parent = rng.choice([0, max(pid - 1, 0), pid // 2, rng.randrange(22)])
        if not reparent:
            parent = home.setdefault((run, pid), parent)
        rows.append(k(ts, pid, parent, run=run))
    return numbered(rows)


@pytest.mark.parametrize("seed,reparent,seg", [(1, False, 1 << 20), (2, True, 1 << 20), (3, True, 7), (4, True, 16)])
def test_random_logs_match_a_replay(spark, seed, reparent, seg):
    rows = _random_log(random.Random(seed), 900, reparent)
    want = replay(rows)
    assert _pairs(frame(spark, rows), seg_rows=seg) == want
    assert any(r["source"] == "kernel" and (r["run_id"], r["event_id"]) in want for r in rows)


def test_edges_of_window_and_depth(spark):
    chain = [k(200 + i / 100, 100 + i, 99 + i if i else 50) for i in range(9)]
    rows = numbered(
        [k(10, 7), a(30, 7, run="r"), k(9.999, 7, run="s"), a(30, 7, run="s"), a(199, 50), *chain, k(300, 8), a(300, 8)]
    )
    got = _pairs(frame(spark, rows))
    assert got == replay(rows)
    by = {(r["run_id"], r["pid"], r["timestamp_unix"]): got.get((r["run_id"], r["event_id"])) for r in rows}
    assert by["r", 7, 10.0] == 7 and by["s", 7, 9.999] is None
    assert by["r", 106, 200.06] == 50 and by["r", 107, 200.07] is None
    assert by["r", 8, 300.0] == 8


def test_missing_session_id_falls_back_to_pid(spark):
    rows = numbered([a(1, 5, session_start_time=0), k(2, 6, 5)])
    rows[0]["session_id"] = None
    assert _pairs(frame(spark, rows)) == {("r", 0): 5, ("r", 1): 5}
