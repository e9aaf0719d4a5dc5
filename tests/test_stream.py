"""The live engine: slices of logs against a replay, life cycle of sessions, increments against rebuilt graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spoorline.functions.ordered import number_rows
from spoorline.operators import behaviors as B
from spoorline.operators import graph
from spoorline.operators.attribution import SESSION
from spoorline.streaming.lineage import Rules
from spoorline.streaming.live import ORDER, LiveEngine


def _lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def _kernel(s, pid, ppid, **more):
    return {"pid": pid, "ppid": ppid, "uid": 0, "timestamp": int(s * 1e9), "comm": "sh", "syscall": "execve", "arg": "x", **more}


def _audit(ts, sid, query="SELECT * FROM customers", event_type="ExecutorStart"):
    return {"session_id": sid, "backend_pid": sid, "session_start_time": 0, "timestamp": ts, "event_type": event_type, "query": query}


def start(ts):
    return {"marker": "LOGGING_START", "timestamp": ts}


def end(ts, sid):
    return {"marker": "SESSION_END", "backend_pid": sid, "timestamp": ts}


RULES = Rules(idle_s=30.0, forget_s=100.0, quiet_s=150.0)
#: The number of the file, in minutes; a drain comes last.
ARRIVAL = "timestamp_seconds(60 * coalesce(try_cast(regexp_extract(file, '^([0-9]+)[.]', 1) AS bigint), 9) + 1)"


class Host:
    """Slices of runs, followed one after another."""

    def __init__(self, spark, root):
        self.root, self.n = root, 0
        self.engine = LiveEngine(spark, str(root / "out"), theta=0.2, rules=RULES, compact=2)
        for name in ("kernel", "audit"):
            _lines(root / "in" / name / "none" / "0.json", [])
        self.paths = [f"{root}/in/{name}/*" for name in ("kernel", "audit")]

    def slice(self, **runs):
        for run, (kernel, audit) in runs.items():
            _lines(self.root / "in" / "kernel" / run / f"{self.n}.json", kernel)
            _lines(self.root / "in" / "audit" / run / f"{self.n}.json", audit)
        self.n += 1
        self.engine.take(*self.paths, F.expr(ARRIVAL))

    def finish(self):
        self.engine.finish(*self.paths, F.expr(ARRIVAL))

    def rows(self, name, run, *columns):
        return sorted(tuple(r) for r in self.engine.table(name).where(F.col("run_id") == run).select(*columns).collect())


def _random_log(seed, n=260):
    random.seed(seed)
    rng = random.Random(seed)
    texts = ["SELECT * FROM customers", "TRUNCATE audit_logs", "COPY accounts TO PROGRAM 'sh'", "SELECT 1"]
    kernel, audit, t = [(0.0, start(100.0))], [], 0.0
    for i in range(n):
        t += rng.choice([0.0, 0.1, 0.7, 3.0])
        if i == n // 2:
            kernel.append((t, start(100.0 + t)))
        shift = 1000 if i >= n // 2 else 0  # the second boot counts from elsewhere
        if rng.random() < 0.6:
            call = rng.choice(["execve", "openat", "connect"])
            more = {"dest_ip": "10.0.0.1", "dest_port": 80} if call == "connect" else {}
            parent = rng.choice([0, 50, 51, 52, *range(60, 75)])
            kernel.append((t, _kernel(shift + t, rng.randrange(60, 75), parent, syscall=call, comm=rng.choice(["gzip", "curl"]), arg=f"/tmp/{i % 4}", **more)))
        else:
            kind = rng.choice(["ExecutorStart", "ExecutorEnd"])
            audit.append((t, _audit(100.0 + t, rng.choice([50, 51, 52]), rng.choice(texts), kind)))
    return kernel, audit


SLICES = 5


def _slices(kernel, audit):
    last = max(t for t, _ in kernel + audit)
    cuts = [-1.0, *sorted(random.Random(7).uniform(0, last) for _ in range(SLICES - 1)), last + 1]
    pairs = zip(cuts, cuts[1:], strict=False)
    return [tuple([r for t, r in log if low <= t < high] for log in (kernel, audit)) for low, high in pairs]


@pytest.fixture(scope="module")
def host(spark, tmp_path_factory):
    """Five slices of seven hosts, then the drain; beside the drain what stood before it."""
    h = Host(spark, tmp_path_factory.mktemp("live"))
    copy = "COPY (SELECT * FROM customers) TO PROGRAM 'sh'"
    send = {"syscall": "connect", "dest_ip": "10.0.0.1", "dest_port": 80}
    runs = {
        # session 50 ends and its pid is used again
        "one": [
            ([start(100.0), _kernel(0, 900, 1), _kernel(1, 60, 50), _kernel(2, 61, 60)], [_audit(103.0, 50), _audit(103.5, 51)]),
            ([_kernel(8, 62, 61, **send), _kernel(9, 70, 60), end(112.0, 50)], [_audit(107.0, 50, copy), _audit(107.5, 51)]),
            ([_kernel(12.2, 64, 50), _kernel(19, 70, 51), _kernel(20.5, 63, 62)], [_audit(121.0, 51)]),
            ([_kernel(40, 80, 50)], [_audit(139.0, 50), _audit(141.0, 51)]),
        ],
        # an event shows up behind the end of its session
        "late": [
            ([start(100.0), _kernel(0, 9, 1), end(104.0, 50)], [_audit(101.0, 50), _audit(106.0, 7)]),
            ([], [_audit(104.8, 50), _audit(120.0, 7)]),
        ],
        # clocks hours apart: nothing is released, expired or closed early
        "fast": [([], [_audit(10_000.0, 7), _audit(10_001.0, 7)]), ([], [_audit(10_030.0, 7)]), ([], [_audit(10_100.0, 8), _audit(10_102.0, 8)])],
        "slow": [
            ([start(100.0), _kernel(0, 900, 1), _kernel(1, 60, 50)], [_audit(100.5, 50)]),
            ([_kernel(2, 61, 60)], [_audit(101.5, 50), _audit(103.5, 50)]),
            ([], [_audit(104.0, 50)]), ([], [_audit(104.5, 50)]), ([], [_audit(104.6, 50)]),
        ],
        # an idle session goes on, and is forgotten at last
        "idle": [([], [_audit(ts, sid)]) for ts, sid in ((100.0, 7), (140.0, 7), (180.0, 7), (300.0, 8), (301.0, 7))],
        "silent": [([], [_audit(100.0, 7)])],
        "random": _slices(*_random_log(1)),
    }
    for i in range(SLICES):
        h.slice(**{run: slices[i] for run, slices in runs.items() if i < len(slices)})
    h.early = {run: h.rows("scores", run, "session_key", "reason", "n_events") for run in runs}
    h.finish()
    return h


def test_attribution_follows_ends(host):
    got = host.rows("attributed", "one", "pid", F.round("timestamp_unix", 3), "session_key", "opened")
    opened = {k: sorted({o for _, _, s, o in got if s == k}) for k in (50, 51)}
    assert len(opened[50]) == 2 and len(opened[51]) == 1
    kernel = {(p, t): (s, opened[50].index(o) if s == 50 else 0) for p, t, s, o in got if p not in (50, 51)}
    assert kernel == {
        (60, 101.0): (50, 0), (61, 102.0): (50, 0), (62, 108.0): (50, 0), (70, 109.0): (50, 0),
        (64, 112.2): (50, 0), (70, 119.0): (51, 0), (63, 120.5): (50, 1), (80, 140.0): (50, 1),
    }
    # 900 has no session; 63's had ended, and it waited for the next one of that pid


def test_final_scores_and_alerts(host):
    finals = host.rows("scores", "one", "session_key", "opened", "n_events", "reason")
    assert [(s, n, r) for s, _, n, r in finals] == [(50, 7, "end"), (50, 3, "drain"), (51, 5, "drain")]
    alerts = host.rows("alerts", "one", "session_key", "opened")
    assert alerts == [(50, 3)]  # once, though it was scored again
    assert host.engine.table("alerts").where("detection_latency_s IS NULL").count() == 0
    times = {r.stage: r for r in host.engine.timing_summary().collect()}
    assert set(times) == {"attribution", "graphs", "scores", "detection_latency"}
    assert times["graphs"].n == SLICES + 1 and 0 < times["graphs"].median_ms <= times["graphs"].max_ms
    assert times["detection_latency"].n == host.engine.table("alerts").count()


def test_late_events_are_reported(host):
    assert host.rows("late", "late", "session_key", F.round("timestamp_unix", 1)) == [(50, 104.8)]
    assert host.rows("closes", "late", "session_key", "n_events", "reason") == [(7, 2, "drain"), (50, 1, "drain"), (50, 1, "end")]


def test_hosts_keep_their_own_time(host):
    assert host.early["fast"] == [(7, "idle", 3)] and host.early["slow"] == []
    assert host.rows("scores", "fast", "session_key", "n_events") == [(7, 3), (8, 2)]
    assert host.rows("scores", "slow", "session_key", "n_events") == [(50, 8)]


def test_an_idle_session_goes_on_and_is_forgotten_at_last(host):
    closes = host.rows("closes", "idle", "session_key", "opened", "n_events", "reason")
    assert closes == [(7, 0, 1, "idle"), (7, 0, 2, "idle"), (7, 0, 3, "forgotten"), (7, 0, 3, "idle"), (7, 4, 1, "drain"), (8, 3, 1, "drain")]


def test_a_silent_host_closes_by_the_arrival_of_others(host):
    assert host.early["silent"] == [(7, "idle", 1)]


def test_any_slicing_gives_the_same_and_the_rebuilt_graphs(spark, host, tmp_path):
    one = Host(spark, tmp_path)
    one.slice(random=tuple([r for _, r in log] for log in _random_log(1)))
    one.finish()
    columns = ["pid", "event_id", "resolved_at", "session_key", "opened", F.round("timestamp_unix", 6)]
    assert one.rows("attributed", "random", *columns) == host.rows("attributed", "random", *columns)
    finals = ["session_key", "n_events", "n_nodes", F.round("risk", 9), "scenario", "behaviors"]
    last = {r[0]: r for r in one.rows("scores", "random", *finals)}
    assert last == {r[0]: r for r in host.rows("scores", "random", *finals)} and len(last) == 3
    # the batch chain over the events that were attributed
    rows = host.engine.table("attributed").where("run_id = 'random'")
    rows = rows.withColumn("waited", F.col("resolved_at") != F.col("event_id"))
    graphs = graph.build_graphs(number_rows(rows, SESSION, ORDER, "seq")[0])
    sizes = {r.session_key: r["count"] for r in graphs.nodes.groupBy("session_key").count().collect()}
    found = B.behaviors(graphs.nodes, graphs.edges).found.groupBy("session_key")
    kinds = {r.session_key: r.b for r in found.agg(F.array_sort(F.collect_set("behavior")).alias("b")).collect()}
    assert {k: r[2] for k, r in last.items()} == sizes
    assert {k: r[5] for k, r in last.items() if r[5]} == kinds
    # pages hold the ids of all folded events of an edge
    pages = host.engine.table("pages").where("run_id = 'random'").select(F.explode("event_ids")).count()
    assert 0 < pages <= graphs.links.count()
