"""One stream takes slices as batches of their own; its state has no more partitions than cores."""

import json

from pyspark.sql import functions as F

from spoorline.functions.sqlfacts import FACTS
from spoorline.operators import graph
from spoorline.streaming import lineage, live
from spoorline.streaming.live import LiveEngine, raw_stream


class Counting(LiveEngine):
    def process(self, moves, batch):
        seen.append(moves.where(F.col("kind") == "event").count())
        parts.append(moves.rdd.getNumPartitions())


seen, parts = [], []


def test_slices_follow_each_other_in_one_stream(spark, tmp_path):
    seen.clear(), parts.clear()
    for log in ("kernel", "audit"):
        (tmp_path / log / "none" / "run=none").mkdir(parents=True)
    left = [0, 1, 2]

    def bring(_):
        if left:
            i = left.pop(0)
            folder = tmp_path / "audit" / f"slice={i}" / "run=a"
            row = {"session_id": 7, "backend_pid": 7, "timestamp": 100.0 + 10 * i, "event_type": "ExecutorStart", "query": "SELECT 1"}
            folder.mkdir(parents=True)
            (folder / "log.json").write_text(json.dumps(row) + "\n")

    bring(-1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        engine = Counting(spark, str(tmp_path / "out"))
        run = engine.start(f"{tmp_path}/kernel/*/*", f"{tmp_path}/audit/*/*", after=bring, processingTime="0 seconds")
        try:
            run.processAllAvailable()
        finally:
            run.stop()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [0, 1, 1]  # a slice's last row waits for the reorder delay
    assert set(parts) == {spark.sparkContext.defaultParallelism}


def test_a_row_may_name_its_run(spark, tmp_path):
    """One file of many hosts; rows without a name belong to their folder."""
    row = {"session_id": 7, "backend_pid": 7, "timestamp": 100.0, "event_type": "ExecutorStart", "query": "SELECT 1"}
    (tmp_path / "kernel" / "run=x").mkdir(parents=True)
    (tmp_path / "audit" / "run=c").mkdir(parents=True)
    lines = [{**row, "run_id": "a"}, {**row, "run_id": "b"}, row]
    (tmp_path / "audit" / "run=c" / "log.json").write_text("".join(json.dumps(r) + "\n" for r in lines))
    found = []
    stream = raw_stream(spark, f"{tmp_path}/kernel/*", f"{tmp_path}/audit/*")
    run = (
        stream.writeStream.foreachBatch(lambda df, _: found.extend(r.run_id for r in df.collect()))
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    assert sorted(found) == ["a", "b", "c"]


def test_a_table_without_rows_adds_no_tasks(spark, tmp_path):
    engine = LiveEngine(spark, str(tmp_path))
    like = spark.range(5).selectExpr("id AS n_events", "CAST(id AS STRING) AS run_id")
    for nothing in (engine._before("state/tail", 0, like), engine._grown("activity", 0, like)):
        assert nothing.schema == like.schema and nothing.count() == 0
        plan = nothing.unionByName(like)._jdf.queryExecution().optimizedPlan().toString()
        assert "RDD" not in plan and "Union" not in plan


class Calls:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]

    def iterator(self):
        return iter(list(self.rows.items()))


def test_neighbouring_keys_share_a_state_call():
    state = Calls()
    pages = lineage._Pages(state)
    for pid in range(1000, 1500):
        pages.set(pid, (pid - 1,))
    pages.flush()
    assert state.calls <= 6  # three pages, read and written
    again = lineage._Pages(state)
    assert [again.get(p) for p in (999, 1000, 1499, 1500)] == [None, (999,), (1498,), None]
    for pid in range(1000, 1500):
        again.set(pid, None)
    again.flush()
    assert state.rows == {}
    whole = lineage._Pages(state, whole=True)
    state.calls = 0
    assert whole.get(7) is None and whole.items() == [] and state.calls == 0


def test_drain_rows_do_not_cost_a_file_per_run(spark, tmp_path):
    engine = LiveEngine(spark, str(tmp_path))
    clocks = spark.range(50).selectExpr("'clock' AS kind", "concat('run_', id) AS run_id")
    engine._save(clocks, "moves", 0)
    engine.ask_drain()
    written = [p for p in (tmp_path / "control").rglob("*.json") if p.stat().st_size]
    assert len(written) == 1
    rows = [json.loads(line) for line in written[0].read_text().splitlines()]
    assert sorted(r["run_id"] for r in rows) == sorted(f"run_{i}" for i in range(50))
    assert {r["marker"] for r in rows} == {"DRAIN"}


def test_scores_wait_until_they_are_asked_for(spark, tmp_path):
    """Events and closes are written without scores; catching up gives those of an engine that scores at once."""
    row = {"run_id": "a", "session_id": 7, "backend_pid": 7, "event_type": "ExecutorStart", "query": "SELECT * FROM customers"}
    for log in ("kernel", "audit"):
        (tmp_path / log / "none").mkdir(parents=True)
    got = {}
    engines = {s: LiveEngine(spark, str(tmp_path / f"out_{s}"), scoring=s) for s in (True, False)}
    for i in range(2):
        (tmp_path / "audit" / "none" / f"{i}.json").write_text(json.dumps({**row, "timestamp": 100.0 + 30 * i}) + "\n")
        for engine in engines.values():
            engine.take(f"{tmp_path}/kernel/*", f"{tmp_path}/audit/*")
    for scoring, engine in engines.items():
        engine.finish(f"{tmp_path}/kernel/*", f"{tmp_path}/audit/*")
        assert engine.table("closes").count() == 1
        assert (tmp_path / f"out_{scoring}" / "scored").exists() == scoring
        engine.catch_up()
        both = engine.table("scores").unionByName(engine.table("rescores"))
        got[scoring] = sorted(tuple(r) for r in both.select("session_key", "opened", "n_events", "risk", "behaviors", "final").collect())
    assert got[True] == got[False] and len(got[True]) == 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_increments_move_attributes_once_and_edges_join_nothing(spark):
    text = {c: "CAST(NULL AS STRING)" for c in [*graph.ATTRS, *FACTS]}
    text |= {
        "source": "'kernel'", "event_id": "id", "pid": "id % 3 + 1", "ppid": "0L", "syscall": "'openat'",
        "arg": "concat('/tmp/', id % 5)", "dest_port": "0L", "comm": "concat('c', id)",
    }
    more = {
        "run_id": "concat('r', id % 2)", "session_key": "7L", "seq": "id", "timestamp_unix": "double(id div 2)",
        "resolved_at": "id", "waited": "false", "settled": "id < 20", "query_id": "CAST(NULL AS BIGINT)",
        "parent_pid": "CAST(NULL AS BIGINT)", "spawn_query": "CAST(NULL AS BIGINT)",
    }
    events = spark.range(40).selectExpr(*[f"{e} AS {n}" for n, e in (text | more).items()])
    nodes, edges = live.node_increments(events), live.edge_increments(events)
    assert "SortAggregate" not in _plan(nodes)  # no attributes among what is aggregated
    assert "Join" not in _plan(edges)
    got = {(r.run_id, r.node_type, r.node_key, r.settled): (r.first.event_id, r.attrs.comm, r.mentions, r.last_ts) for r in nodes.collect()}
    want = {}
    for i in range(40):
        for kind, key in (("Process", str(i % 3 + 1)), ("File", f"/tmp/{i % 5}")):
            at = (f"r{i % 2}", kind, key, i < 20)
            first, comm, n, _ = want.get(at, (i, f"c{i}", 0, 0.0))
            want[at] = (first, comm, n + 1, float(i // 2))
    assert got == want
    ids = sorted(i for r in edges.collect() for i in r.event_ids)
    assert ids == list(range(40)) and {r.settled for r in edges.collect()} == {True, False}
    kept = live.lean(nodes).schema["attrs"].dataType.names
    assert kept == live.MATCHED
