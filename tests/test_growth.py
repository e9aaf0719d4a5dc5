"""Work that must not grow faster than the rows: files, repeated reads, repeated texts."""

import glob

from pyspark.sql import functions as F

from spoorline.functions.sqlfacts import FACTS, join_statement_facts, with_statement_facts
from spoorline.operators import behaviors as B
from spoorline.operators import features
from spoorline.operators.attribution import attribute, attributed_events
from spoorline.operators.graph import build_graphs
from spoorline.plans import prefixes, training
from spoorline.sources import logs
from spoorline.sources.tables import Capture
from tests.logs_fixture import a, frame, k, numbered

RUNS = 60


def _capture(spark):
    ids = spark.range(RUNS * 3)
    run = F.concat(F.lit("run_"), (F.col("id") % RUNS).cast("string")).alias("run_id")
    pos = F.col("id").alias("pos")
    kernel = ids.select(run, pos, (F.col("id") + 9007199254740993).alias("timestamp"), F.col("id").alias("pid"))
    for name in ("ppid", "uid", "dest_port"):
        kernel = kernel.withColumn(name, F.lit(1).cast("long"))
    for name in ("comm", "syscall", "arg", "dest_ip"):
        kernel = kernel.withColumn(name, F.lit("x"))
    audit = ids.select(run, pos, F.col("id").cast("double").alias("timestamp"), F.col("id").alias("session_id"))
    starts = ids.limit(RUNS)
    control = starts.select(run, F.lit(-1).cast("long").alias("pos"), F.lit("LOGGING_START").alias("marker"), F.lit(0.5).alias("timestamp"))
    sync = starts.select(run, F.lit(1.5).alias("server_boot_unix_time"))
    return Capture(kernel, audit, control, sync)


def test_log_files_follow_rows_and_not_runs(spark, tmp_path):
    root = str(tmp_path / "logs")
    logs.write_capture(_capture(spark), root)
    for name in ("kernel", "audit", "sync"):
        assert len(glob.glob(f"{root}/{name}/**/*.json", recursive=True)) < RUNS / 2
    raw = logs.read_kernel_log(spark, f"{root}/kernel")
    events = logs.kernel_events(raw).collect()
    assert {(r.run_id, r.timestamp) for r in events} == {(f"run_{i % RUNS}", i + 9007199254740993) for i in range(RUNS * 3)}
    by_run = {}
    for r in sorted(events, key=lambda r: r.pos):
        by_run.setdefault(r.run_id, []).append(r.pid)
    assert all(pids == sorted(pids) for pids in by_run.values())
    assert {r.run_id for r in logs.control_rows(raw).collect()} == {f"run_{i}" for i in range(RUNS)}


def test_table_files_follow_rows_and_not_runs(spark, tmp_path):
    root = str(tmp_path / "tables")
    nodes = _capture(spark).kernel.select("run_id", "pid")
    logs.write_tables({"nodes": nodes}, root)
    assert len(glob.glob(f"{root}/nodes/**/*.parquet", recursive=True)) < RUNS / 2
    back = spark.read.parquet(f"{root}/nodes").select("run_id", "pid")
    assert sorted(back.collect()) == sorted(nodes.collect())


def test_facts_are_read_once_per_text(spark):
    texts = ["COPY t TO PROGRAM 'sh'", "", None, "SELEKT 1", "DROP TABLE public.x", "COPY t TO PROGRAM 'sh'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, query string")
    got = join_statement_facts(df)
    want = with_statement_facts(df)
    columns = ["i", "query", *FACTS]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def _reads(df, mark):
    """How many times a plan computes ``mark``."""
    return df._jdf.queryExecution().analyzed().toString().count(mark)


def _graphs(spark):
    rows = [
        a(0, 1, "SELECT * FROM customers"), a(1, 1, "COPY accounts TO PROGRAM 'sh'", "ProcessUtility"),
        k(2, 10, 1), a(3, 1, "SELECT * FROM customers"),
    ]
    events = frame(spark, numbered(rows))
    log, largest = attributed_events(events, attribute(events))
    return log, largest, build_graphs(log, bound=largest)


def test_behaviors_are_written_once(spark):
    g = _graphs(spark)[2]
    out = B.behaviors(g.nodes, g.edges, bound=100)
    assert _reads(out.found, "Join") == 0 and _reads(out.chain, "Join") == 0


def test_fit_reads_rows_and_folds_from_tables(spark):
    rows = spark.range(80).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("y"), F.lit(0.1).alias("rule_score"),
        F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("template"), F.sin("id").alias("x"),
    )
    folds = rows.groupBy("template").agg(F.max("y").alias("y")).where("template IN ('t1', 't0')")
    folds = folds.select(F.lit("f").alias("fold"), "template", F.lit("test").alias("part"))
    _, judged = training.fold_scores(rows, folds, ["x"], [0], F.lit(True))
    assert _reads(judged, "Range (") == 0


def test_prefix_behaviors_alone(spark):
    log, largest, g = _graphs(spark)
    labels = spark.createDataFrame([("r", 1, "Attack")], "run_id string, session_key long, label string")
    labels = log.select("run_id", "session_key").distinct().join(labels.select("session_key", "label"), "session_key")
    cuts = prefixes.session_cuts(log, labels, 5, 2, bound=largest)
    whole = {(r.behavior, r.src_key, r.dst_key, r.chain_no) for r in B.behaviors(g.nodes, g.edges).found.collect()}
    found = prefixes.prefix_behaviors(g, cuts, bound=100).collect()
    assert whole and {(r.behavior, r.src_key, r.dst_key, r.chain_no) for r in found if r.k is None} == whole
    first = {(r.behavior, r.src_key, r.dst_key) for r in found if r.k == 1}
    assert first and first < {w[:3] for w in whole}
    assert {r.k for r in prefixes.prefix_nodes(g, cuts).collect()} == {r.k for r in found}


def test_pooling_takes_one_mean_per_feature(spark):
    rows = [("r", s, kind, float(s + i)) for s in (1, 2) for i, kind in enumerate(["Query", "Query", "Behavior"]) if s + i < 4]
    df = spark.createDataFrame(rows, "run_id string, session_key long, node_type string, v double")
    nodes = df.select("run_id", "session_key", "node_type", *[F.col("v").alias(f) for f in features.FEATURES])
    out = features.pool(nodes)
    assert out.columns == ["run_id", "session_key", *features.pooled_columns()]
    got = {r.session_key: (r.query_h0, r.behavior_in_degree, r.file_h1) for r in out.collect()}
    assert got == {1: (1.5, 3.0, 0.0), 2: (2.5, 0.0, 0.0)}
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    assert _reads(out, "avg(") == len(features.FEATURES)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
