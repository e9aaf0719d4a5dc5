import json
import os

import pytest
from pyspark.sql import functions as F

from spoorline.operators.clock import master_log
from spoorline.plans import quality
from spoorline.sources import logs

GRAPHML = os.environ.get("SPOORLINE_GRAPHML", "")


def _run(root, name, kernel, audit, boot=1000.0):
    folder = root / name
    folder.mkdir(parents=True)
    (folder / logs.KERNEL_FILE).write_text("\n".join(kernel) + "\n")
    (folder / logs.AUDIT_FILE).write_text("\n".join(audit) + "\n")
    (folder / logs.SYNC_FILE).write_text(json.dumps({"server_boot_unix_time": boot}))


def test_capture_folder(spark, tmp_path):
    ev = lambda ns, pid: json.dumps({"pid": pid, "ppid": 1, "uid": 0, "timestamp": ns, "comm": "x", "syscall": "execve", "arg": ""})
    au = lambda ts, sid: json.dumps({"session_id": sid, "backend_pid": sid, "timestamp": ts, "query": "SELECT 1"})
    mark = json.dumps({"marker": "LOGGING_START", "timestamp": 5000.5})
    big = 9007199254740993  # not representable as a double
    _run(tmp_path, "run_1", [mark, "", ev(big + 2_000_000_000, 7), ev(big, 8), "{broken"], [au(5001.0, 3)])
    _run(tmp_path, "run_2", [ev(2_000_000_000, 9)], [au(1003.0, 4), json.dumps({"marker": "ATTACK_START", "timestamp": 1.0})])
    cap = logs.read_capture(spark, str(tmp_path))
    events, _ = master_log(cap)
    got = {(r.run_id, r.pid): (r.event_id, round(r.timestamp_unix, 3)) for r in events.collect()}
    assert got == {
        ("run_1", 8): (0, 4998.5), ("run_1", 7): (1, 5000.5), ("run_1", 3): (2, 5001.0),
        ("run_2", 9): (0, 1002.0), ("run_2", 4): (1, 1003.0),
    }
    assert {r.timestamp for r in cap.kernel.collect()} >= {big}
    raw = logs.read_kernel_log(spark, f"{tmp_path}/*/{logs.KERNEL_FILE}")
    assert [r._corrupt_record for r in logs.malformed_lines(raw.cache()).collect()] == ["{broken"]


def test_labels(spark, tmp_path):
    (tmp_path / "run_9").mkdir()
    (tmp_path / "run_9" / "labels.csv").write_text("﻿session_id,label\n1, Attack\n,Benign\n2,Benign\n", encoding="utf-8")
    got = {(r.run_id, r.session_id): (r.label, r.y) for r in logs.read_label_csv(spark, f"{tmp_path}/*/labels.csv").collect()}
    assert got == {("run_9", 1): ("Attack", 1), ("run_9", 2): ("Benign", 0)}
    # another file has another order, and a column of its own
    (tmp_path / "run_8").mkdir()
    (tmp_path / "run_8" / "labels.csv").write_text("role,label,session_id\nx,malicious,5\ny,Benign,\n")
    both = {(r.run_id, r.session_id): (r.label, r.y, r.role) for r in logs.read_label_csv(spark, f"{tmp_path}/*/labels.csv").collect()}
    assert both == {("run_9", 1): ("Attack", 1, None), ("run_9", 2): ("Benign", 0, None), ("run_8", 5): ("malicious", 1, "x")}


def test_manifest_problems(spark, tmp_path):
    (tmp_path / "run_1").mkdir()
    body = {"scenarios": {
        "a_0001": {"family_id": "a", "sessions": {"m": {"backend_pid": 1}}},
        "b_0001": {"family_id": "b", "sessions": {"m": {"backend_pid": 1}, "n": {}}},
        "c_0001": {"sessions": {"m": {"backend_pid": 5}}},
    }}
    (tmp_path / "run_1" / "expectation_manifest.json").write_text(json.dumps(body, indent=1))
    rows = logs.read_manifests(spark, f"{tmp_path}/*/expectation_manifest.json")
    assert {r.template for r in rows.collect()} == {"a", "b", "c"}
    assert {(r.backend_pid, r.problem) for r in logs.manifest_problems(rows).collect()} == {
        (1, "conflicting family"), (None, "missing pid"), (5, "missing family")}


SPEC = """scenario_id: s_0001
time_of_day: 22:30
default_class: malicious
sessions:
- session_label: recon
  role: teller
  timing: {tempo: bursty, step_gaps_seconds: [0.5, 3]}
  events:
  - sql: SELECT 1
  - sql: COPY (SELECT 1) TO PROGRAM 'cat'
  - process: {comm: gzip, args: [x], parent: p}
  - sql: SELECT 2
- session_label: late
  delay_after_previous_seconds: 10
  timing: {tempo: off_hours, step_gaps_seconds: [1]}
  events: [{sql: SELECT 3}]
"""


def test_specs(spark):
    texts = spark.createDataFrame([("r", SPEC), ("r", "a: [b")], "run_id string, text string")
    specs = logs.parse_specs(texts)
    assert specs.where("error IS NOT NULL").count() == 1
    good = specs.where("error IS NULL")
    assert good.first().time_of_day == "22:30"
    assert {(r.session_label, r.rule) for r in quality.spec_violations(good).collect()} == {("recon", "bursty_gap")}
    at = {(r.session_no, r.step_no): r.at_s - 81000 for r in quality.event_schedule(good).collect()}
    assert at == {(0, 0): 0, (0, 1): 0.5, (0, 2): 3.5, (0, 3): 4.0, (1, 0): 14.0}
    assert quality.os_activity(quality.spec_sessions(good)).first().has_os_activity


def test_field_types(spark):
    lines = ['{"a": 1, "b": "x", "c": 1.5}', '{"a": 2.0, "d": [1], "e": null, "f": true}', '{"marker": "M", "z": 1}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r.field, r.type): r.records for r in quality.field_types(df).collect()}
    assert got == {("a", "int"): 1, ("a", "float"): 1, ("b", "str"): 1, ("c", "float"): 1,
                   ("d", "list"): 1, ("e", "null"): 1, ("f", "bool"): 1}


@pytest.mark.skipif(not GRAPHML, reason="SPOORLINE_GRAPHML names no folder of graph files")
def test_stored_graphs(spark):
    """Facts, behavior scores and chains of stored graphs, against what the jobs derive."""
    from spoorline.functions.sqlfacts import with_statement_facts
    from spoorline.operators.behaviors import RULES

    graphs = logs.read_graphml(spark, GRAPHML).cache()
    nodes, edges = logs.graphml_nodes(graphs), logs.graphml_edges(graphs)
    at = F.col("attrs")
    queries = nodes.where(at["type"] == "Query").select(
        at["query"].alias("query"), *[F.nullif(at[n], F.lit("")).alias(f"x_{n}") for n in ("table_name", "shell_cmd", "role_name", "setting_name")]
    )
    diff = with_statement_facts(queries).where(
        " OR ".join(f"NOT ({n} <=> x_{n})" for n in ("table_name", "shell_cmd", "role_name", "setting_name"))
    )
    assert queries.count() > 0 and diff.count() == 0
    beh = nodes.where(at["type"] == "Behavior").select(
        "file", "id", at["behavior_label"].alias("b"), at["timestamp_unix"].cast("double").alias("ts"),
        at["s_sem"].cast("double").alias("s"), at["confidence"].cast("double").alias("c"))
    assert beh.where("abs(c - (0.4 + 0.6 * s)) > 0.0011").count() == 0
    order = F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(r.label), F.lit(i))])
    from pyspark.sql import Window
    w = Window.partitionBy("file").orderBy("ts", order[F.col("b")])
    ours = beh.select("file", F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst IS NOT NULL")
    stored = edges.where(at["rel"] == "precedes").select("file", "src", "dst")
    assert stored.count() > 0 and ours.exceptAll(stored).count() == 0 and stored.exceptAll(ours).count() == 0


@pytest.mark.skipif(not GRAPHML, reason="SPOORLINE_GRAPHML names no folder of graph files")
def test_stored_behaviors(spark):
    """The rules find the behaviors that stored graphs contain, no more and no fewer."""
    from spoorline.operators.behaviors import match_behaviors

    graphs = logs.read_graphml(spark, GRAPHML).cache()
    at = F.col("attrs")
    raw = logs.graphml_nodes(graphs).select(
        F.col("file").alias("run_id"), F.lit(0).cast("long").alias("session_key"), "id", at["type"].alias("node_type"),
        F.when(at["type"] == "Table", at["table_name"]).otherwise(F.col("id")).alias("node_key"),
        *[at[c].alias(c) for c in ("query", "comm", "arg", "dest_ip", "behavior_label")],
        at["timestamp_unix"].cast("double").alias("timestamp_unix"), at["s_temp"].cast("double").alias("s_temp"),
    ).cache()
    end = lambda s: raw.select("run_id", F.col("id").alias(s), F.col("node_type").alias(f"{s}_type"), F.col("node_key").alias(f"{s}_key"))
    edges = logs.graphml_edges(graphs).select(F.col("file").alias("run_id"), "src", "dst", at["rel"].alias("rel"))
    edges = edges.join(end("src"), ["run_id", "src"]).join(end("dst"), ["run_id", "dst"]).withColumn("session_key", F.lit(0).cast("long"))
    found = match_behaviors(raw, edges)
    ours = found.select("run_id", "behavior", F.col("s_temp").cast("string"))
    stored = raw.where("node_type = 'Behavior'").select("run_id", F.col("behavior_label").alias("behavior"), F.col("s_temp").cast("string"))
    assert stored.count() > 0
    assert ours.exceptAll(stored).count() == 0 and stored.exceptAll(ours).count() == 0
