import pytest
from pyspark.sql import functions as F

from spoorline.operators import behaviors as B
from spoorline.operators import risk
from spoorline.operators.attribution import attribute, attributed_events
from spoorline.operators.graph import build_graphs, edge_event_pages, orphans
from tests.logs_fixture import a, frame, k, numbered

COPY = "COPY (SELECT * FROM customers) TO PROGRAM 'sh'"


def _graphs(spark, rows, seg=1 << 20):
    events = frame(spark, numbered(rows))
    log, largest = attributed_events(events, attribute(events, seg_rows=seg), None, seg)
    return build_graphs(log, bound=largest, seg_rows=seg)


def _edges(g):
    return {(r.src_type, r.src_key, r.rel, r.dst_type, r.dst_key): r["count"] for r in g.edges.collect()}


def test_spawn_window_and_parents(spark):
    g = _graphs(spark, [
        a(0, 1, COPY, "ProcessUtility"), k(4.999, 10, 1), k(5.0, 11, 1), k(90, 12, 10), k(95, 1, 1),
    ])
    edges = _edges(g)
    assert edges["Query", "0", "spawns", "Process", "10"] == 1
    assert edges["Process", "10", "spawns", "Process", "12"] == 1
    assert edges["Process", "1", "spawns", "Process", "1"] == 1
    assert [(r.pid, r.ppid) for r in orphans(g.events).collect()] == [(11, 1)]


@pytest.mark.parametrize("seg", [2, 1 << 20])
def test_statement_pairs(spark, seg):
    q = "SELECT x FROM t"
    g = _graphs(spark, [
        a(0, 1, q, "ExecutorEnd"), a(1, 1, q), a(2, 1, q), a(3, 1, q, "ExecutorEnd"),
        a(4, 1, "SELECT 2", "ExecutorEnd"), a(5, 1, q, "ExecutorEnd"), a(6, 1, q, None),
    ], seg)
    edges = _edges(g)
    assert {e[4]: n for e, n in edges.items() if e[2] == "executes"} == {"0": 1, "1": 1, "2": 3, "4": 1, "6": 1}
    node = g.nodes.where("node_type = 'Query' AND node_key = '2'").first()
    assert (node.timestamp_unix, node.last_seen) == (2.0, 5.0)
    assert g.nodes.where("node_type = 'Session'").first().last_seen is None
    pages = edge_event_pages(g.links, 2).where("dst_type = 'Query' AND dst_key = '2'")
    assert [r.event_ids for r in pages.orderBy("page").collect()] == [[2, 2], [2]] or [
        i for r in pages.orderBy("page").collect() for i in r.event_ids
    ] == [2, 2, 2]


def test_endpoints_need_an_address(spark):
    g = _graphs(spark, [a(0, 1), k(1, 9, 1, "connect"), k(2, 9, 1, "connect", dest_ip="1.2.3.4", dest_port=443)])
    assert [r.node_key for r in g.nodes.where("node_type = 'Endpoint'").collect()] == ["1.2.3.4:443"]


def test_waiting_events_follow_the_event_that_revealed_the_session(spark):
    rows = numbered([k(10, 5, 0, "connect"), a(10, 5, COPY, "ProcessUtility")])
    events = frame(spark, rows)
    log, _ = attributed_events(events, attribute(events))
    assert [(r.source, r.seq) for r in log.orderBy("seq").collect()] == [("postgres", 0), ("kernel", 1)]


@pytest.mark.parametrize("seg", [2, 1 << 20])
def test_behaviors_chains_and_risk(spark, seg):
    g = _graphs(spark, [
        a(0, 1, "SELECT * FROM customers"), a(1, 1, COPY, "ProcessUtility"), k(2, 10, 1, comm="curl"),
        k(3, 10, 1, "connect", comm="curl", dest_ip="9.9.9.9", dest_port=443),
        a(50, 2, "SELECT count(*) FROM branches"), a(51, 2, "TRUNCATE TABLE audit_logs"),
    ], seg)
    found = B.behaviors(g.nodes, g.edges, seg_rows=seg)
    labels = {}
    for r in found.found.orderBy("session_key", "chain_no").collect():
        labels.setdefault(r.session_key, []).append(r.behavior)
        assert r.confidence == pytest.approx(0.4 + 0.6 * r.s_sem, abs=2e-3)
    assert labels == {
        1: ["DATA_ACCESS", "UNIX_SHELL_EXECUTION", "EXTERNAL_TRANSFER", "POTENTIAL_INGRESS_TOOL_TRANSFER"],
        2: ["DATA_ACCESS", "DESTRUCTIVE_DB_OPERATION", "DEFENSE_IMPAIRMENT"],
    }
    assert found.chain.count() == 5
    best = risk.best_chain(risk.chain_scores(found.found, bound=found.largest, seg_rows=seg))
    assert {r.session_key: r.scenario for r in best.collect()}[1] == "exfiltration"


def test_risk_equal_to_theta_alerts(spark):
    df = spark.createDataFrame([(0.55, "x"), (0.5499, None)], "risk double, scenario string")
    assert [r.status for r in risk.decide(df, 0.55).collect()] == ["alert", "benign"]
    one = spark.range(1).select(risk.fuse(F.lit(1.0), F.lit(0.5)).alias("r")).first().r
    assert one == pytest.approx(1 - 0.25 * (1 - 0.375))
