"""Queries over the logs derived from the event stream: sources to assessed sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions.sqlfacts import STATEMENT_WORDS, with_statement_facts
from spoorline.functions.text import copied_query, hostnames, mask_literals, sequence_fingerprint
from spoorline.operators import behaviors as B
from spoorline.operators import clock, features, graph, risk
from spoorline.operators.attribution import SESSION, attribution_report, parent_links
from spoorline.plans import leakage, live, quality, session_graphs, splits
from spoorline.registry.oracle import with_ctes
from spoorline.session import fresh_path, materialize
from spoorline.sources import logs, tables

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None, extra: str = ""):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = with_ctes(sql, extra)
        return fn

    return add


def _cap(spark, d):
    return tables.capture(spark, d)


def _prov(spark, d):
    return session_graphs.provenance(_cap(spark, d))


def _audit_facts(spark, d):
    _, _, log, _, bound = session_graphs.session_log(_cap(spark, d))
    return with_statement_facts(graph.pair_statements(log, bound))


def _found(spark, d):
    return session_graphs.session_behaviors(_prov(spark, d))


def _labels(spark, d):
    return logs.clean_labels(tables.session_labels(spark, d))


# --- sources and sinks


@query(
    "s01_kernel_scan",
    'SELECT run_id, pid, ppid, uid, "timestamp" AS ns, comm, syscall, arg, dest_ip, dest_port FROM kernel',
)
def s01(spark: SparkSession, d: str) -> DataFrame:
    root = fresh_path(spark, "logs")
    logs.write_capture(_cap(spark, d), root)
    raw = logs.read_kernel_log(spark, f"{root}/kernel")
    return logs.kernel_events(raw).drop("pos").withColumnRenamed("timestamp", "ns")


@query(
    "s02_audit_scan",
    'SELECT run_id, session_id, session_start_time, backend_pid, "timestamp" AS ts, event_type, query, '
    '"database", username, client_addr, client_port FROM audit',
)
def s02(spark, d):
    root = fresh_path(spark, "logs")
    logs.write_capture(_cap(spark, d), root)
    raw = logs.read_audit_log(spark, f"{root}/audit")
    return logs.audit_events(raw).drop("pos").withColumnRenamed("timestamp", "ts")


@query("s03_control_rows", 'SELECT run_id, marker, "timestamp" AS ts FROM control')
def s03(spark, d):
    root = fresh_path(spark, "logs")
    logs.write_capture(_cap(spark, d), root)
    raw = logs.read_kernel_log(spark, f"{root}/kernel")
    return logs.control_rows(raw).select("run_id", "marker", F.col("timestamp").alias("ts"))


@query(
    "s10_attributed_event_sink",
    "SELECT l.run_id, l.source, count(*) AS events, min(l.event_id) AS first_id, max(l.event_id) AS last_id "
    "FROM log l SEMI JOIN pairs p ON p.run_id = l.run_id AND p.event_id = l.event_id GROUP BY 1, 2",
)
def s10(spark, d):
    events, pairs, *_ = session_graphs.session_log(_cap(spark, d))
    root = fresh_path(spark, "events")
    kept = events.join(pairs, ["run_id", "event_id"], "left_semi").drop("pos")
    logs.write_tables({"events": kept, "pairs": pairs}, root)
    back = spark.read.parquet(f"{root}/events")
    return back.groupBy("run_id", "source").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    )


_MANIFEST = """SELECT n.run_id, n.session_key, COALESCE(trim(l.label), 'unknown') AS label, n.node_count,
 COALESCE(e.edge_count, 0) AS edge_count FROM (SELECT run_id, session_key, count(*) AS node_count FROM nodes GROUP BY 1, 2) n
 LEFT JOIN (SELECT run_id, session_key, count(*) AS edge_count FROM edges GROUP BY 1, 2) e
  ON e.run_id = n.run_id AND e.session_key = n.session_key
 LEFT JOIN labels_of_sessions l ON l.run_id = n.run_id AND l.session_id = n.session_key"""


@query("s11_graph_sink", _MANIFEST)
def s11(spark, d):
    g = _prov(spark, d).graphs
    root = fresh_path(spark, "graphs")
    logs.write_tables({"nodes": g.nodes, "edges": g.edges}, root)
    nodes, edges = (spark.read.parquet(f"{root}/{n}") for n in ("nodes", "edges"))
    logs.append_manifest(graph.session_manifest(nodes, edges, _labels(spark, d)), root)
    schema = "run_id string, session_key long, label string, node_count long, edge_count long"
    return spark.read.schema(schema).json(f"{root}/manifest")


@query(
    "s12_orphans",
    "SELECT run_id, session_key, event_id, pid, ppid, comm FROM prep "
    "WHERE source = 'kernel' AND parent_pid IS NULL AND spawn_query IS NULL",
)
def s12(spark, d):
    return graph.orphans(_prov(spark, d).graphs.events)


_WORDS = ", ".join(f"'{w}'" for w in STATEMENT_WORDS)


@query(
    "s12_parse_errors",
    "SELECT conv_id, turn, 'syntax error at or near \"' || w || '\"' AS error FROM (SELECT *, "
    "lower(regexp_extract(bare, '^\\s*\\(*\\s*(\\w*)', 1)) AS w FROM (SELECT conv_id, turn, text, "
    "split_part(regexp_replace(text, '''[^'']*''', '''''', 'g'), ';', 1) AS bare FROM conversations)) "
    f"WHERE trim(bare) <> '' AND (w NOT IN ({_WORDS}) OR (len(text) - len(replace(text, '''', ''))) % 2 = 1 "
    "OR len(replace(bare, '(', '')) <> len(replace(bare, ')', '')))",
)
def s12_errors(spark, d):
    """Texts that are no statements: all turns of all conversations."""
    facts = with_statement_facts(tables.table(spark, d, "conversations"), "text")
    return facts.where("parse_error IS NOT NULL").select(
        "conv_id", "turn", F.col("parse_error").alias("error")
    )


@query(
    "s13_flat_attributes",
    "SELECT run_id, session_key::VARCHAR AS session_key, seq::VARCHAR AS seq, COALESCE(table_name, '') AS table_name, "
    "CASE is_program WHEN true THEN 'True' WHEN false THEN 'False' ELSE '' END AS is_program, "
    "COALESCE(shell_cmd, '') AS shell_cmd FROM facts",
)
def s13(spark, d):
    facts = _audit_facts(spark, d)
    return graph.flat_attributes(
        facts.select(*SESSION, "seq", "table_name", "is_program", "shell_cmd")
    )


@query(
    "s04_label_csv",
    "SELECT run_id, session_id, trim(label) AS label, CASE WHEN lower(trim(label)) IN ('attack', 'malicious') THEN 1 ELSE 0 END AS y "
    "FROM labels_of_sessions WHERE session_id % 13 <> 0",
)
def s04(spark, d):
    root = fresh_path(spark, "labels")
    raw = tables.session_labels(spark, d).withColumn(
        "session_id", F.when(F.col("session_id") % 13 != 0, F.col("session_id"))
    )
    (
        raw.select(F.col("run_id").alias("run"), F.col("session_id").alias("﻿session_id"), "label")
        .hint("rebalance", "run")  # else every task writes a file for every run
        .write.partitionBy("run").option("header", True).csv(root)
    )
    return logs.read_label_csv(spark, f"{root}/*").select("run_id", "session_id", "label", "y")


@query(
    "s05_label_lines",
    "SELECT session_id, trim(label) AS class, template || ':x' AS key, CASE WHEN trim(label) IN ('Attack', 'malicious') THEN 1 ELSE 0 END AS y "
    "FROM labels_of_sessions",
)
def s05(spark, d):
    root = fresh_path(spark, "labels")
    tables.session_labels(spark, d).select(
        "session_id", F.concat(F.trim("label"), F.lit(":"), "template", F.lit(":x")).alias("label")
    ).write.json(root)
    return logs.read_label_lines(spark, root).select("session_id", "class", "key", "y")


def _manifest_rows(spark, d):
    """Expectation manifests of the labelled sessions, one scenario per session."""
    s = tables.session_labels(spark, d)
    scenario = F.concat_ws("_", "template", F.lpad(F.col("session_id").cast("string"), 6, "0"))
    session = F.create_map(F.lit("main"), F.struct(F.col("session_id").alias("backend_pid")))
    body = F.struct(
        F.when(F.col("session_id") % 17 > 0, F.col("template")).alias("family_id"),
        session.alias("sessions"),
    )
    return s.select("run_id", F.create_map(scenario, body).alias("scenarios"))


@query(
    "s06_manifest_scan",
    "SELECT run_id, template || '_' || lpad(session_id::VARCHAR, 6, '0') AS scenario_id, CASE WHEN session_id % 17 > 0 "
    "THEN template END AS family, template, 'main' AS session_name, session_id AS backend_pid FROM labels_of_sessions",
)
def s06(spark, d):
    root = fresh_path(spark, "manifests")
    (
        _manifest_rows(spark, d)
        .withColumnRenamed("run_id", "run")
        .hint("rebalance", "run")  # one file per run, however many tasks
        .write.partitionBy("run").json(root)
    )
    raw = spark.read.schema(logs.schemas.MANIFEST).json(f"{root}/*")
    return logs.manifest_sessions(raw.select("scenarios", logs.folder_of_file().alias("run_id")))


@query(
    "s06_manifest_problems",
    "SELECT run_id, session_id AS backend_pid, 'missing family' AS problem FROM labels_of_sessions WHERE session_id % 17 = 0",
)
def s06_problems(spark, d):
    return logs.manifest_problems(logs.manifest_sessions(_manifest_rows(spark, d)))


_FILE = (
    "'enriched_run_' || regexp_extract(run_id, '([0-9]+)', 1) || '_' || session_id || "
    "CASE WHEN session_id % 3 = 0 THEN '_p' || (session_id % 5) ELSE '' END || "
    "CASE WHEN session_id % 5 < 2 THEN '_Malicious' ELSE '_Benign' END || '.graphml'"
)


def _graph_files(spark, d):
    sid = F.col("session_id")
    return tables.session_labels(spark, d).select(
        "run_id",
        sid,
        "template",
        F.concat(
            F.lit("enriched_"), "run_id", F.lit("_"), sid.cast("string"),
            F.when(sid % 3 == 0, F.concat(F.lit("_p"), (sid % 5).cast("string"))).otherwise(""),
            F.when(sid % 5 < 2, "_Malicious").otherwise("_Benign"), F.lit(".graphml"),
        ).alias("file"),
    )


@query(
    "s07_graphml_scan",
    "SELECT run_id || '_' || session_key || '.graphml' AS graph, node_type AS type, node_key AS key, "
    "round(timestamp_unix, 3) AS ts FROM nodes",
)
def s07(spark, d):
    """Graph documents of the sessions, written as XML rows and scanned with the XML reader."""
    nodes = _prov(spark, d).graphs.nodes
    root = fresh_path(spark, "graphml")

    def data(key, value):
        return F.concat(F.lit(f'<data key="{key}">'), value, F.lit("</data>"))

    node = F.concat(
        F.lit('<node id="'), "node_type", F.lit(" "), F.xxhash64("node_key").cast("string"), F.lit('">'),
        data("d0", F.col("node_type")), data("d1", F.base64(F.encode("node_key", "utf-8"))),
        data("d2", F.format_string("%.3f", F.round("timestamp_unix", 3))), data("d3", F.concat_ws("_", *SESSION)),
        F.lit("</node>"),
    )
    keys = "".join(
        f'<key id="d{i}" for="node" attr.name="{n}" attr.type="string"/>'
        for i, n in enumerate(["type", "key", "ts", "session"])
    )
    document = F.concat(
        F.lit(f"<graphml>{keys}<graph edgedefault='directed'>"), node, F.lit("</graph></graphml>")
    )
    nodes.select(document.alias("value")).write.text(root)
    found = logs.graphml_nodes(logs.read_graphml(spark, root))
    attr = F.col("attrs")
    return found.select(
        F.concat(attr["session"], F.lit(".graphml")).alias("graph"),
        attr["type"].alias("type"),
        F.decode(F.unbase64(attr["key"]), "utf-8").alias("key"),
        attr["ts"].cast("double").alias("ts"),
    )


@query(
    "s07_graphml_edges",
    "SELECT run_id || '_' || session_key || '.graphml' AS graph, src_type, src_key, rel, dst_type, dst_key, \"count\", round(first_seen, 3) AS first_seen FROM edges",
)
def s07_edges(spark, d):
    """Graph documents with two nodes and the edge between them, each read back whole."""
    edges = _prov(spark, d).graphs.edges
    root = fresh_path(spark, "graphml")

    def coded(column):
        return F.base64(F.encode(column, "utf-8"))

    def data(key, value):
        return F.concat(F.lit(f'<data key="{key}">'), value, F.lit("</data>"))

    def node(side):
        return F.concat(
            F.lit(f'<node id="{side}">'), data("d0", F.col(f"{side}_type")), data("d1", coded(f"{side}_key")), F.lit("</node>")
        )

    edge = F.concat(
        F.lit('<edge source="src" target="dst" id="e">'), data("d2", F.col("rel")), data("d3", F.col("count").cast("string")),
        data("d4", F.format_string("%.3f", F.round("first_seen", 3))), data("d5", F.concat_ws("_", *SESSION)), F.lit("</edge>"),
    )
    names = ["type", "key", "rel", "count", "first_seen", "session"]
    keys = "".join(f'<key id="d{i}" for="all" attr.name="{n}" attr.type="string"/>' for i, n in enumerate(names))
    document = F.concat(
        F.lit(f"<graphml>{keys}<graph edgedefault='directed'>"), node("src"), node("dst"), edge, F.lit("</graph></graphml>")
    )
    edges.select(document.alias("value")).write.text(root)
    graphs = logs.read_graphml(spark, root)
    whole = graphs.select(F.explode("edges").alias("e"), F.map_from_entries("nodes").alias("at"))
    attr = F.col("e.attrs")

    def end(side, name):
        return F.element_at(F.col("at"), F.col(f"e.{side}"))[name]

    return whole.select(
        F.concat(attr["session"], F.lit(".graphml")).alias("graph"),
        end("src", "type").alias("src_type"),
        F.decode(F.unbase64(end("src", "key")), "utf-8").alias("src_key"),
        attr["rel"].alias("rel"),
        end("dst", "type").alias("dst_type"),
        F.decode(F.unbase64(end("dst", "key")), "utf-8").alias("dst_key"),
        attr["count"].cast("long").alias("count"),
        attr["first_seen"].cast("double").alias("first_seen"),
    )


@query(
    "s08_graph_file_facts",
    f"SELECT file, run_id AS run, session_id AS pid, CASE WHEN session_id % 3 = 0 THEN session_id % 5 END AS prefix, "
    f"CASE WHEN session_id % 5 < 2 THEN 'Malicious' ELSE 'Benign' END AS label, CASE WHEN session_id % 5 < 2 THEN 1 ELSE 0 END AS y "
    f"FROM (SELECT *, {_FILE} AS file FROM labels_of_sessions)",
)
def s08(spark, d):
    files = _graph_files(spark, d).select("file")
    return files.withColumns(splits.graph_file_facts(F.col("file")))


# --- projections


@query("p01_clock_offsets", "SELECT run_id, clock_offset FROM offsets")
def p01(spark, d):
    cap = _cap(spark, d)
    return clock.clock_offsets(cap.kernel, cap.control, cap.time_sync)


@query(
    "p02_boot_time_fallback",
    "SELECT o.run_id, o.clock_offset FROM offsets o ANTI JOIN control c ON c.run_id = o.run_id",
)
def p02(spark, d):
    cap = _cap(spark, d)
    offsets = clock.clock_offsets(cap.kernel, cap.control, cap.time_sync)
    return offsets.join(cap.control, "run_id", "left_anti")


@query(
    "p03_statement_facts",
    "SELECT run_id, session_key, seq, table_name, is_program, shell_cmd, is_drop, role_name, is_role_change, is_superuser, "
    "is_privilege_escalation, is_destructive, is_truncate, setting_name, setting_value, is_system_config FROM facts",
)
def p03(spark, d):
    names = [f for f in graph.FACTS if f != "parse_error"]
    return _audit_facts(spark, d).select(*SESSION, "seq", *names)


def _facts_of(name, where, columns, spark_where=None):
    cols = ", ".join(columns)

    @query(name, f"SELECT run_id, pos, query, {cols} FROM facts WHERE {where}")
    def run(spark, d):
        """Straight from the audit log: statement facts need no session."""
        audit = _cap(spark, d).audit
        return (
            with_statement_facts(audit)
            .where(spark_where or where)
            .select("run_id", "pos", "query", *columns)
        )


_STARTS = "upper(ltrim(query)) LIKE '{}%'"
_facts_of("p03a_copy", _STARTS.format("COPY"), ["table_name", "is_program", "shell_cmd"])
_facts_of("p03b_select", _STARTS.format("SELECT"), ["table_name"])
_facts_of("p03c_drop", _STARTS.format("DROP"), ["table_name", "is_drop"])
_facts_of("p03d_create_role", _STARTS.format("CREATE"), ["role_name", "is_role_change", "is_superuser"])
_facts_of(
    "p03e_alter_role", _STARTS.format("ALTER ROLE"),
    ["role_name", "is_role_change", "is_superuser", "is_privilege_escalation"],
)
_facts_of("p03f_truncate", _STARTS.format("TRUNCATE"), ["table_name", "is_destructive", "is_truncate"])
_facts_of(
    "p03g_alter_system", _STARTS.format("ALTER SYSTEM"),
    ["setting_name", "setting_value", "is_system_config"],
)
_facts_of("p03h_set_role", _STARTS.format("SET ROLE"), ["role_name", "is_role_change"])
_facts_of(
    "p03i_dml",
    " OR ".join(_STARTS.format(w) for w in ("INSERT", "UPDATE", "DELETE")),
    ["table_name"],
)
_facts_of("p03j_empty", "trim(query) = ''", ["table_name", "role_name", "is_role_change"])


@query("p04_p05_node_mentions", "SELECT run_id, session_key, seq, node_type, node_key FROM mentions")
def p04(spark, d):
    return _prov(spark, d).graphs.mentions.select(*SESSION, "seq", "node_type", "node_key")


_MASK = "regexp_replace(regexp_replace(lower(trim(query)), '''[^'']*''', '''S''', 'g'), '\\b\\d+(\\.\\d+)?\\b', 'N', 'g')"


@query("p06_masked_statements", f"SELECT {_MASK} AS statement, count(*) AS n FROM audit GROUP BY 1")
def p06(spark, d):
    masked = _cap(spark, d).audit.select(mask_literals(F.col("query")).alias("statement"))
    return masked.groupBy("statement").agg(F.count(F.lit(1)).alias("n"))


def _statements(spark, d):
    """Non-empty statements of the audit log with their session."""
    audit = _cap(spark, d).audit.where("query <> ''")
    return audit.select("run_id", F.col("session_id").alias("session_key"), "timestamp", "pos", "query")


def fingerprint_sql(text: str) -> str:
    """A fingerprint over rows numbered ``no``, as SQL."""
    own = f"md5(no || ':' || md5({text}))"
    sums = [f"sum(('0x' || substr({own}, {at}, 15))::BIGINT::HUGEINT)" for at in (1, 16)]
    return f"count(*) || '-' || {sums[0]} || '-' || {sums[1]}"


_PLACED = (
    "SELECT run_id, session_key, query, row_number() OVER (PARTITION BY run_id, session_key ORDER BY timestamp_unix, event_id) - 1 AS no "
    "FROM nodes WHERE node_type = 'Query' AND query <> ''"
)


@query(
    "p07_session_fingerprints",
    f"SELECT run_id, session_key, {fingerprint_sql('query')} AS sql, {fingerprint_sql(_MASK)} AS sql_norm FROM ({_PLACED}) GROUP BY 1, 2",
)
def p07(spark, d):
    nodes = leakage.query_statements(_prov(spark, d).graphs.nodes)
    return leakage.session_fingerprints(nodes, ["timestamp_unix", "event_id"])


@query(
    "p07_long_sequences",
    "SELECT role, "
    + fingerprint_sql("coalesce(text, '')")
    + " AS text_fp FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS no FROM conversations) GROUP BY 1",
)
def p07_long(spark, d):
    """Fingerprints of few long groups, numbered over all tasks and in several segments."""
    turns = tables.table(spark, d, "conversations")
    texts = {"text_fp": F.coalesce("text", F.lit(""))}
    return sequence_fingerprint(turns, ["role"], ["conv_id", "turn"], texts, seg_rows=64)


@query(
    "p08_templates",
    "SELECT DISTINCT template, count(*) AS sessions FROM labels_of_sessions GROUP BY 1",
)
def p08(spark, d):
    s = tables.session_labels(spark, d)
    instance = F.concat_ws("_", "template", F.lpad(F.col("session_id").cast("string"), 6, "0"))
    named = s.select(live.template_of(instance).alias("template"))
    return named.groupBy("template").agg(F.count(F.lit(1)).alias("sessions"))


@query(
    "p09_binary_labels",
    "SELECT CASE WHEN lower(trim(label)) IN ('attack', 'malicious') THEN 1 ELSE 0 END AS y, count(*) AS n FROM labels_of_sessions GROUP BY 1",
)
def p09(spark, d):
    s = tables.session_labels(spark, d).select(live.binary_label(F.col("label")).alias("y"))
    return s.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p10_hostnames",
    "SELECT host, count(*) AS n FROM (SELECT unnest(regexp_extract_all(url || ' ' || html, 'https?://([^/:''\\s]+)', 1)) AS host FROM pages) GROUP BY 1",
)
def p10(spark, d):
    pages = tables.table(spark, d, "pages").select(
        F.explode(hostnames(F.concat_ws(" ", "url", "html"))).alias("host")
    )
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p11_copied_query",
    "SELECT inner_query, count(*) AS n FROM (SELECT regexp_extract(query, '(?is)^\\s*COPY\\s*\\((.*)\\)\\s*TO\\s+PROGRAM', 1) "
    "AS inner_query FROM audit) WHERE inner_query <> '' GROUP BY 1",
)
def p11(spark, d):
    inner = _cap(spark, d).audit.select(copied_query(F.col("query")).alias("inner_query"))
    return inner.where("inner_query IS NOT NULL").groupBy("inner_query").agg(F.count(F.lit(1)).alias("n"))


# --- attribution and joins


@query(
    "u01_w01_master_log",
    "SELECT run_id, event_id, source, round(timestamp_unix, 6) AS ts, pid, pos FROM log",
)
def w01(spark, d):
    events, _ = clock.master_log(_cap(spark, d))
    return events.select(
        "run_id", "event_id", "source", F.round("timestamp_unix", 6).alias("ts"), "pid", "pos"
    )


@query("j01_j02_j03_attribution", "SELECT run_id, event_id, session_key, resolved_at FROM pairs")
def j01(spark, d):
    return session_graphs.session_log(_cap(spark, d))[1]


@query(
    "j01_parent_links",
    "SELECT run_id, pid, ppid, since FROM (SELECT *, lag(ppid) OVER (PARTITION BY run_id, pid ORDER BY since) AS was FROM stated) "
    "WHERE was IS NULL OR was <> ppid",
)
def j01_links(spark, d):
    events, bound = clock.master_log(_cap(spark, d))
    return parent_links(events, bound).drop("until")


@query(
    "j02_late_resolved",
    "SELECT p.run_id, p.event_id, p.session_key, p.resolved_at, round(a.timestamp_unix - l.timestamp_unix, 6) AS waited_s FROM pairs p "
    "JOIN log l ON l.run_id = p.run_id AND l.event_id = p.event_id JOIN log a ON a.run_id = p.run_id AND a.event_id = p.resolved_at "
    "WHERE p.resolved_at <> p.event_id",
)
def j02(spark, d):
    events, pairs, *_ = session_graphs.session_log(_cap(spark, d))
    ts = events.select("run_id", "event_id", "timestamp_unix")
    at = ts.select("run_id", F.col("event_id").alias("resolved_at"), F.col("timestamp_unix").alias("_at"))
    late = pairs.where("resolved_at <> event_id")
    return (
        late.join(ts, ["run_id", "event_id"])
        .join(at, ["run_id", "resolved_at"])
        .select(
            "run_id", "event_id", "session_key", "resolved_at",
            F.round(F.col("_at") - F.col("timestamp_unix"), 6).alias("waited_s"),
        )
    )


@query(
    "j04_w02_session_log",
    "SELECT run_id, session_key, seq, event_id, source, round(timestamp_unix, 6) AS ts FROM slog",
)
def j04(spark, d):
    log = session_graphs.session_log(_cap(spark, d))[2]
    return log.select(*SESSION, "seq", "event_id", "source", F.round("timestamp_unix", 6).alias("ts"))


@query("a04_j05_session_manifest", _MANIFEST)
def a04(spark, d):
    g = _prov(spark, d).graphs
    return graph.session_manifest(g.nodes, g.edges, _labels(spark, d))


def _edges_of(name, where):
    @query(
        name,
        "SELECT run_id, session_key, src_type, src_key, dst_type, dst_key, \"count\", round(first_seen, 6) AS first_seen "
        f"FROM edges WHERE {where}",
    )
    def run(spark, d):
        """One kind of edge."""
        return (
            _prov(spark, d).graphs.edges.where(where)
            .select(*SESSION, "src_type", "src_key", "dst_type", "dst_key", "count",
                    F.round("first_seen", 6).alias("first_seen"))
        )


_edges_of("j08_executes", "rel = 'executes'")
_edges_of("j09_accesses", "rel = 'accesses'")
_edges_of("j10_process_parents", "rel = 'spawns' AND src_type = 'Process'")
_edges_of("j11_program_spawns", "rel = 'spawns' AND src_type = 'Query'")
_edges_of("j12_opens_connects", "rel IN ('opens', 'connects_to')")


@query(
    "j13_orphan_counts",
    "SELECT run_id, comm, count(*) AS orphans FROM prep WHERE source = 'kernel' AND parent_pid IS NULL AND spawn_query IS NULL GROUP BY 1, 2",
)
def j13(spark, d):
    found = graph.orphans(_prov(spark, d).graphs.events)
    return found.groupBy("run_id", "comm").agg(F.count(F.lit(1)).alias("orphans"))


# --- graph tables


@query(
    "a01_nodes",
    "SELECT run_id, session_key, node_type, node_key, round(timestamp_unix, 6) AS ts, round(last_seen, 6) AS last_seen, mentions, "
    "query, comm, arg, dest_ip FROM nodes",
)
def a01(spark, d):
    n = _prov(spark, d).graphs.nodes
    return n.select(
        *SESSION, "node_type", "node_key", F.round("timestamp_unix", 6).alias("ts"),
        F.round("last_seen", 6).alias("last_seen"), "mentions", "query", "comm", "arg", "dest_ip",
    )


@query(
    "a02_edges",
    'SELECT run_id, session_key, src_type, src_key, rel, dst_type, dst_key, "count", round(first_seen, 6) AS first_seen, '
    "round(last_seen, 6) AS last_seen FROM edges",
)
def a02(spark, d):
    e = _prov(spark, d).graphs.edges
    return e.withColumns(
        {"first_seen": F.round("first_seen", 6), "last_seen": F.round("last_seen", 6)}
    )


@query(
    "a02_edge_events",
    "SELECT run_id, session_key, src_type, src_key, rel, dst_type, dst_key, 0 AS page, "
    "list_transform(event_ids, lambda x: x::VARCHAR).list_aggregate('string_agg', ',') AS event_ids FROM edges",
)
def a02_pages(spark, d):
    pages = graph.edge_event_pages(_prov(spark, d).graphs.links)
    return pages.withColumn(
        "event_ids", F.array_join(F.transform("event_ids", lambda x: x.cast("string")), ",")
    )


@query(
    "a03_statement_pairs",
    "SELECT run_id, session_key, event_id, event_type, query_id FROM paired",
)
def a03(spark, d):
    _, _, log, _, bound = session_graphs.session_log(_cap(spark, d))
    return graph.pair_statements(log, bound).select(*SESSION, "event_id", "event_type", "query_id")


@query(
    "a05_attribution_report",
    "SELECT l.run_id, count(p.session_key) FILTER (l.source = 'postgres') AS audit_linked, count(*) FILTER (l.source = 'postgres') AS audit_total, "
    "count(p.session_key) FILTER (l.source = 'kernel') AS kernel_linked, count(*) FILTER (l.source = 'kernel') AS kernel_total, "
    "count(DISTINCT p.session_key) AS sessions FROM log l LEFT JOIN pairs p ON p.run_id = l.run_id AND p.event_id = l.event_id GROUP BY 1",
)
def a05(spark, d):
    events, pairs, *_ = session_graphs.session_log(_cap(spark, d))
    return attribution_report(events, pairs)


@query(
    "a06_type_histogram",
    "SELECT run_id, session_key, 'node' AS part, node_type AS kind, count(*) AS \"count\" FROM nodes GROUP BY 1, 2, 4 "
    "UNION ALL SELECT run_id, session_key, 'edge', rel, count(*) FROM edges GROUP BY 1, 2, 4",
)
def a06(spark, d):
    g = _prov(spark, d).graphs
    return graph.type_histogram(g.nodes, g.edges)


def _json_lines(df):
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in ("pos", "run_id")])).alias("value"))


@query(
    "a07_field_types",
    "SELECT field, 'int' AS type, count(*) AS records FROM (SELECT unnest(['pid', 'ppid', 'uid', 'timestamp']) AS field FROM kernel) GROUP BY 1 "
    "UNION ALL SELECT field, 'str', count(*) FROM (SELECT unnest(['comm', 'syscall', 'arg']) AS field FROM kernel) GROUP BY 1 "
    "UNION ALL SELECT 'dest_ip', 'str', count(dest_ip) FROM kernel UNION ALL SELECT 'dest_port', 'int', count(dest_port) FROM kernel",
)
def a07(spark, d):
    return quality.field_types(_json_lines(_cap(spark, d).kernel))


def _profile_sql(name: str, fields: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS field, any_value(typeof(\"{f}\")) AS t, count(\"{f}\") AS n FROM {name}" for f in fields.split()
    )
    return f"SELECT field, t FROM ({rows}) WHERE n > 0"


_KERNEL_FIELDS = "pid ppid uid timestamp comm syscall arg dest_ip dest_port"
_AUDIT_FIELDS = "session_id session_start_time backend_pid timestamp event_type query database username client_addr client_port"


@query(
    "a07_profile_diff",
    "SELECT COALESCE(a.field, k.field) AS field, CASE WHEN a.field IS NULL THEN 'missing' WHEN k.field IS NULL THEN 'extra' ELSE 'types' END AS problem "
    f"FROM ({_profile_sql('audit', _AUDIT_FIELDS)}) a FULL JOIN ({_profile_sql('kernel', _KERNEL_FIELDS)}) k ON k.field = a.field "
    "WHERE a.field IS NULL OR k.field IS NULL OR a.t <> k.t",
)
def a07_diff(spark, d):
    """The audit log held against the kernel log: a capture of the wrong shape."""
    cap = _cap(spark, d)
    diff = quality.profile_diff(
        quality.field_types(_json_lines(cap.audit)), quality.field_types(_json_lines(cap.kernel))
    )
    return diff.select("field", "problem")


@query(
    "a07_log_starts",
    "SELECT k.run_id, COALESCE(c.at < k.at, false) AS starts_with_marker, k.unknown FROM (SELECT run_id, min(pos) AS at, "
    "count(*) FILTER (syscall NOT IN ('execve', 'openat', 'connect')) AS unknown FROM kernel GROUP BY 1) k "
    "LEFT JOIN (SELECT run_id, min(pos) AS at FROM control GROUP BY 1) c ON c.run_id = k.run_id",
)
def a07_starts(spark, d):
    """Whether each run's log starts with its start mark, and records of system calls not looked for."""
    cap = _cap(spark, d)
    return quality.log_starts(cap.kernel, cap.control, ["execve", "openat", "connect"])


@query(
    "a07_subsecond_share",
    'SELECT run_id, count(*) AS records, count(*) FILTER ("timestamp" <> floor("timestamp")) AS subsecond FROM audit GROUP BY 1',
)
def a07_share(spark, d):
    return quality.subsecond_share(_cap(spark, d).audit)


@query(
    "a21_capture_counts",
    "SELECT run_id, 'syscall' AS part, syscall AS kind, count(*) AS n FROM kernel GROUP BY 1, 3 "
    "UNION ALL SELECT run_id, 'event_type', event_type, count(*) FROM audit GROUP BY 1, 3",
)
def a21(spark, d):
    cap = _cap(spark, d)
    return quality.capture_counts(cap.kernel, cap.audit)


@query(
    "w08_latest_program",
    "SELECT run_id, session_key, event_id, prog_id FROM programs WHERE source = 'kernel' AND prog_id IS NOT NULL",
)
def w08(spark, d):
    """The latest program query before each kernel event of its session, without time limit."""
    from spoorline.functions.ordered import Fold, running

    _, _, log, _, bound = session_graphs.session_log(_cap(spark, d))
    audit = with_statement_facts(graph.pair_statements(log, bound))
    both = audit.unionByName(log.where("source = 'kernel'"), allowMissingColumns=True)
    fold = {"prog_id": Fold("last", F.when(F.col("is_program"), F.col("query_id")))}
    return (
        running(both, SESSION, "seq", fold, bound)
        .where("source = 'kernel' AND prog_id IS NOT NULL")
        .select(*SESSION, "event_id", "prog_id")
    )


@query(
    "t02_first_orphans",
    "SELECT run_id, session_key, event_id, pid, ppid, comm FROM prep WHERE source = 'kernel' AND parent_pid IS NULL "
    "AND spawn_query IS NULL ORDER BY run_id, event_id LIMIT 5",
)
def t02(spark, d):
    return graph.orphans(_prov(spark, d).graphs.events).orderBy("run_id", "event_id").limit(5)


# --- behaviors and risk


@query(
    "b01_b02_behaviors",
    "SELECT run_id, session_key, label, src_key, dst_key, confidence, s_sem, s_temp, round(timestamp_unix, 6) AS ts FROM found",
)
def b01(spark, d):
    f = _found(spark, d).found
    return f.select(
        *SESSION, "label", "src_key", "dst_key", "confidence", "s_sem", "s_temp",
        F.round("timestamp_unix", 6).alias("ts"),
    )


@query(
    "b03_evidence",
    "SELECT run_id, session_key, src_type AS node_type, src_key AS node_key, behavior, chain_no FROM found "
    "UNION SELECT run_id, session_key, dst_type, dst_key, behavior, chain_no FROM found",
)
def b03(spark, d):
    return B.evidence_edges(_found(spark, d).found).drop("rel")


@query(
    "b04_w07_behavior_chain",
    "SELECT a.run_id, a.session_key, a.chain_no, a.behavior, b.behavior AS next_behavior, round(b.timestamp_unix - a.timestamp_unix, 6) AS gap_s "
    "FROM found a JOIN found b ON b.run_id = a.run_id AND b.session_key = a.session_key AND b.chain_no = a.chain_no + 1",
)
def b04(spark, d):
    chain = _found(spark, d).chain
    return chain.select(
        *SESSION, "chain_no", "behavior", "next_behavior", F.round("gap_s", 6).alias("gap_s")
    )


@query("b05_chain_rules", "SELECT run_id, session_key, scenario, round(rule_score, 9) AS rule_score FROM best")
def b05(spark, d):
    found = _found(spark, d)
    best = risk.best_chain(risk.chain_scores(found.found, bound=found.largest))
    return best.withColumn("rule_score", F.round("rule_score", 9))


_MODEL = "CASE WHEN session_key % 5 < 2 THEN 0.9 ELSE 0.1 END"


def _assessed(spark, d):
    prov = _prov(spark, d)
    model = prov.log.select(*SESSION).distinct().withColumn(
        "gat_score", F.when(F.col("session_key") % 5 < 2, 0.9).otherwise(0.1)
    )
    return session_graphs.assessments(prov, model)


_ASSESSED = f"""SELECT s.run_id, s.session_key, s.n_events, COALESCE(b.rule_score, 0) AS rule_score, b.scenario,
  ({_MODEL.replace('session_key', 's.session_key')})::DOUBLE AS gat_score,
  1 - (1 - 0.75::DOUBLE * COALESCE(b.rule_score, 0)) * (1 - 0.75::DOUBLE * ({_MODEL.replace('session_key', 's.session_key')})::DOUBLE) AS risk
 FROM (SELECT run_id, session_key, count(*) AS n_events FROM slog GROUP BY 1, 2) s
 LEFT JOIN best b ON b.run_id = s.run_id AND b.session_key = s.session_key"""


@query(
    "b06_b07_assessments",
    "SELECT run_id, session_key, n_events, scenario, round(rule_score, 9) AS rule_score, gat_score, round(risk, 9) AS risk, "
    f"CASE WHEN risk >= 0.55 THEN 'alert' ELSE 'benign' END AS status FROM ({_ASSESSED})",
)
def b06(spark, d):
    return _assessed(spark, d).select(
        *SESSION, "n_events", "scenario", F.round("rule_score", 9).alias("rule_score"), "gat_score",
        F.round("risk", 9).alias("risk"), "status",
    )


_BUCKETS = ", ".join(
    f"len(list_filter(hs, lambda h: h = {i}))::DOUBLE AS h{i}" for i in range(features.BUCKETS)
)
_FEATURES = f"""all_nodes AS (SELECT run_id, session_key, node_type, node_key, text, timestamp_unix, 0.0::DOUBLE AS confidence, 0.0::DOUBLE AS s_sem FROM texts
 UNION ALL SELECT run_id, session_key, 'Behavior', chain_no::VARCHAR, label, timestamp_unix, confidence, s_sem FROM found),
evidence AS (SELECT run_id, session_key, src_type, src_key, chain_no FROM found
 UNION SELECT run_id, session_key, dst_type, dst_key, chain_no FROM found),
all_edges AS (SELECT run_id, session_key, src_type, src_key, dst_type, dst_key FROM edges
 UNION ALL SELECT run_id, session_key, src_type, src_key, 'Behavior', chain_no::VARCHAR FROM evidence
 UNION ALL SELECT a.run_id, a.session_key, 'Behavior', a.chain_no::VARCHAR, 'Behavior', b.chain_no::VARCHAR FROM found a
  JOIN found b ON b.run_id = a.run_id AND b.session_key = a.session_key AND b.chain_no = a.chain_no + 1),
hashed AS (SELECT *, list_transform(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: w <> '')),
  lambda w: instr('0123456789abcdef', substr(md5(w), 1, 1)) - 1) AS hs FROM all_nodes)"""


@query(
    "b08_node_features",
    f"SELECT n.run_id, n.session_key, n.node_type, n.node_key, {_BUCKETS}, n.confidence, n.s_sem, "
    "round(n.timestamp_unix / max(n.timestamp_unix) OVER (PARTITION BY n.run_id, n.session_key), 9) AS recency, "
    "COALESCE(i.c, 0)::DOUBLE AS in_degree, COALESCE(o.c, 0)::DOUBLE AS out_degree FROM hashed n "
    "LEFT JOIN (SELECT run_id, session_key, dst_type, dst_key, count(*) AS c FROM all_edges GROUP BY 1, 2, 3, 4) i ON i.run_id = n.run_id "
    "AND i.session_key = n.session_key AND i.dst_type = n.node_type AND i.dst_key = n.node_key "
    "LEFT JOIN (SELECT run_id, session_key, src_type, src_key, count(*) AS c FROM all_edges GROUP BY 1, 2, 3, 4) o ON o.run_id = n.run_id "
    "AND o.session_key = n.session_key AND o.src_type = n.node_type AND o.src_key = n.node_key",
    _FEATURES,
)
def b08(spark, d):
    nodes, edges = _feature_tables(spark, d)
    keep = [f"h{i}" for i in range(features.BUCKETS)] + ["confidence", "s_sem"]
    return features.node_features(nodes, edges).select(
        *graph.NODE, *keep, F.round("recency", 9).alias("recency"), "in_degree", "out_degree"
    )


def _feature_tables(spark, d):
    prov = _prov(spark, d)
    g, found = prov.graphs, session_graphs.session_behaviors(prov)
    nodes = features.all_nodes(g.nodes, found.found)
    edges = features.all_edges(g.edges, B.evidence_edges(found.found), found.chain)
    return nodes, materialize(edges, "feature-edges")


@query("b09_session_scorer")
def b09(spark, d):
    """Scores of a classifier trained on the labelled sessions of four runs in five."""
    nodes, edges = _feature_tables(spark, d)
    nf = materialize(features.node_features(nodes, edges), "node-features")
    pooled = features.pool(features.neighbour_round(nf, edges))
    pooled = materialize(pooled, "pooled")
    labels = _labels(spark, d).select(
        "run_id", F.col("session_id").alias("session_key"), F.col("y").cast("double").alias("y")
    )
    run_no = F.regexp_extract("run_id", r"(\d+)", 1).cast("int")
    model = features.fit_scorer(pooled.where(run_no % 5 > 0), labels)
    return features.score_sessions(model, pooled)


@query(
    "e01_access_then_transfer",
    "SELECT a.run_id, a.session_key, round(a.first_ts, 6) AS first_ts, round(a.then_ts, 6) AS then_ts, a.behaviors FROM ("
    "SELECT run_id, session_key, min(chain_no) FILTER (behavior = 'DATA_ACCESS') AS x, max(chain_no) FILTER (behavior = 'EXTERNAL_TRANSFER') AS y, "
    "min(timestamp_unix) FILTER (behavior = 'DATA_ACCESS') AS first_ts, max(timestamp_unix) FILTER (behavior = 'EXTERNAL_TRANSFER') AS then_ts, "
    "count(*) AS behaviors FROM found GROUP BY 1, 2) a WHERE a.x < a.y",
)
def e01(spark, d):
    """Which sessions read a sensitive table and later sent data out?"""
    out = session_graphs.exfiltration_sessions(
        _found(spark, d).found, "DATA_ACCESS", "EXTERNAL_TRANSFER"
    )
    return out.withColumns({"first_ts": F.round("first_ts", 6), "then_ts": F.round("then_ts", 6)})
