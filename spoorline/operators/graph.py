"""Typed node and edge tables of the session graphs.

A graph is a set of rows keyed by (run_id, session_key). Node keys are strings;
an endpoint's key is "ip:port". Everything is derived from the numbered session
log (`seq` is the position in the session).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, Fold, running
from spoorline.functions.sqlfacts import FACTS, join_statement_facts
from spoorline.operators.attribution import SESSION
from spoorline.session import materialize

SPAWN_WINDOW_S = 5.0
PAGE = 4096

# Node and edge types, and the system calls that make nodes.
NODE_TYPES = ["Session", "Role", "Query", "Table", "Process", "File", "Endpoint"]
EDGE_TYPES = ["executes", "accesses", "spawns", "opens", "connects_to"]
FILE_CALLS = ["openat", "unlink", "rename"]
PROCESS_CALLS = ["execve", "connect", *FILE_CALLS]

NODE = [*SESSION, "node_type", "node_key"]
EDGE = [*SESSION, "src_type", "src_key", "rel", "dst_type", "dst_key"]
ATTRS = [
    "source", "event_id", "event_type", "query", "database", "username", "client_addr",
    "client_port", "pid", "ppid", "uid", "comm", "syscall", "arg", "dest_ip", "dest_port",
]


@dataclass(frozen=True)
class SessionGraphs:
    """Tables of all session graphs, and the events they were made of."""

    events: DataFrame  # the log with facts, merged query ids and spawn sources
    mentions: DataFrame  # one row per event and node it touches
    links: DataFrame  # one row per event and edge it touches
    nodes: DataFrame
    edges: DataFrame


def _audit() -> Column:
    return F.col("source") == "postgres"


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def pair_statements(
    log: DataFrame, bound: int | None = None, seg_rows: int = SEG_ROWS
) -> DataFrame:
    """Audit rows with `query_id`: an ExecutorEnd takes the id of the latest start of its text."""
    keyed = log.where(_audit()).withColumn(
        "_q", F.coalesce(F.concat(F.lit("="), F.col("query")), F.lit(""))
    )
    started = F.when(F.col("event_type") == "ExecutorStart", F.col("event_id"))
    paired = running(
        keyed, [*SESSION, "_q"], "seq", {"_start": Fold("last", started)}, bound, seg_rows
    )
    is_end = F.col("event_type") == "ExecutorEnd"
    return paired.withColumn(
        "query_id", F.when(is_end, F.coalesce("_start", "event_id")).otherwise(F.col("event_id"))
    ).drop("_q", "_start")


def prepared_events(
    log: DataFrame,
    spawn_window: float = SPAWN_WINDOW_S,
    bound: int | None = None,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """The log with statement facts, merged query ids and each process's origin.

    `parent_pid` is set if the parent was seen earlier in the session,
    `spawn_query` if instead a program query ran less than ``spawn_window`` before.
    """
    audit = join_statement_facts(pair_statements(log, bound, seg_rows))
    kernel = log.where(~_audit())
    both = audit.unionByName(kernel, allowMissingColumns=True)
    program = F.when(
        F.col("is_program"), F.struct(F.col("query_id"), F.col("timestamp_unix").alias("ts"))
    )
    both = running(both, SESSION, "seq", {"_program": Fold("last", program)}, bound, seg_rows)
    is_process = F.col("syscall").isin(PROCESS_CALLS)
    seen = (
        both.where(is_process)
        .groupBy(*SESSION, "pid")
        .agg(F.min("seq").alias("_parent_seq"))
        .withColumnRenamed("pid", "_parent")
    )
    wanted = F.when(is_process & (F.col("ppid") != 0), F.col("ppid"))
    known = (F.col("_parent_seq") < F.col("seq")) | (
        (F.col("_parent_seq") == F.col("seq")) & (F.col("ppid") == F.col("pid"))
    )
    recent = F.col("timestamp_unix") - F.col("_program.ts") < spawn_window
    out = (
        both.withColumn("_parent", wanted)
        .join(seen, [*SESSION, "_parent"], "left")
        .withColumn("parent_pid", F.when(known, F.col("_parent")))
    )
    return out.withColumn(
        "spawn_query",
        F.when(is_process & F.col("parent_pid").isNull() & recent, F.col("_program.query_id")),
    ).drop("_parent", "_parent_seq", "_program")


def endpoint_key() -> Column:
    return F.concat_ws(":", "dest_ip", _text("dest_port"))


def _some(cond: Column, *values: Column) -> Column:
    return F.when(cond, F.struct(*values))


def node_mentions(events: DataFrame) -> DataFrame:
    """Zero to three nodes per event, plus the session node of an audit event."""
    call = F.col("syscall")

    def node(kind: str, key: Column):
        return F.lit(kind).alias("node_type"), key.alias("node_key")

    nodes = F.array_compact(
        F.array(
            _some(_audit(), *node("Query", _text("query_id"))),
            _some(_audit(), *node("Session", _text("session_key"))),
            _some(_audit() & (F.col("table_name") != ""), *node("Table", F.col("table_name"))),
            _some(_audit() & (F.col("role_name") != ""), *node("Role", F.col("role_name"))),
            _some(call.isin(PROCESS_CALLS), *node("Process", _text("pid"))),
            _some(call.isin(FILE_CALLS), *node("File", F.coalesce("arg", F.lit("")))),
            _some((call == "connect") & (F.col("dest_ip") != ""), *node("Endpoint", endpoint_key())),
        )
    )
    return events.select("*", F.explode(nodes).alias("_n")).select("*", "_n.*").drop("_n")


def edge_mentions(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The edges an event touches, as (src, rel, dst) rows, with the columns ``keep`` of the event."""
    call, query, pid = F.col("syscall"), _text("query_id"), _text("pid")

    def edge(src, src_key, rel, dst, dst_key):
        return (
            F.lit(src).alias("src_type"),
            src_key.alias("src_key"),
            F.lit(rel).alias("rel"),
            F.lit(dst).alias("dst_type"),
            dst_key.alias("dst_key"),
        )

    process = call.isin(PROCESS_CALLS)
    edges = F.array_compact(
        F.array(
            _some(_audit(), *edge("Session", _text("session_key"), "executes", "Query", query)),
            _some(
                _audit() & (F.col("table_name") != ""),
                *edge("Query", query, "accesses", "Table", F.col("table_name")),
            ),
            _some(
                _audit() & (F.col("role_name") != ""),
                *edge("Query", query, "accesses", "Role", F.col("role_name")),
            ),
            _some(
                process & F.col("parent_pid").isNotNull(),
                *edge("Process", _text("parent_pid"), "spawns", "Process", pid),
            ),
            _some(
                process & F.col("spawn_query").isNotNull(),
                *edge("Query", _text("spawn_query"), "spawns", "Process", pid),
            ),
            _some(
                call.isin(FILE_CALLS),
                *edge("Process", pid, "opens", "File", F.coalesce("arg", F.lit(""))),
            ),
            _some(
                (call == "connect") & (F.col("dest_ip") != ""),
                *edge("Process", pid, "connects_to", "Endpoint", endpoint_key()),
            ),
        )
    )
    return events.select(
        *SESSION,
        "seq",
        "timestamp_unix",
        F.coalesce("query_id", "event_id").alias("event_id"),
        *keep,
        F.explode(edges).alias("_e"),
    ).select(*SESSION, "_e.*", "seq", "timestamp_unix", "event_id", *keep)


def merge_nodes(mentions: DataFrame, events: DataFrame) -> DataFrame:
    """One row per node: attributes of its first event, time of its last repeat.

    Only keys and numbers are aggregated; the attributes are fetched once per
    node from the event at the node's first position.
    """
    repeat = (F.count(F.lit(1)) > 1) & (F.col("node_type") != "Session")
    first = mentions.groupBy(*NODE).agg(
        F.min("seq").alias("seq"),
        F.when(repeat, F.max("timestamp_unix")).alias("last_seen"),
        F.count(F.lit(1)).alias("mentions"),
    )
    attributes = events.select(*SESSION, "seq", "timestamp_unix", *ATTRS, *FACTS)
    return first.join(attributes, [*SESSION, "seq"]).drop("seq")


def merge_edges(links: DataFrame) -> DataFrame:
    """One row per distinct edge: number of events, first and last time."""
    return links.groupBy(*EDGE).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp_unix").alias("first_seen"),
        F.max("timestamp_unix").alias("last_seen"),
    )


def edge_event_pages(links: DataFrame, page: int = PAGE) -> DataFrame:
    """Event ids of every edge in order, in arrays of bounded length (page 0, 1, …)."""
    return (
        links.withColumn("page", F.expr(f"seq div {page}"))
        .groupBy(*EDGE, "page")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "event_id"))).alias("_e"))
        .select(*EDGE, "page", F.transform("_e", lambda x: x["event_id"]).alias("event_ids"))
    )


def orphans(events: DataFrame) -> DataFrame:
    """Processes without a known parent and without a program query before them."""
    return events.where(
        F.col("syscall").isin(PROCESS_CALLS)
        & F.col("parent_pid").isNull()
        & F.col("spawn_query").isNull()
    ).select(*SESSION, "event_id", "pid", "ppid", "comm")


def parse_errors(events: DataFrame) -> DataFrame:
    return events.where(F.col("parse_error").isNotNull()).select(
        *SESSION, F.col("query_id").alias("event_id"), F.col("parse_error").alias("error"), "query"
    )


def build_graphs(
    log: DataFrame,
    spawn_window: float = SPAWN_WINDOW_S,
    bound: int | None = None,
    seg_rows: int = SEG_ROWS,
) -> SessionGraphs:
    events = materialize(prepared_events(log, spawn_window, bound, seg_rows), "session_events")
    mentions, links = node_mentions(events), edge_mentions(events)
    return SessionGraphs(events, mentions, links, merge_nodes(mentions, events), merge_edges(links))


def session_manifest(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per session: node and edge counts, and its label or "unknown"."""
    n = nodes.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("edge_count"))
    named = labels.select("run_id", F.col("session_id").alias("session_key"), "label")
    return (
        n.join(e, SESSION, "left")
        .join(named, SESSION, "left")
        .select(
            *SESSION,
            F.coalesce("label", F.lit("unknown")).alias("label"),
            "node_count",
            F.coalesce("edge_count", F.lit(0)).alias("edge_count"),
        )
    )


def type_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of node types and edge relations per session."""
    parts = [
        nodes.select(*SESSION, F.lit("node").alias("part"), F.col("node_type").alias("kind")),
        edges.select(*SESSION, F.lit("edge").alias("part"), F.col("rel").alias("kind")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*SESSION, "part", "kind").count()


def flat_attributes(df: DataFrame) -> DataFrame:
    """Booleans, arrays, maps and structs as text and null as "" (text columns only)."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType.typeName()
        if kind == "boolean":
            c = F.coalesce(F.initcap(c.cast("string")), F.lit(""))
        elif kind in ("array", "map", "struct"):
            c = F.coalesce(F.to_json(c), F.lit(""))
        elif kind == "string":
            c = F.coalesce(c, F.lit(""))
        else:
            c = F.coalesce(c.cast("string"), F.lit(""))
        out.append(c.alias(field.name))
    return df.select(*out)
