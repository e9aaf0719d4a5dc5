"""Behavior nodes of a session graph, their evidence and their order in time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, Fold, number_rows, running
from spoorline.operators.attribution import SESSION
from spoorline.operators.graph import EDGE, NODE
from spoorline.session import materialize

DECAY_S = 60.0
STRUCT_WEIGHT = 0.4
SEM_WEIGHT = 0.6


@dataclass(frozen=True)
class Rule:
    """A pattern of two nodes joined by an edge.

    ``src`` and ``dst`` are regular expressions on the node texts. With
    ``needs_keyword`` at least one keyword has to occur in the texts.
    """

    label: str
    mitre: str
    src_type: str
    rel: str
    dst_type: str
    keywords: tuple[str, ...]
    src: str = ""
    dst: str = ""
    needs_keyword: bool = False


# Behavior labels, technique ids, edge patterns, in rule order.
RULES = (
    Rule(
        "DATA_ACCESS", "N/A", "Query", "accesses", "Table",
        ("accounts", "audit_logs", "columns", "customers", "pg_authid", "tables"),
        needs_keyword=True,
    ),
    Rule(
        "DESTRUCTIVE_DB_OPERATION", "T1485", "Query", "accesses", "Table",
        ("truncate", "delete", "drop", "table", "audit_logs"),
        src=r"(?i)^\s*(?:TRUNCATE|DELETE)\b", dst=r"^audit_logs$",
    ),
    Rule(
        "DEFENSE_IMPAIRMENT", "T1562", "Query", "accesses", "Table",
        ("audit_logs", "truncate", "delete", "log_statement"),
        src=r"(?i)^\s*(?:TRUNCATE|DELETE)\b", dst=r"^audit_logs$",
    ),
    Rule(
        "UNIX_SHELL_EXECUTION", "T1059.004", "Query", "spawns", "Process",
        ("copy", "program", "sh", "bash", "execute", "command"),
    ),
    Rule(
        "EXTERNAL_TRANSFER", "T1048", "Process", "connects_to", "Endpoint",
        ("curl", "wget", "nc", "post", "upload"),
    ),
    Rule(
        "POTENTIAL_INGRESS_TOOL_TRANSFER", "T1105", "Process", "connects_to", "Endpoint",
        ("curl", "wget", "http", "https", "download"),
    ),
    Rule(
        "DATA_PACKAGING", "T1560.001", "Process", "opens", "File",
        ("gzip", "archive", "compress", "tmp"),
        src=r"^gzip\b",
    ),
)


@dataclass(frozen=True)
class Behaviors:
    """``found``: one row per behavior; ``chain``: consecutive behaviors of a session."""

    found: DataFrame
    chain: DataFrame
    largest: int = field(default=0)


def node_text() -> Column:
    """The text that describes a node: statement, name, command line, path or address."""
    kind = F.col("node_type")
    return (
        F.when(kind == "Query", F.coalesce("query", F.lit("")))
        .when(kind == "Process", F.concat_ws(" ", "comm", "arg"))
        .when(kind == "Endpoint", F.coalesce("dest_ip", F.lit("")))
        .otherwise(F.col("node_key"))
    )


def words(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != ""))


def cosine(found: Column, keywords: tuple[str, ...]) -> Column:
    """Overlap of two word sets: shared words over the geometric mean of their sizes."""
    wanted = F.array(*[F.lit(k) for k in keywords])
    shared = F.size(F.array_intersect(found, wanted))
    return F.coalesce(
        shared / F.nullif(F.sqrt((F.size(found) * len(keywords)).cast("double")), F.lit(0.0)),
        F.lit(0.0),
    )


def evidence_pairs(nodes: DataFrame, edges: DataFrame, rules=RULES, keep=()) -> DataFrame:
    """Edges that some rule may match, with text and time of both ends, and the columns ``keep``."""
    wanted = None
    for r in rules:
        hit = (
            (F.col("src_type") == r.src_type)
            & (F.col("rel") == r.rel)
            & (F.col("dst_type") == r.dst_type)
        )
        wanted = hit if wanted is None else wanted | hit
    ends = nodes.select(*NODE, node_text().alias("text"), F.col("timestamp_unix").alias("ts"))

    def end(side):
        return ends.select(
            *SESSION,
            F.col("node_type").alias(f"{side}_type"),
            F.col("node_key").alias(f"{side}_key"),
            F.col("text").alias(f"{side}_text"),
            F.col("ts").alias(f"{side}_ts"),
        )

    picked = edges.where(wanted).select(*EDGE, *keep)
    for side in ("src", "dst"):
        picked = picked.join(end(side), [*SESSION, f"{side}_type", f"{side}_key"])
    return picked


def match_behaviors(
    nodes: DataFrame, edges: DataFrame, rules=RULES, min_confidence: float = 0.0
) -> DataFrame:
    """One row per rule and matching edge, with its scores."""
    return match_pairs(evidence_pairs(nodes, edges, rules), rules, min_confidence)


def match_pairs(pairs: DataFrame, rules=RULES, min_confidence: float = 0.0) -> DataFrame:
    """The same over edges with text and time of both ends; other columns stay."""
    pairs = pairs.withColumn("_words", words(F.concat_ws(" ", "src_text", "dst_text")))
    hits = []
    for order, r in enumerate(rules):
        sem = cosine(F.col("_words"), r.keywords)
        cond = (
            (F.col("src_type") == r.src_type)
            & (F.col("rel") == r.rel)
            & (F.col("dst_type") == r.dst_type)
        )
        if r.src:
            cond = cond & F.col("src_text").rlike(r.src)
        if r.dst:
            cond = cond & F.col("dst_text").rlike(r.dst)
        if r.needs_keyword:
            cond = cond & (sem > 0)
        hits.append(
            F.when(
                cond,
                F.struct(
                    F.lit(order).alias("rule_order"),
                    F.lit(r.label).alias("behavior"),
                    F.lit(r.mitre).alias("mitre_id"),
                    sem.alias("sem"),
                ),
            )
        )
    gap = F.abs(F.col("src_ts") - F.col("dst_ts"))
    sem, struct = F.col("sem"), F.lit(1.0)
    confidence = F.round(STRUCT_WEIGHT * struct + SEM_WEIGHT * sem, 3)
    return (
        pairs.select("*", F.explode(F.array_compact(F.array(*hits))).alias("_hit"))
        .select("*", "_hit.*")
        .withColumns(
            {
                "label": F.concat(F.lit("["), "mitre_id", F.lit("] "), "behavior"),
                "confidence": confidence,
                "s_struct": struct,
                "s_sem": F.round(sem, 3),
                "s_temp": F.round(F.exp(-gap / DECAY_S), 3),
                "timestamp_unix": F.greatest("src_ts", "dst_ts"),
            }
        )
        .where(F.col("confidence") >= min_confidence)
        .drop("_hit", "_words", "sem", "src_text", "dst_text")
    )


def evidence_edges(found: DataFrame) -> DataFrame:
    """Each matched node —evidence_for→ its behavior."""
    sides = [
        F.struct(F.col(f"{s}_type").alias("node_type"), F.col(f"{s}_key").alias("node_key"))
        for s in ("src", "dst")
    ]
    return found.select(
        *SESSION, "behavior", "chain_no", F.explode(F.array_distinct(F.array(*sides))).alias("_n")
    ).select(*SESSION, "_n.*", F.lit("evidence_for").alias("rel"), "behavior", "chain_no")


def order_behaviors(
    found: DataFrame, bound: int | None = None, seg_rows: int = SEG_ROWS
) -> tuple[DataFrame, int]:
    """Number the behaviors of a session by time; ties keep the rule order."""
    order = ["timestamp_unix", "rule_order", "src_type", "src_key", "dst_key"]
    return number_rows(found, SESSION, order, "chain_no", seg_rows, bound)


def chain_edges(
    ordered: DataFrame, bound: int | None = None, seg_rows: int = SEG_ROWS
) -> DataFrame:
    """behavior —precedes→ the next behavior of the session."""
    nxt = F.struct(
        F.col("chain_no").alias("no"), "behavior", F.col("timestamp_unix").alias("ts")
    )
    ahead = running(
        ordered, SESSION, "chain_no", {"_next": Fold("last", nxt)}, bound, seg_rows, reverse=True
    )
    return ahead.where(F.col("_next").isNotNull()).select(
        *SESSION,
        "chain_no",
        "behavior",
        F.lit("precedes").alias("rel"),
        F.col("_next.no").alias("next_no"),
        F.col("_next.behavior").alias("next_behavior"),
        (F.col("_next.ts") - F.col("timestamp_unix")).alias("gap_s"),
    )


def behaviors(
    nodes: DataFrame,
    edges: DataFrame,
    rules=RULES,
    min_confidence: float = 0.0,
    bound: int | None = None,
    seg_rows: int = SEG_ROWS,
) -> Behaviors:
    """``bound`` is a proven limit of a session's behaviors, or None."""
    found, largest = order_behaviors(
        match_behaviors(nodes, edges, rules, min_confidence), bound, seg_rows
    )
    found = materialize(found, "behaviors")  # rules, evidence and chain read it apart
    return Behaviors(found, chain_edges(found, largest, seg_rows), largest)
