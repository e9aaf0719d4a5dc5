"""From raw logs to assessed sessions, as one chain of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS
from spoorline.operators.attribution import SESSION, attribute, attributed_events
from spoorline.operators.behaviors import RULES, Behaviors, behaviors
from spoorline.operators.clock import master_log
from spoorline.operators.graph import SPAWN_WINDOW_S, SessionGraphs, build_graphs
from spoorline.operators.risk import CHAINS, THETA, assess, best_chain, chain_scores
from spoorline.session import materialize


@dataclass(frozen=True)
class Provenance:
    """Numbered log, attribution pairs, session log and graphs, with proven group sizes."""

    events: DataFrame
    pairs: DataFrame
    log: DataFrame
    graphs: SessionGraphs
    largest_run: int
    largest_session: int


def session_log(cap, seg_rows: int = SEG_ROWS):
    events, run_rows = master_log(cap, seg_rows)
    pairs = attribute(events, bound=run_rows, seg_rows=seg_rows)
    if run_rows > seg_rows:
        pairs = materialize(pairs, "pairs")
    log, rows = attributed_events(events, pairs, run_rows, seg_rows)
    return events, pairs, log, run_rows, rows


def provenance(
    cap, spawn_window: float = SPAWN_WINDOW_S, seg_rows: int = SEG_ROWS
) -> Provenance:
    events, pairs, log, run_rows, rows = session_log(cap, seg_rows)
    log = materialize(log, "session_log")  # its statements, processes and cuts are read apart
    graphs = build_graphs(log, spawn_window, rows, seg_rows)
    return Provenance(events, pairs, log, graphs, run_rows, rows)


def most_behaviors(prov: Provenance, rules=RULES) -> int:
    """An event touches at most two edges, and a rule matches an edge at most once."""
    return 2 * len(rules) * prov.largest_session


def session_behaviors(
    prov: Provenance, rules=RULES, min_confidence: float = 0.0, seg_rows: int = SEG_ROWS
) -> Behaviors:
    bound = most_behaviors(prov, rules)
    return behaviors(prov.graphs.nodes, prov.graphs.edges, rules, min_confidence, bound, seg_rows)


def session_activity(events: DataFrame) -> DataFrame:
    return events.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("timestamp_unix").alias("last_event_ts")
    )


def assessments(
    prov: Provenance,
    model_scores: DataFrame,
    chains=CHAINS,
    theta: float = THETA,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """One verdict per session. ``model_scores`` has (run_id, session_key, gat_score)."""
    found = session_behaviors(prov, seg_rows=seg_rows)
    rules = best_chain(chain_scores(found.found, chains, found.largest, seg_rows))
    return assess(session_activity(prov.graphs.events), rules, model_scores, theta)


def exfiltration_sessions(found: DataFrame, first: str, then: str) -> DataFrame:
    """Sessions with behavior ``first`` and later ``then``, with both times."""
    a = F.min(F.when(F.col("behavior") == first, F.col("chain_no")))
    b = F.max(F.when(F.col("behavior") == then, F.col("chain_no")))
    return (
        found.groupBy(*SESSION)
        .agg(
            a.alias("_a"),
            b.alias("_b"),
            F.min(F.when(F.col("behavior") == first, F.col("timestamp_unix"))).alias("first_ts"),
            F.max(F.when(F.col("behavior") == then, F.col("timestamp_unix"))).alias("then_ts"),
            F.count(F.lit(1)).alias("behaviors"),
        )
        .where("_a < _b")
        .drop("_a", "_b")
    )
