"""Risk of sessions at the ticks of a replay, from intervals of ticks and not from rebuilt graphs.

Tick i falls i times ``every_s`` seconds after the start of a run and knows the events that were
attributed before it. An event that waited for its session shows up later than its place in
the session says, so what a graph holds may change in the past. Three things do:

* the first event of a node, which gives its text and time: a node has versions, each from one
  tick to the next;
* whether the parent of a process is known: its edge appears with the parent's first event;
* the program query taken as origin instead: that edge goes when the parent appears.

Statements are never late, so pairing them and the latest program query stay as they are.
Edges and versions of nodes become intervals of ticks, behaviors the cuts of an edge with versions of
both ends, and the chain rules are evaluated at the ticks at which a session has new events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, Fold, number_rows, running
from spoorline.operators.attribution import SESSION
from spoorline.operators.behaviors import RULES, match_pairs, node_text
from spoorline.operators.graph import EDGE, NODE, PROCESS_CALLS, SPAWN_WINDOW_S, edge_mentions, node_mentions
from spoorline.operators.risk import CHAINS, THETA, assess, best_chain, chain_scores
from spoorline.plans.session_graphs import Provenance
from spoorline.session import materialize

NEVER = (1 << 62) - 1


def shown_events(prov: Provenance, every_s: float, start: DataFrame) -> DataFrame:
    """The session events with the tick at which each is first seen."""
    waited = F.col("resolved_at") != F.col("event_id")
    moments = prov.events.select("run_id", F.col("event_id").alias("resolved_at"), F.col("timestamp_unix").alias("_ts"))
    late = prov.graphs.events.where(waited).select("run_id", "resolved_at").distinct().join(moments, ["run_id", "resolved_at"])
    moment = F.coalesce("_ts", "timestamp_unix")
    return (
        prov.graphs.events.join(late, ["run_id", "resolved_at"], "left")
        .join(start, "run_id")
        .withColumn("tick", F.floor((moment - F.col("start_ts")) / every_s).cast("long") + 1)
        .drop("_ts", "start_ts")
    )


def node_versions(events: DataFrame) -> DataFrame:
    """Per node and first event that holds from tick ``t0`` to before ``t1``: its text and time."""
    per = node_mentions(events).groupBy(*NODE, "tick").agg(F.min("seq").alias("seq"))
    by = Window.partitionBy(*NODE).orderBy("tick")
    before = F.min("seq").over(by.rowsBetween(Window.unboundedPreceding, -1))
    firsts = per.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("seq") < F.col("_b")))
    held = firsts.select(*NODE, "seq", F.col("tick").alias("t0"), F.coalesce(F.lead("tick").over(by), F.lit(NEVER)).alias("t1"))
    said = events.select(*SESSION, "seq", "timestamp_unix", "query", "comm", "arg", "dest_ip")
    return held.join(said, [*SESSION, "seq"]).select(
        *NODE, "t0", "t1", node_text().alias("text"), F.col("timestamp_unix").alias("ts")
    )


def edge_intervals(
    events: DataFrame,
    spawn_window: float = SPAWN_WINDOW_S,
    bound: int | None = None,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """Edges with the ticks from ``t0`` to before ``t1`` at which they are there."""
    none = F.lit(None).cast("long")
    is_process = F.col("syscall").isin(PROCESS_CALLS)
    # when the parent is first seen: the earliest tick of its events before the child's
    own = F.col("parent_pid") == F.col("pid")
    asks = F.col("parent_pid").isNotNull() & ~own
    seen = events.where(is_process).select(*SESSION, F.col("pid").alias("_p"), "seq", F.col("tick").alias("_seen"))
    asked = events.where(asks).select(*SESSION, F.col("parent_pid").alias("_p"), "seq", F.lit(True).alias("_asks"))
    both = seen.unionByName(asked, allowMissingColumns=True)
    known = running(both, [*SESSION, "_p"], "seq", {"known": Fold("min", F.col("_seen"))}, bound and 2 * bound, seg_rows)
    known = known.where("_asks").select(*SESSION, "seq", "known")
    program = F.when(F.col("is_program"), F.struct("query_id", F.col("timestamp_unix").alias("ts")))
    kept = running(events, SESSION, "seq", {"_program": Fold("last", program)}, bound, seg_rows)
    recent = F.col("timestamp_unix") - F.col("_program.ts") < spawn_window
    kept = kept.join(known, [*SESSION, "seq"], "left").withColumns(
        {
            "_query": F.when(is_process & recent, F.col("_program.query_id")),
            "_from": F.when(F.col("parent_pid").isNotNull(), F.greatest("tick", F.coalesce("known", "tick"))),
        }
    )

    def edges(df: DataFrame, t0, t1, parent, spawn) -> DataFrame:
        shown = df.withColumns({"parent_pid": parent, "spawn_query": spawn, "t0": t0, "t1": t1})
        return edge_mentions(shown).join(shown.select(*SESSION, "seq", "t0", "t1"), [*SESSION, "seq"])

    lasting = F.lit(NEVER)
    plain = edges(kept, F.col("tick"), lasting, none, none)
    parents = edges(kept.where("parent_pid IS NOT NULL"), F.col("_from"), lasting, F.col("parent_pid"), none)
    parents = parents.where("rel = 'spawns'")
    until = F.coalesce("_from", lasting)
    origin = kept.where(F.col("_query").isNotNull() & (F.col("tick") < until))
    origins = edges(origin, F.col("tick"), until, none, F.col("_query")).where("rel = 'spawns'")
    every = plain.unionByName(parents).unionByName(origins)
    return every.groupBy(*EDGE, "t1").agg(F.min("t0").alias("t0"))


def tick_behaviors(events: DataFrame, rules=RULES, bound: int | None = None, seg_rows: int = SEG_ROWS) -> DataFrame:
    """Behaviors with the ticks at which they are there, one row per version of their edge's ends."""
    versions = materialize(node_versions(events), "tick-nodes")
    wanted = F.lit(False)
    for r in rules:
        wanted = wanted | (
            (F.col("src_type") == r.src_type) & (F.col("rel") == r.rel) & (F.col("dst_type") == r.dst_type)
        )
    pairs = edge_intervals(events, bound=bound, seg_rows=seg_rows).where(wanted)
    for side in ("src", "dst"):
        ends = versions.select(
            *SESSION, F.col("node_type").alias(f"{side}_type"), F.col("node_key").alias(f"{side}_key"),
            F.col("text").alias(f"{side}_text"), F.col("ts").alias(f"{side}_ts"), F.col("t0").alias("_0"), F.col("t1").alias("_1"),
        )
        pairs = (
            pairs.join(ends, [*SESSION, f"{side}_type", f"{side}_key"])
            .withColumns({"t0": F.greatest("t0", "_0"), "t1": F.least("t1", "_1")})
            .drop("_0", "_1")
            .where("t0 < t1")
        )
    return match_pairs(pairs, rules)


def tick_risks(
    prov: Provenance,
    model_scores: DataFrame,
    every_s: float = 2.0,
    start: DataFrame | None = None,
    rules=RULES,
    chains=CHAINS,
    theta: float = THETA,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """Verdicts of each session at the ticks at which it has new events, the last one its final verdict.

    ``start`` has (run_id, start_ts), by default the first event of each run; ``model_scores`` as in
    `risk.assess`, taken at every tick.
    """
    if start is None:
        start = prov.events.groupBy("run_id").agg(F.min("timestamp_unix").alias("start_ts"))
    events = materialize(shown_events(prov, every_s, start), "tick-events")
    bound = prov.largest_session
    per = events.groupBy(*SESSION, "tick").agg(
        F.count(F.lit(1)).alias("new_events"), F.max("timestamp_unix").alias("last_event_ts")
    )
    folds = {
        "n_events": Fold("sum", F.col("new_events"), inclusive=True),
        "_last": Fold("max", F.col("last_event_ts"), inclusive=True),
    }
    ticks = running(per, SESSION, "tick", folds, None, seg_rows).withColumn("last_event_ts", F.col("_last"))
    ticks = materialize(ticks.drop("_last"), "ticks")
    found = materialize(tick_behaviors(events, rules, bound, seg_rows), "tick-behaviors")
    at = ticks.select(*SESSION, "tick")
    held = found.join(at, SESSION).where("t0 <= tick AND tick < t1").drop("t0", "t1")
    # an edge may be there for two reasons; a tick of a session is a session of its own from here
    held = held.dropDuplicates([*EDGE, "tick", "rule_order"]).withColumn("run_id", _of_tick())
    order = ["timestamp_unix", "rule_order", "src_type", "src_key", "dst_key"]
    ordered, largest = number_rows(held, SESSION, order, "chain_no", seg_rows)
    scores = best_chain(chain_scores(ordered, chains, largest, seg_rows))
    asked = ticks.withColumns({"_run": F.col("run_id"), "run_id": _of_tick()})
    model = model_scores.join(at, SESSION).withColumn("run_id", _of_tick()).drop("tick")
    return assess(asked, scores, model, theta).drop("run_id").withColumnRenamed("_run", "run_id")


def _of_tick():
    return F.concat_ws("#", "run_id", "tick")
