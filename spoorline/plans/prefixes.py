"""Prefixes of sessions: what was known when only k statements had begun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, Fold, number_rows, running
from spoorline.functions.sqlfacts import FACTS
from spoorline.operators.attribution import SESSION
from spoorline.operators.behaviors import RULES, evidence_pairs, match_pairs
from spoorline.operators.graph import ATTRS, EDGE, NODE, SessionGraphs


def statement_ordinal(log: DataFrame, bound: int | None = None, seg_rows: int = SEG_ROWS) -> DataFrame:
    """Add `stmt_no`: statements begun up to and including the row."""
    begins = (F.col("source") == "postgres") & ~F.col("event_type").eqNullSafe("ExecutorEnd")
    fold = {"stmt_no": Fold("sum", begins.cast("long"), inclusive=True)}
    return running(log, SESSION, "seq", fold, bound, seg_rows)


def prefix_points(n: Column, max_prefixes: int = 3, padding: int = 2) -> Column:
    """Cut points below n: 1..padding, then evenly spaced ones, at most max_prefixes."""
    lead = F.filter(
        F.sequence(F.lit(1), F.lit(max(padding, 1))), lambda k: (k < n) & (k <= padding)
    )
    left = F.greatest(n - 1 - padding, F.lit(0))
    room = F.lit(max_prefixes) - F.size(lead)
    spread = F.when(
        (room > 0) & (left > 0),
        F.transform(
            F.sequence(F.lit(0), F.greatest(room - 1, F.lit(0))),
            lambda i: (
                F.lit(padding + 1)
                + F.least(left - 1, F.floor(i * (left / room) + (left / room) / 2))
            ).cast("int"),
        ),
    ).otherwise(F.array().cast("array<int>"))
    points = F.concat(lead, F.array_sort(F.array_distinct(spread)))
    return F.slice(points, 1, max_prefixes)


def prefix_corpus(
    log: DataFrame,
    labels: DataFrame,
    max_prefixes: int = 3,
    padding: int = 2,
    bound: int | None = None,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """One row per session and cut k: statements, events in the prefix, and its label.

    ``labels`` has (run_id, session_key, label). A prefix is benign while it
    only holds padding.
    """
    numbered = statement_ordinal(log, bound, seg_rows)
    sizes = numbered.groupBy(*SESSION, "stmt_no").agg(F.count(F.lit(1)).alias("_rows"))
    total = sizes.groupBy(*SESSION).agg(F.max("stmt_no").alias("statements"))
    cuts = total.join(labels, SESSION).select(
        "*", F.explode(prefix_points(F.col("statements"), max_prefixes, padding)).alias("k")
    )
    y = F.when(F.col("k") <= padding, F.lit("Benign")).otherwise(F.col("label"))
    return (
        cuts.join(sizes, SESSION)
        .where("stmt_no <= k")
        .groupBy(*SESSION, "k", "statements", "label")
        .agg(F.sum("_rows").alias("events"))
        .withColumn("prefix_label", y)
    )


def session_cuts(
    log: DataFrame,
    labels: DataFrame,
    max_prefixes: int = 3,
    padding: int = 2,
    full: bool = True,
    bound: int | None = None,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """Per session: its cuts in order, as arrays ``ks`` and ``ends`` (first position outside).

    At most ``max_prefixes`` cuts a session, and the whole session (k null) if ``full``.
    """
    begins = (F.col("source") == "postgres") & ~F.col("event_type").eqNullSafe("ExecutorEnd")
    starts = statement_ordinal(log, bound, seg_rows).where(begins).select(*SESSION, "stmt_no", "seq")
    total = log.groupBy(*SESSION).agg(F.count_if(begins).alias("statements")).join(labels, SESSION)
    points = total.withColumn("ks", prefix_points(F.col("statements").cast("int"), max_prefixes, padding))
    # the position of statement k + 1 ends prefix k
    next_ = points.select(*SESSION, F.posexplode("ks").alias("at", "k")).withColumn("stmt_no", F.col("k") + 1)
    ends = (
        next_.join(starts, [*SESSION, "stmt_no"])
        .groupBy(*SESSION)
        .agg(F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("_e"))
    )
    none = F.array().cast("array<bigint>")
    out = points.join(ends, SESSION, "left").select(
        *SESSION, "statements", "label", F.col("ks").cast("array<int>").alias("ks"),
        F.coalesce(F.transform("_e", lambda e: e["seq"]), none).alias("ends"),
    )
    if full:
        last = F.array(F.lit((1 << 63) - 1))
        out = out.withColumns(
            {"ks": F.concat("ks", F.array(F.lit(None).cast("int"))), "ends": F.concat("ends", last)}
        )
    return out.where(F.size("ks") > 0)


def _versions(rows: DataFrame, key: list[str], cuts: DataFrame, first: dict, running_: dict) -> DataFrame:
    """Per key and cut: ``first`` of the key's earliest cut, and the ``running_`` aggregates up to the cut.

    ``rows`` have `seq`. They are aggregated per key and the first cut that holds them; a window
    over these few rows runs on, and each stands for the cuts up to the next.
    """
    held = (
        rows.join(cuts.select(*SESSION, "ends"), SESSION)
        .withColumn("_at", F.size(F.filter("ends", lambda e: e <= F.col("seq"))))
        .where(F.col("_at") < F.size("ends"))
    )
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    per = held.groupBy(*key, "_at", F.size("ends").alias("_n")).agg(
        *[kinds[k](e).alias(n) for n, (k, e) in running_.items()], *[e.alias(n) for n, e in first.items()]
    )
    upto = Window.partitionBy(*key).orderBy("_at")
    grown = per.select(
        *key,
        *[kinds[k](n).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, (k, _) in running_.items()],
        *[F.first(n).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in first],
        "_at",
        (F.coalesce(F.lead("_at").over(upto), F.col("_n")) - 1).alias("_last"),
    )
    grown = grown.withColumn("_cut", F.explode(F.sequence("_at", "_last"))).drop("_at", "_last")
    return grown.join(cuts.select(*SESSION, "ks"), SESSION).withColumn("k", F.get("ks", F.col("_cut"))).drop("ks")


def prefix_labels(cuts: DataFrame, padding: int = 2) -> DataFrame:
    """One row per session and cut: k (null for the whole session), statements, label, prefix_label."""
    named = cuts.select(*SESSION, "statements", "label", F.explode("ks").alias("k"))
    y = F.when(F.col("k") <= padding, F.lit("Benign")).otherwise(F.col("label"))
    return named.withColumn("prefix_label", y)


def prefix_nodes(graphs: SessionGraphs, cuts: DataFrame) -> DataFrame:
    """Nodes of the graphs of all ``cuts`` (`session_cuts`, written) from one pass over the mentions.

    What an event means depends on earlier events only, so it is the same in every prefix that
    holds it. A node has the attributes of its first event in all of them, a repeat time and count
    per cut.
    """
    nodes = _versions(
        graphs.mentions.select(*NODE, "seq", "timestamp_unix"),
        NODE,
        cuts,
        {"first_seq": F.min("seq")},
        {"last_ts": ("max", F.col("timestamp_unix")), "mentions": ("sum", F.lit(1))},
    )
    repeat = (F.col("mentions") > 1) & (F.col("node_type") != "Session")
    attributes = graphs.events.select(*SESSION, F.col("seq").alias("first_seq"), "timestamp_unix", *ATTRS, *FACTS)
    return (
        nodes.withColumn("last_seen", F.when(repeat, F.col("last_ts")))
        .join(attributes, [*SESSION, "first_seq"])
        .drop("last_ts", "first_seq", "_cut")
    )


def prefix_edges(graphs: SessionGraphs, cuts: DataFrame) -> DataFrame:
    """Edges of the graphs of all ``cuts``, with count and times up to the cut."""
    totals = {
        "count": ("sum", F.lit(1)),
        "first_seen": ("min", F.col("timestamp_unix")),
        "last_seen": ("max", F.col("timestamp_unix")),
    }
    return _versions(graphs.links, EDGE, cuts, {}, totals).drop("_cut")


def prefix_behaviors(
    graphs: SessionGraphs, cuts: DataFrame, rules=RULES, bound: int | None = None, seg_rows: int = SEG_ROWS
) -> DataFrame:
    """Behaviors of all ``cuts`` in their order; ``bound`` is a proven limit of a session's behaviors.

    Texts and times of nodes never change: behaviors come from the edges of the whole session once, and
    stand in every cut that has the edge.
    """
    first = graphs.links.groupBy(*EDGE).agg(F.min("seq").alias("_first"))
    since = (
        first.join(cuts.select(*SESSION, "ks", "ends"), SESSION)
        .withColumn("_since", F.size(F.filter("ends", lambda e: e <= F.col("_first"))))
        .where(F.col("_since") < F.size("ends"))
    )
    held = match_pairs(evidence_pairs(graphs.nodes, since, rules, ["ks", "_since"]), rules)
    each = held.select("*", F.explode(F.sequence("_since", F.size("ks") - 1)).alias("_cut"))
    each = each.withColumn("k", F.get("ks", F.col("_cut"))).drop("ks", "_since")
    order = ["timestamp_unix", "rule_order", "src_type", "src_key", "dst_key"]
    ordered, _ = number_rows(each, [*SESSION, "_cut"], order, "chain_no", seg_rows, bound)
    return ordered.drop("_cut")
