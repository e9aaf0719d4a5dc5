"""Attribution of events to database sessions through process lineage.

The log is a sequence of events per run. An audit event belongs to its own
session and makes it active from then on. A kernel event belongs to the first
active session met when walking from its pid to its parents; parent links are
those known at that moment. If the walk fails it is tried again at each later
audit event, for at most ``retry_window`` seconds.

Instead of replaying the log, walks become rows. A parent link holds from the
event that states it until the pid states another parent. A path from a pid to
a session then holds on an interval of event numbers: from the latest start of
its links and of the session, to the earliest end of its links. The paths are
found by climbing from each process with equi-joins over links (small: one row
per process and parent), each step keeping the interval of the steps below it.
A kernel event meets each path of its pid at one moment only: at once if the
path holds, else at the first audit event after the path's start. The earliest
moment wins, then the shortest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, Fold, number_rows, running
from spoorline.session import materialize

D_MAX = 8
RETRY_WINDOW_S = 20.0
NEVER = (1 << 63) - 1
SESSION = ["run_id", "session_key"]


def _is_audit():
    return F.col("source") == "postgres"


def session_of_audit():
    return F.coalesce(F.col("session_id"), F.col("pid"))


def parent_links(
    events: DataFrame, bound: int | None = None, seg_rows: int = SEG_ROWS
) -> DataFrame:
    """(run, pid, ppid) with the event interval [since, until) in which the link holds."""
    stated = events.where(
        (~_is_audit()) & (F.col("pid") != 0) & (F.coalesce(F.col("ppid"), F.lit(0)) != 0)
    ).select("run_id", "pid", "ppid", F.col("event_id").alias("since"))
    keys = ["run_id", "pid"]
    before = {"was": Fold("last", F.col("ppid"))}
    changes = running(stated, keys, "since", before, bound, seg_rows).where(
        F.col("was").isNull() | (F.col("was") != F.col("ppid"))
    )
    after = {"until": Fold("last", F.col("since"))}
    return running(changes.drop("was"), keys, "since", after, bound, seg_rows, reverse=True).select(
        "run_id", "pid", "ppid", "since", F.coalesce("until", F.lit(NEVER)).alias("until")
    )


def _next_audit(
    events: DataFrame, links: DataFrame, bound: int | None, seg_rows: int
) -> DataFrame:
    """Links with `ready`: number and time of the first audit event after the link's start."""
    audits = events.where(_is_audit()).select(
        "run_id",
        F.col("event_id").alias("since"),
        F.struct(F.col("event_id").alias("id"), F.col("timestamp_unix").alias("ts")).alias("mark"),
    )
    no_audit = F.struct(F.lit(NEVER).alias("id"), F.lit(float("inf")).alias("ts"))
    both = links.unionByName(audits, allowMissingColumns=True)
    fold = {"ready": Fold("last", F.col("mark"))}
    return (
        running(both, ["run_id"], "since", fold, bound, seg_rows, reverse=True)
        .where(F.col("pid").isNotNull())
        .withColumn("ready", F.coalesce("ready", no_audit))
        .drop("mark")
    )


def session_paths(
    events: DataFrame,
    d_max: int = D_MAX,
    bound: int | None = None,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """(run, pid, session, hops) with [since, until) and the first audit event `ready`."""
    links = materialize(
        _next_audit(events, parent_links(events, bound, seg_rows), bound, seg_rows), "links"
    )
    up = links.select(
        "run_id",
        F.col("pid").alias("via"),
        F.col("ppid").alias("next"),
        F.col("since").alias("l_since"),
        F.col("until").alias("l_until"),
        F.col("ready").alias("l_ready"),
    )
    step = F.struct(F.col("ppid").alias("ancestor"), "since", "until", "ready")
    walk = links.select("run_id", "pid", F.col("ppid").alias("via"), step.alias("h1"))
    for hop in range(2, d_max):
        last = f"h{hop - 1}"
        longer = F.struct(
            F.col("next").alias("ancestor"),
            F.greatest(f"{last}.since", "l_since").alias("since"),
            F.least(f"{last}.until", "l_until").alias("until"),
            F.greatest(f"{last}.ready", "l_ready").alias("ready"),
        )
        meets = (F.col("l_since") < F.col(f"{last}.until")) & (
            F.col(f"{last}.since") < F.col("l_until")
        )
        hops = [f"h{i}" for i in range(1, hop)]
        joined = walk.alias("w").join(
            up.alias("u"),
            (F.col("w.run_id") == F.col("u.run_id")) & (F.col("w.via") == F.col("u.via")) & meets,
            "left",
        )
        # a walk that has ended gets a key that matches nothing and spreads evenly
        walk = joined.select(
            "w.run_id",
            "w.pid",
            F.coalesce("next", -F.col("w.pid") - 1).alias("via"),
            *hops,
            F.when(F.col("next").isNotNull(), longer).alias(f"h{hop}"),
        )
    every = F.array_compact(F.array(*[f"h{i}" for i in range(1, d_max)]))
    climbed = walk.select("run_id", "pid", F.posexplode(every).alias("hops", "h")).select(
        "run_id",
        "pid",
        F.col("h.ancestor").alias("session_key"),
        (F.col("hops") + 1).alias("hops"),
        *[F.col(f"h.{n}").alias(f"h_{n}") for n in ("since", "until", "ready")],
    )
    sessions = session_starts(events)
    reached = climbed.join(sessions, ["run_id", "session_key"]).select(
        "run_id",
        "pid",
        "session_key",
        "hops",
        F.greatest("since", "h_since").alias("since"),
        F.col("h_until").alias("until"),
        F.greatest("ready", "h_ready").alias("ready"),
    )
    own = sessions.select(
        "run_id",
        F.col("session_key").alias("pid"),
        "session_key",
        F.lit(0).alias("hops"),
        "since",
        F.lit(NEVER).alias("until"),
        "ready",
    )
    return own.unionByName(reached.where("since < until"))


def session_starts(events: DataFrame) -> DataFrame:
    """Sessions a kernel event can reach, with the first audit event of each."""
    mark = F.struct(F.col("event_id").alias("id"), F.col("timestamp_unix").alias("ts"))
    return (
        events.where(_is_audit())
        .select("run_id", session_of_audit().alias("session_key"), mark.alias("mark"))
        .where(F.col("session_key") != 0)
        .groupBy("run_id", "session_key")
        .agg(F.min("mark").alias("ready"))
        .select("run_id", "session_key", F.col("ready.id").alias("since"), "ready")
    )


def attribute(
    events: DataFrame,
    d_max: int = D_MAX,
    retry_window: float = RETRY_WINDOW_S,
    bound: int | None = None,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """(run_id, event_id, session_key) of every event that belongs to a session.

    `resolved_at` is the event at which the session became known.
    """
    own = events.where(_is_audit()).select(
        "run_id",
        "event_id",
        session_of_audit().alias("session_key"),
        F.col("event_id").alias("resolved_at"),
    )
    kernel = events.where(~_is_audit()).select("run_id", "event_id", "pid", "timestamp_unix")
    paths = session_paths(events, d_max, bound, seg_rows)
    at = F.when(F.col("since") <= F.col("event_id"), F.col("event_id")).otherwise(
        F.col("ready.id")
    )
    in_time = (F.col("since") <= F.col("event_id")) | (
        F.col("ready.ts") - F.col("timestamp_unix") <= retry_window
    )
    walked = (
        kernel.join(paths, ["run_id", "pid"])
        .withColumn("at", at)
        .where((F.col("at") < F.col("until")) & in_time)
        .groupBy("run_id", "event_id")
        .agg(F.min(F.struct("at", "hops", "session_key")).alias("first"))
        .select(
            "run_id",
            "event_id",
            F.col("first.session_key").alias("session_key"),
            F.col("first.at").alias("resolved_at"),
        )
    )
    return own.unionByName(walked)


def attributed_events(
    events: DataFrame, pairs: DataFrame, bound: int | None = None, seg_rows: int = SEG_ROWS
) -> tuple[DataFrame, int]:
    """The event records of sessions, numbered by `seq` in session order.

    Events of equal time keep the order in which their session became known:
    the event that reveals a session comes before the ones that waited for it.
    """
    joined = events.join(pairs, ["run_id", "event_id"]).withColumn(
        "waited", F.col("resolved_at") != F.col("event_id")
    )
    order = ["timestamp_unix", "resolved_at", "waited", "event_id"]
    return number_rows(joined, SESSION, order, "seq", seg_rows, bound)


def attribution_report(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per run: linked and total events of each source, distinct sessions."""
    marked = events.select("run_id", "event_id", "source").join(
        pairs, ["run_id", "event_id"], "left"
    )
    linked = F.col("session_key").isNotNull()
    kernel = F.col("source") == "kernel"
    return marked.groupBy("run_id").agg(
        F.count_if(~kernel & linked).alias("audit_linked"),
        F.count_if(~kernel).alias("audit_total"),
        F.count_if(kernel & linked).alias("kernel_linked"),
        F.count_if(kernel).alias("kernel_total"),
        F.countDistinct("session_key").alias("sessions"),
    )
