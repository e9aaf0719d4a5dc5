"""Queries that run as streams to the end of their input, but for those of the live engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.operators.attribution import SESSION
from spoorline.plans import session_graphs, ticks
from spoorline.registry.oracle import CTES, chain_ctes, with_ctes
from spoorline.session import fresh_path
from spoorline.sources import logs, tables
from spoorline.streaming import windows
from spoorline.streaming.live import raw_stream

QUERIES, ORACLE = {}, {}


def query(name, sql=None, plain=False):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql if plain else with_ctes(sql)
        return fn

    return add


@query(
    "r02_malformed_lines",
    "SELECT 'run_' || conv_id % 3 AS run_id, count(*) FILTER (role = 'user') AS malformed, count(*) FILTER (role <> 'user') AS events "
    "FROM conversations GROUP BY 1",
    plain=True,
)
def r02(spark, d):
    """A followed log with lines that are no JSON: the stream sets them aside, here the user turns."""
    root = fresh_path(spark, "lines")
    turns = tables.table(spark, d, "conversations")
    line = F.when(F.col("role") == "user", F.concat(F.lit("! "), F.regexp_replace("text", r"\s+", " "))).otherwise(
        F.to_json(F.struct((F.col("conv_id") + 1).alias("pid"), F.col("turn").alias("ppid")))
    )
    run = F.concat(F.lit("run_"), (F.col("conv_id") % 3).cast("string"))
    lines = turns.select(run.alias("run"), line.alias("value"))
    lines.write.partitionBy("run").text(f"{root}/kernel")
    lines.limit(0).select("value").write.text(f"{root}/audit/none")
    stream = raw_stream(spark, f"{root}/kernel/*", f"{root}/audit/*")
    followed = stream.select("run_id", "_corrupt_record", "pid", "backend_pid", "timestamp")
    windows.run_to_table(followed, f"{root}/out", f"{root}/checkpoint")
    out = spark.read.schema("run_id string, _corrupt_record string, pid long").parquet(f"{root}/out")
    return out.groupBy("run_id").agg(
        F.count("_corrupt_record").alias("malformed"),
        F.count_if(F.col("_corrupt_record").isNull()).alias("events"),
    )


_IDLE = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM events),
 n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
 SELECT user_id, epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us, count(*) AS n_events FROM n GROUP BY user_id, no"""


def _event_times(spark, d):
    return tables.table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))


@query("r08_idle_sessions", _IDLE, plain=True)
def r08(spark, d):
    """Idle close at 12 hours over the event stream; an event of nobody a day later closes the last."""
    root = fresh_path(spark, "idle")
    events = _event_times(spark, d).select("user_id", "ts")
    last = events.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    for part in (events, last):  # the second run moves the watermark past every session
        part.write.mode("append").parquet(f"{root}/in")
        stream = windows.folder_stream(spark, f"{root}/in").withWatermark("ts", "1 second")
        closed = windows.idle_sessions(stream, "user_id", "ts", "12 hours")
        windows.run_to_table(closed, f"{root}/out", f"{root}/checkpoint")
    done = spark.read.schema("user_id long, first_ts timestamp, last_ts timestamp, n_events long").parquet(
        f"{root}/out"
    )
    return done.where("user_id <> -1").select(
        "user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
        "n_events",
    )


@query(
    "r11_first_per_user",
    "SELECT user_id, min(epoch_us(ts) // 864000000000)::BIGINT AS slice, 1::BIGINT AS records FROM events GROUP BY 1",
    plain=True,
)
def r11_first(spark, d):
    """Slices of ten days arrive one after another; each user's first record stands, of the first slice."""
    root = fresh_path(spark, "first")
    events = _event_times(spark, d).withColumn("slice", F.expr("unix_micros(ts) div 864000000000"))
    low, high = events.agg(F.min("slice"), F.max("slice")).first()
    for number in range(low or 0, (high or 0) + 1):
        events.where(F.col("slice") == number).write.mode("append").parquet(f"{root}/in")
        stream = windows.folder_stream(spark, f"{root}/in")
        first = windows.first_per_key(stream, ["user_id"], "ts", "60 days")
        windows.run_to_table(first, f"{root}/out", f"{root}/checkpoint")
    out = spark.read.schema("user_id long, event_id long, ts timestamp, slice long").parquet(f"{root}/out")
    return out.groupBy("user_id").agg(F.min("slice").alias("slice"), F.count(F.lit(1)).alias("records"))


@query(
    "r07_r13_replay_ticks",
    "SELECT run_id, session_key, tick, count(*) AS new_events, sum(count(*)) OVER (PARTITION BY run_id, session_key ORDER BY tick)::BIGINT AS events FROM "
    "(SELECT s.run_id, s.session_key, floor((s.timestamp_unix - t.t0) / 2.0::DOUBLE)::BIGINT + 1 AS tick FROM slog s "
    "JOIN (SELECT run_id, min(timestamp_unix) AS t0 FROM log GROUP BY 1) t ON t.run_id = s.run_id) GROUP BY 1, 2, 3",
)
def r13(spark, d):
    """Replay of a finished capture: at which rescore ticks a session has new events."""
    events, _, log, *_ = session_graphs.session_log(tables.capture(spark, d))
    start = events.groupBy("run_id").agg(F.min("timestamp_unix").alias("start_ts"))
    return windows.tick_activity(log, SESSION, "timestamp_unix", 2.0, start)


_TICKED = {
    "slog0": CTES["slog"],
    "shown": """SELECT s.run_id, s.session_key, s.seq, floor((m.timestamp_unix - t.t0) / 2.0::DOUBLE)::BIGINT + 1 AS tick FROM slog0 s
 JOIN log m ON m.run_id = s.run_id AND m.event_id = s.resolved_at
 JOIN (SELECT run_id, min(timestamp_unix) AS t0 FROM log GROUP BY 1) t ON t.run_id = s.run_id""",
    "slog": """SELECT s.* REPLACE (s.run_id || '#' || k.tick AS run_id) FROM slog0 s
 JOIN shown v ON v.run_id = s.run_id AND v.session_key = s.session_key AND v.seq = s.seq
 JOIN (SELECT DISTINCT run_id, session_key, tick FROM shown) k ON k.run_id = s.run_id AND k.session_key = s.session_key AND v.tick <= k.tick""",
}


def r13_risks(spark, d):
    """Risk of every session at each tick of a replay at which it has new events."""
    prov = session_graphs.provenance(tables.capture(spark, d))
    nothing = spark.createDataFrame([], "run_id string, session_key long, gat_score double")
    out = ticks.tick_risks(prov, nothing, 2.0)
    return out.select(*SESSION, "tick", "n_events", "scenario", F.round("risk", 9).alias("risk"))


QUERIES["r07_r13_tick_risks"] = r13_risks
ORACLE["r07_r13_tick_risks"] = chain_ctes(
    "SELECT split_part(s.run_id, '#', 1) AS run_id, s.session_key, split_part(s.run_id, '#', 2)::BIGINT AS tick, s.n_events, b.scenario, "
    "round(0.75::DOUBLE * COALESCE(b.rule_score, 0), 9) AS risk FROM "
    "(SELECT run_id, session_key, count(*) AS n_events FROM slog GROUP BY 1, 2) s "
    "LEFT JOIN best b ON b.run_id = s.run_id AND b.session_key = s.session_key",
    _TICKED,
)
