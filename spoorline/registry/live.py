"""The live engine over slices of the derived logs, and the same results as SQL.

The logs of `sources.tables` are cut into minutes of event time, each a micro-batch of its own.
Their kernel clock starts anew half-way, with a second LOGGING_START; runs 3, 10, … have no mark
and so no kernel rows. Two thirds of the sessions have a SESSION_END, half of these in their
middle, so that the pid goes on as another session.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.operators.attribution import SESSION
from spoorline.registry.oracle import chain_ctes
from spoorline.session import fresh_path, materialize
from spoorline.sources import tables
from spoorline.streaming.lineage import Rules
from spoorline.streaming.live import LiveEngine

QUERIES, ORACLE = {}, {}

SLICE_US = 60_000_000
HALF_US = 180_000_000
SLICES = 6
IDLE_S = 20.0
THETA = 0.4
_MARK = "CASE WHEN backend % 3 = 0 THEN quarter * 90 + 45 ELSE quarter * 90 + 110 END"


def query(name: str, sql: str, by_slice: bool = False):
    def add(fn):
        QUERIES[name] = fn
        ORACLE[name] = _with_live(sql, by_slice)
        return fn

    return add


def write_slices(spark, d: str, root: str) -> int:
    """The logs as files under root/kernel/slice=… and audit/slice=…, of many runs each; how many slices."""
    steps = materialize(tables.steps(spark, d), "live-steps")
    kernel = steps.where(tables.KERNEL_WHERE).where("run_no % 7 <> 3")
    half = f"CASE WHEN t_us >= {HALF_US} THEN 1 ELSE 0 END"
    ns = f"CAST({tables.KERNEL['timestamp']} - {half} * 100000000000 AS STRING)"
    rows = kernel.selectExpr(
        *[f"{ns if n == 'timestamp' else e} AS `{n}`" for n, e in tables.KERNEL.items()], "t_us AS at_us"
    )
    starts = kernel.groupBy("run_id", F.expr(half).alias("half")).agg(F.min("t_us").alias("at_us"))
    starts = starts.selectExpr(
        "run_id", "at_us", "CAST(-1 AS BIGINT) AS pos", "'LOGGING_START' AS marker",
        f"CAST(CAST({tables.BASE_US} + at_us + 250000 + half * 500000 AS DOUBLE) / 1000000 AS STRING) AS timestamp",
    )
    ends = steps.where("backend % 3 <> 2").selectExpr("run_id", "backend", f"{_MARK} AS s").distinct()
    ends = ends.selectExpr(
        "run_id", "s * 1000000 AS at_us", "CAST(-1 AS BIGINT) AS pos", "'SESSION_END' AS marker",
        "backend AS backend_pid", f"CAST(CAST({tables.BASE_US // 1_000_000} + s AS DOUBLE) + 0.25 AS STRING) AS timestamp",
    )
    log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows, starts, ends])
    audit = steps.where(tables.AUDIT_WHERE).selectExpr(*tables._cols(tables.AUDIT), "t_us AS at_us")

    def write(name: str, df: DataFrame) -> None:
        cut = df.withColumn("slice", F.least(F.expr(f"at_us div {SLICE_US}"), F.lit(SLICES - 1)))
        order = ["slice", "run_id", "at_us", "pos"]
        cut = cut.repartitionByRange(*order).sortWithinPartitions(*order)
        cut.drop("at_us", "pos").write.partitionBy("slice").json(f"{root}/{name}")

    with ThreadPoolExecutor(2) as pool:  # side by side
        list(pool.map(write, ("kernel", "audit"), (log, audit)))
    return SLICES


_RAN: dict[tuple[str, str], LiveEngine] = {}


def live(spark, d: str, scored: bool = False) -> LiveEngine:
    """The engine after all slices and the drain; one run serves all queries of a session.

    Graphs are built and scored if a query asks for ``scored`` tables, while the next slice is attributed;
    events and closes need none.
    """
    at = (spark.sparkContext.applicationId, d)
    if at not in _RAN:
        root = fresh_path(spark, "live")
        write_slices(spark, d, f"{root}/cut")
        engine = LiveEngine(spark, f"{root}/out", THETA, Rules(idle_s=IDLE_S), compact=3, scoring=False)
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()

        def move(source: str, target: str) -> bool:
            source, target = fs.Path(source), fs.Path(target)
            system = source.getFileSystem(conf)
            if not system.exists(source):
                return False
            system.mkdirs(target.getParent())
            return system.rename(source, target)

        logs = [f"{root}/in/{name}" for name in ("kernel", "audit")]
        for log in logs:
            spark.createDataFrame([], "pid long").write.json(f"{log}/none")
        paths = [f"{log}/*" for log in logs]
        left = iter(range(SLICES + 1))

        scorer, scores = ThreadPoolExecutor(1), []

        def bring(_: int) -> None:
            """The next slice that has rows, and the drain after the last: one stream, a batch for each."""
            if scored:
                scores.append(scorer.submit(engine.catch_up))
            for i in left:
                if i == SLICES:
                    engine.ask_drain()
                elif any([move(f"{root}/cut/{n}/slice={i}", f"{root}/in/{n}/slice={i}") for n in ("kernel", "audit")]):
                    return

        bring(-1)
        run = engine.start(*paths, after=bring, processingTime="0 seconds")
        try:
            run.processAllAvailable()
        finally:
            run.stop()
            scorer.shutdown()
        for score in scores:
            score.result()
        _RAN[at] = engine
    if scored:
        _RAN[at].catch_up()
    return _RAN[at]


# --- the same as SQL

_T = '("timestamp" - CAST(regexp_extract(run_id, \'([0-9]+)\', 1) AS BIGINT) * 1000000000) // 1000 - 5000000'
_LIVE = {
    "lkernel": f"""SELECT *, {_T} AS at_us, CASE WHEN {_T} >= {HALF_US} THEN 1 ELSE 0 END AS half FROM kernel
 WHERE CAST(regexp_extract(run_id, '([0-9]+)', 1) AS BIGINT) % 7 <> 3""",
    "lclock": f"""SELECT run_id, half, CAST({tables.BASE_US} + min(at_us) + 250000 + half * 500000 AS DOUBLE) / 1000000
  - first("timestamp" - half * 100000000000 ORDER BY at_us, pos) / 1e9 AS clock_offset FROM lkernel GROUP BY 1, 2""",
    "merged": """SELECT k.run_id, pos, 0 AS source_rank, 'kernel' AS source,
  ("timestamp" - k.half * 100000000000) / 1e9 + clock_offset AS timestamp_unix, at_us,
  pid, ppid, uid, comm, syscall, arg, dest_ip, dest_port, NULL::BIGINT AS session_id, NULL::VARCHAR AS event_type,
  NULL::VARCHAR AS query, NULL::VARCHAR AS username FROM lkernel k JOIN lclock o ON o.run_id = k.run_id AND o.half = k.half
 UNION ALL SELECT run_id, pos, 1, 'postgres', "timestamp", round("timestamp" * 1000000)::BIGINT - """
    + str(tables.BASE_US)
    + """, backend_pid, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR,
  NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, session_id, event_type, query, username FROM audit""",
    "marks": f"""SELECT DISTINCT run_id, backend AS session_key, {_MARK} AS s,
  CAST({tables.BASE_US // 1_000_000} + ({_MARK}) AS DOUBLE) + 0.25 AS end_ts FROM steps WHERE backend % 3 <> 2""",
    "instants": "SELECT run_id, timestamp_unix AS ts FROM log UNION ALL SELECT run_id, end_ts FROM marks",
    "latest": "SELECT run_id, max(ts) AS ts FROM instants GROUP BY 1",
    "evicts": """SELECT m.run_id, m.session_key, any_value(m.end_ts) AS end_ts, min(l.event_id) AS evict_id FROM marks m
 LEFT JOIN log l ON l.run_id = m.run_id AND l.timestamp_unix > m.end_ts + 0.5 GROUP BY 1, 2""",
    "starts": """SELECT run_id, session_key, min(event_id) AS since, COALESCE(any_value(later), 9223372036854775807) AS until FROM
 (SELECT a.run_id, a.session_id AS session_key, a.event_id, e.evict_id <= a.event_id AS gone,
   CASE WHEN e.evict_id > a.event_id THEN e.evict_id END AS later FROM log a
  LEFT JOIN evicts e ON e.run_id = a.run_id AND e.session_key = a.session_id WHERE a.source = 'postgres')
 GROUP BY run_id, session_key, COALESCE(gone, false)""",
    "walk": """SELECT run_id, event_id, moment, pid AS cur, 0 AS depth FROM attempts
 UNION ALL SELECT w.run_id, w.event_id, w.moment, l.ppid, w.depth + 1 FROM walk w
  JOIN stated l ON l.run_id = w.run_id AND l.pid = w.cur AND l.since <= w.moment AND w.moment < l.until
  LEFT JOIN starts s ON s.run_id = w.run_id AND s.session_key = w.cur AND s.since <= w.moment AND w.moment < s.until
  WHERE s.session_key IS NULL AND w.depth < 7""",
    "pairs": """SELECT l.run_id, event_id, session_id AS session_key, event_id AS resolved_at, s.since AS opened, until FROM log l
  JOIN starts s ON s.run_id = l.run_id AND s.session_key = l.session_id AND s.since <= l.event_id AND l.event_id < s.until
  WHERE l.source = 'postgres'
 UNION ALL SELECT w.run_id, w.event_id, arg_min(s.session_key, w.moment), min(w.moment), arg_min(s.since, w.moment),
  arg_min(s.until, w.moment) FROM walk w
  JOIN starts s ON s.run_id = w.run_id AND s.session_key = w.cur AND s.since <= w.moment AND w.moment < s.until GROUP BY 1, 2""",
    "cuts": f"""SELECT n.run_id, n.slice, COALESCE(max(l.event_id), -1) AS cut FROM
  (SELECT run_id, slice, max(max(ts)) OVER (PARTITION BY run_id ORDER BY slice) AS newest FROM
   (SELECT run_id, least(at_us // {SLICE_US}, {SLICES - 1}) AS slice, timestamp_unix AS ts FROM log
    UNION ALL SELECT run_id, least(s * 1000000 // {SLICE_US}, {SLICES - 1}), end_ts FROM marks) GROUP BY 1, 2) n
  LEFT JOIN log l ON l.run_id = n.run_id AND l.timestamp_unix <= n.newest - 1.0 GROUP BY 1, 2
 UNION ALL SELECT run_id, {SLICES}, 9223372036854775807 FROM latest""",
}
_SLOG = """SELECT l.* REPLACE (l.run_id || '@' || p.opened{slice} AS run_id), l.run_id AS host, p.opened{cut}, p.session_key, p.resolved_at,
  row_number() OVER (PARTITION BY l.run_id, p.session_key, p.opened{cut}
  ORDER BY l.timestamp_unix, p.resolved_at, p.resolved_at <> l.event_id, l.event_id) - 1 AS seq
 FROM log l JOIN pairs p ON p.run_id = l.run_id AND p.event_id = l.event_id{join}"""


def _with_live(select: str, by_slice: bool) -> str:
    cut = {"slice": "", "cut": "", "join": ""}
    if by_slice:
        cut = {
            "slice": " || '#' || c.slice", "cut": ", c.slice",
            "join": " JOIN cuts c ON c.run_id = l.run_id AND p.resolved_at <= c.cut",
        }
    return chain_ctes(select, _LIVE | {"slog": _SLOG.format(**cut)})


_ID = "host AS run_id, session_key, opened"


@query(
    "r01_r05_stream_attribution",
    f"SELECT {_ID}, source, count(*) AS events, round(max(timestamp_unix), 6) AS last_ts, sum(event_id)::BIGINT AS ids, "
    "sum(resolved_at)::BIGINT AS resolved FROM slog GROUP BY ALL",
)
def r05(spark, d) -> DataFrame:
    """Followed in slices, with two anchors of the clock, the logs give the attribution of a replay."""
    rows = live(spark, d).table("attributed")
    return rows.groupBy(*SESSION, "opened", "source").agg(
        F.count(F.lit(1)).alias("events"),
        F.round(F.max("timestamp_unix"), 6).alias("last_ts"),
        F.sum("event_id").alias("ids"),
        F.sum("resolved_at").alias("resolved"),
    )


@query(
    "r03_r04_event_clock",
    "SELECT l.run_id, l.event_id, l.source, round(l.timestamp_unix, 6) AS ts FROM log l JOIN pairs p "
    "ON p.run_id = l.run_id AND p.event_id = l.event_id",
)
def r03(spark, d) -> DataFrame:
    """Number and time of every attributed event: re-anchored clocks, rows released in order of time."""
    rows = live(spark, d).table("attributed")
    return rows.select("run_id", "event_id", "source", F.round("timestamp_unix", 6).alias("ts"))


_SCORED = "round(0.75::DOUBLE * COALESCE(b.rule_score, 0), 9) AS risk"
_BEST = "LEFT JOIN best b ON b.run_id = s.run_id AND b.session_key = s.session_key"


@query(
    "r06_r12_final_scores",
    f"SELECT s.host AS run_id, s.session_key, s.opened, s.n_events, b.scenario, {_SCORED} FROM "
    "(SELECT run_id, host, session_key, opened, count(*) AS n_events FROM slog GROUP BY 1, 2, 3, 4) s " + _BEST,
)
def r12(spark, d) -> DataFrame:
    """The last final score of every session of every run, drained ones included, equals the batch score."""
    scores = live(spark, d, True).table("scores")
    last = F.max_by(F.struct("n_events", "scenario", F.round("risk", 9).alias("risk")), "n_events")
    return scores.groupBy(*SESSION, "opened").agg(last.alias("_l")).select(*SESSION, "opened", "_l.*")


_AS_OF = f"""SELECT s.host AS run_id, s.session_key, s.opened, s.slice, s.n_events, b.scenario, {_SCORED} FROM
 (SELECT run_id, host, session_key, opened, slice, count(*) AS n_events FROM slog GROUP BY 1, 2, 3, 4, 5) s {_BEST}"""


@query("r07_rescores", f"SELECT DISTINCT run_id, session_key, opened, n_events, scenario, risk FROM ({_AS_OF})", True)
def r07(spark, d) -> DataFrame:
    """Every score on the way: after each slice, of the sessions it changed."""
    engine = live(spark, d, True)
    every = engine.table("rescores").unionByName(engine.table("scores"))
    return every.select(*SESSION, "opened", "n_events", "scenario", F.round("risk", 9).alias("risk")).distinct()


@query(
    "r11_s14_alerts",
    "SELECT run_id, session_key, opened, n_events, scenario, risk, "
    f"'risk reached the alert threshold: ' || scenario AS message FROM ({_AS_OF}) WHERE risk >= {THETA} "
    "QUALIFY row_number() OVER (PARTITION BY run_id, session_key, opened ORDER BY slice) = 1",
    True,
)
def r11(spark, d) -> DataFrame:
    """Each session alerts once, after the slice at which its risk reaches the threshold."""
    return live(spark, d, True).table("alerts").select(
        *SESSION, "opened", "n_events", "scenario", F.round("risk", 9).alias("risk"), "message"
    )


_CLOSES = f"""WITH s AS (SELECT host, session_key, opened, resolved_at, max(max(timestamp_unix)) OVER w AS last_ts,
   sum(count(*)) OVER w AS n_events, lead(resolved_at) OVER w AS next_id FROM slog GROUP BY 1, 2, 3, 4
   WINDOW w AS (PARTITION BY host, session_key, opened ORDER BY resolved_at)),
 j AS (SELECT s.*, n.timestamp_unix AS next_ts, e.end_ts, e.evict_id, t.ts AS latest,
   e.end_ts IS NOT NULL AND (e.evict_id IS NULL OR e.evict_id > s.opened) AS ends,
   e.evict_id IS NOT NULL OR t.ts > e.end_ts + 0.5 AS passed FROM s JOIN latest t ON t.run_id = s.host
  LEFT JOIN log n ON n.run_id = s.host AND n.event_id = s.next_id
  LEFT JOIN evicts e ON e.run_id = s.host AND e.session_key = s.session_key),
 k AS (SELECT *, CASE WHEN next_id IS NOT NULL THEN next_ts >= last_ts + {IDLE_S}
   WHEN ends AND passed THEN last_ts + {IDLE_S} < end_ts + 0.5 ELSE latest >= last_ts + {IDLE_S} END AS idle FROM j)
SELECT host AS run_id, session_key, opened, reason, round(last_ts, 6) AS last_ts, n_events::BIGINT AS n_events FROM
 (SELECT *, 'idle' AS reason FROM k WHERE idle
  UNION ALL SELECT *, 'end' FROM k WHERE next_id IS NULL AND ends
  UNION ALL SELECT *, 'drain' FROM k WHERE next_id IS NULL AND NOT ends AND NOT idle)"""


def _closes(spark, d, *reasons: str) -> DataFrame:
    rows = live(spark, d).table("closes").where(F.col("reason").isin(*reasons))
    return rows.select(*SESSION, "opened", "reason", F.round("timestamp_unix", 6).alias("last_ts"), "n_events")


@query("r08_idle_close", f"SELECT * FROM ({_CLOSES}) WHERE reason IN ('idle', 'drain')")
def r08(spark, d) -> DataFrame:
    """Sessions that close after a time without events and may go on; those that do not are drained."""
    return _closes(spark, d, "idle", "drain")


@query("r09_session_end", f"SELECT * FROM ({_CLOSES}) WHERE reason = 'end'")
def r09(spark, d) -> DataFrame:
    """Sessions closed by their end mark; the pid's next event has opened another session."""
    return _closes(spark, d, "end")


@query(
    "r10_late_events",
    "SELECT p.run_id, p.session_key, p.event_id, p.resolved_at, round(l.timestamp_unix, 6) AS ts FROM pairs p "
    "JOIN log l ON l.run_id = p.run_id AND l.event_id = p.event_id JOIN evicts e ON e.run_id = p.run_id "
    "AND e.session_key = p.session_key AND e.evict_id <= p.resolved_at AND l.timestamp_unix <= e.end_ts + 5.0",
)
def r10(spark, d) -> DataFrame:
    """Events shortly behind the end of a session that has been closed."""
    rows = live(spark, d).table("late")
    return rows.select(*SESSION, "event_id", "resolved_at", F.round("timestamp_unix", 6).alias("ts"))
