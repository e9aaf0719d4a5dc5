"""Live scores of growing logs: attribution as a stateful stream, session graphs from increments.

`streaming.lineage` gives the events of sessions and says when sessions close. Their graphs are
not rebuilt. An event that no later one can precede any more (it is older than the retry
window) is folded into increments that merge: the first mention of a node by the order of the
session, its last time and count; count, first and last time of an edge, its event ids in pages.
Only younger events, the tail, are kept as events and looked at again. What they need to know of
folded ones is a few events a session: the first of each process, the latest program query,
the latest start of each statement text (the memory).

So the work of a batch goes with its events and the tail, and a score merges one row per node and
edge of the sessions that changed. Increments are appended per batch and merged into a base
every ``compact`` batches; closed sessions go then. Everything is written per batch number, so a
repeated batch overwrites its own results.

Events and closes are written before graphs are looked at. With ``scoring`` off that is all a batch does,
and `catch_up` scores what was written since, batch after batch, with the same results.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spoorline import schemas
from spoorline.functions.ordered import number_rows
from spoorline.functions.sqlfacts import FACTS
from spoorline.operators import behaviors as B
from spoorline.operators import graph, risk
from spoorline.operators.attribution import SESSION
from spoorline.plans.evaluation import merge_sketches, sketch_summary, timing_sketches
from spoorline.sources.logs import folder_of_file
from spoorline.streaming.lineage import Rules, follow

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ORDER = ["timestamp_unix", "resolved_at", "waited", "event_id"]
#: Tables that later batches read, and of which rows of a batch; `LiveEngine._compact` merges them.
GROWN = {
    "nodes": ("nodes", "settled"),
    "edges": ("edges", "settled"),
    "activity": ("activity", "settled"),
    "memory": ("memory", "true"),
    "alerted": ("scored", "alert"),
    "gone": ("moves", "kind = 'close' AND reason IN ('end', 'forgotten')"),
}
#: What users read: rows of a written table.
VIEWS = {
    "attributed": ("moves", "kind = 'event'"),
    "late": ("moves", "kind = 'late'"),
    "closes": ("moves", "kind = 'close'"),
    "clock": ("moves", "kind = 'clock'"),
    "scores": ("scored", "final"),
    "rescores": ("scored", "NOT final"),
    "alerts": ("scored", "alert"),
    "pages": ("edges", "settled"),
    "timings": ("timings", "true"),
}
MEMORY = [*SESSION, "role", "key"]
#: Attributes of nodes that behaviors are matched on.
MATCHED = ["timestamp_unix", "query", "comm", "arg", "dest_ip"]


def raw_stream(
    spark: SparkSession, kernel_path: str, audit_path: str, control_path: str | None = None, **options
) -> DataFrame:
    """Both logs, and control rows, as one stream of raw rows; malformed lines keep their text.

    A row may name its run (``run_id``), as in files that hold many hosts; else that is its folder.
    """

    def side(path, schema, source):
        reader = (
            spark.readStream.schema(f"{schema.toDDL()}, run_id string")
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .options(**options)
        )
        return reader.json(path).select(
            F.coalesce("run_id", folder_of_file()).alias("run_id"),
            F.lit(source).alias("source"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            *[
                F.col(c).cast("string").alias(c) if c == "timestamp" else F.col(c)
                for c in schema.fieldNames()
            ],
        )

    both = side(kernel_path, schemas.KERNEL_RAW, "kernel").unionByName(
        side(audit_path, schemas.AUDIT_RAW, "postgres"), allowMissingColumns=True
    )
    if control_path is None:
        return both
    return both.unionByName(side(control_path, schemas.KERNEL_RAW, "control"), allowMissingColumns=True)


def session_of_moves(moves: DataFrame) -> DataFrame:
    """Sessions by their run and first event: a pid that is used again is another session."""
    return moves.withColumn("run_id", F.concat_ws("@", "run_id", "opened"))


def _order() -> Column:
    return F.struct(*ORDER)


def node_increments(events: DataFrame) -> DataFrame:
    """Per node: attributes of its first event, and what later ones add.

    Only keys and numbers are aggregated; the attributes are fetched once per node from its first event.
    """
    numbers = (
        graph.node_mentions(events)
        .groupBy(*graph.NODE, "settled")
        .agg(F.min("seq").alias("seq"), F.max("timestamp_unix").alias("last_ts"), F.count(F.lit(1)).alias("mentions"))
    )
    attrs = F.struct("timestamp_unix", *graph.ATTRS, *FACTS).alias("attrs")
    firsts = events.select(*SESSION, "seq", _order().alias("first"), attrs)
    return numbers.join(firsts, [*SESSION, "seq"]).select(
        *graph.NODE, "settled", "first", "attrs", "last_ts", "mentions"
    )


def edge_increments(events: DataFrame) -> DataFrame:
    """Per edge: events, first and last time, and the ids of its events in order as one page."""
    links = graph.edge_mentions(events, ["settled"])
    ids = F.array_sort(F.collect_list(F.struct("seq", "event_id")))  # of one batch
    return links.groupBy(*graph.EDGE, "settled").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp_unix").alias("first_seen"),
        F.max("timestamp_unix").alias("last_seen"),
        F.transform(ids, lambda x: x["event_id"]).alias("event_ids"),
    )


def merged_nodes(parts: DataFrame) -> DataFrame:
    """Node increments of one session from any number of batches as one row per node."""
    return parts.groupBy(*graph.NODE).agg(
        F.min_by("attrs", "first").alias("attrs"),
        F.min("first").alias("first"),
        F.max("last_ts").alias("last_ts"),
        F.sum("mentions").alias("mentions"),
    )


def merged_edges(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*graph.EDGE).agg(
        F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def merged_activity(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*SESSION).agg(
        F.sum("n_events").alias("n_events"), F.max("last_event_ts").alias("last_event_ts")
    )


def merged_memory(parts: DataFrame) -> DataFrame:
    """The first event of a process; the latest program query and start of a text."""
    agg = parts.groupBy(*MEMORY).agg(
        F.min_by("event", _first()).alias("_lo"), F.max_by("event", _first()).alias("_hi")
    )
    return agg.select(
        *MEMORY, F.when(F.col("role") == "process", F.col("_lo")).otherwise(F.col("_hi")).alias("event")
    )


def _first() -> Column:
    return F.struct(*[F.col(f"event.{c}").alias(c) for c in ORDER])


def lean(nodes: DataFrame) -> DataFrame:
    """Node increments with no more attributes than behaviors are matched on."""
    return nodes.withColumn("attrs", F.struct(*[F.col(f"attrs.{c}").alias(c) for c in MATCHED]))


def nodes_of(merged: DataFrame) -> DataFrame:
    """Merged increments as the node table of `operators.graph`."""
    repeat = (F.col("mentions") > 1) & (F.col("node_type") != "Session")
    return merged.select(
        *graph.NODE, F.when(repeat, F.col("last_ts")).alias("last_seen"), "mentions", "attrs.*"
    )


@dataclass
class LiveEngine:
    """``model_scores`` maps (nodes, edges, behaviors) to (run_id, session_key, gat_score)."""

    spark: SparkSession
    root: str
    theta: float = risk.THETA
    rules: Rules = field(default_factory=Rules)
    compact: int = 16
    model_scores: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None
    #: Partitions of the state, by default one per core: each costs a store and a worker in every batch.
    state_partitions: int | None = None
    scoring: bool = True
    #: Moves of batches that are not scored yet, and the seconds it took to write them.
    behind: dict[int, tuple[DataFrame, float]] = field(default_factory=dict)

    # -- the stream

    def start(
        self, kernel_path: str, audit_path: str, arrival: Column | None = None,
        after: Callable[[int], None] | None = None, **trigger,
    ) -> StreamingQuery:
        """Follow both logs, e.g. with ``processingTime="2 seconds"`` or ``availableNow=True``.

        ``after`` is called at the end of every batch, before the next one looks for files.
        """
        control = f"{self.root}/control"
        nobody = self.spark.createDataFrame([], "marker string")
        nobody.write.mode("append").json(f"{control}/none")
        moves = follow(raw_stream(self.spark, kernel_path, audit_path, f"{control}/*"), self.rules, arrival)
        # a silent stream has no batches: timers wait for the next rows of any run, or the drain
        needed = {
            STORE: ROCKS,
            "spark.sql.streaming.noDataMicroBatches.enabled": "false",
            "spark.sql.shuffle.partitions": str(self._partitions()),
        }

        def batch(rows: DataFrame, number: int) -> None:
            self.process(rows, number)
            if after:
                after(number)

        before = {k: self.spark.conf.get(k) for k in needed}
        for k, v in needed.items():
            self.spark.conf.set(k, v)
        try:
            return (
                moves.writeStream.foreachBatch(batch)
                .outputMode("append")
                .option("checkpointLocation", f"{self.root}/checkpoint")
                .trigger(**trigger)
                .start()
            )
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def _partitions(self) -> int:
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.state_partitions or min(most, max(1, self.spark.sparkContext.defaultParallelism))

    def take(self, kernel_path: str, audit_path: str, arrival: Column | None = None) -> None:
        """Process what there is and stop."""
        run = self.start(kernel_path, audit_path, arrival, availableNow=True)
        run.awaitTermination()
        if run.exception():
            raise run.exception()

    def finish(self, kernel_path: str, audit_path: str, arrival: Column | None = None) -> None:
        """Drain: take what is held back and give every open session its final score."""
        self.ask_drain()
        self.take(kernel_path, audit_path, arrival)

    def ask_drain(self) -> None:
        """Drain rows for every run, which they name; the next batch takes them."""
        runs = self.table("clock").select("run_id").distinct()
        rows = runs.select("run_id", F.lit("DRAIN").alias("marker"))
        rows.coalesce(1).write.json(f"{self.root}/control/drain-{uuid.uuid4().hex}")

    # -- tables per batch

    def _path(self, name: str, batch: int) -> str:
        return f"{self.root}/{name}/batch={batch}"

    def _save(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = self._path(name, batch)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _before(self, name: str, batch: int, like: DataFrame) -> DataFrame:
        if batch <= 0:
            return like.limit(0)  # the plan drops it; an empty list would be a task per core in every job
        return self.spark.read.schema(like.schema).parquet(self._path(name, batch - 1))

    def table(self, name: str) -> DataFrame:
        """All rows of a table in `VIEWS`."""
        folder, rows = VIEWS[name]
        path = f"{self.root}/{folder}"
        df = self.spark.read.option("basePath", path).parquet(f"{path}/batch=*").where(rows)
        return df if folder in ("moves", "timings") else named(df)

    def _grown(self, name: str, batch: int, like: DataFrame) -> DataFrame:
        """All increments of earlier batches: the latest base and what came since."""
        folder, rows = GROWN[name]
        base = max(0, (batch - 1) // self.compact * self.compact)
        parts = []
        if base > 0:
            parts.append(self.spark.read.schema(like.schema).parquet(self._path(f"base/{name}", base)))
        paths = [self._path(folder, b) for b in range(base + (base > 0), batch)]
        if paths:
            delta = self.spark.read.parquet(*paths).where(rows)
            parts.append((session_of_moves(delta) if folder == "moves" else delta).select(*like.columns))
        return reduce(DataFrame.unionByName, parts) if parts else like.limit(0)

    def _forget(self, *paths: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(hadoop, paths):
            path.getFileSystem(conf).delete(path, True)

    # -- one batch

    def process(self, moves: DataFrame, batch: int) -> None:
        began = time.time()
        written = self._save(moves, "moves", batch)
        self.behind[batch] = written, time.time() - began
        if self.scoring:
            self.catch_up()

    def catch_up(self) -> None:
        """Score the batches that only have their moves."""
        for batch in sorted(self.behind):
            self._grade(*self.behind[batch], batch)
            del self.behind[batch]

    def _grade(self, moves: DataFrame, seconds: float, batch: int) -> None:
        spent, began = {"attribution": seconds}, time.time()
        ticks = moves.where("kind = 'clock'").select("run_id", F.col("timestamp_unix").alias("now_ts"))
        clock = self._before("state/clock", batch, ticks).unionByName(ticks)
        clock = self._save(clock.groupBy("run_id").agg(F.max("now_ts").alias("now_ts")), "state/clock", batch)
        named_ = session_of_moves(moves)
        events = named_.where("kind = 'event'").drop("kind", "reason", "n_events")
        events = events.withColumn("waited", F.col("resolved_at") != F.col("event_id"))
        closing = named_.where("kind = 'close'").select(*SESSION, "reason", "n_events")
        nodes, edges, activity = self._increments(events, closing, clock, batch)
        spent["graphs"], began = time.time() - began, time.time()
        dirty = events.select(*SESSION).unionByName(closing.where("reason <> 'forgotten'").select(*SESSION))
        scored = self._score(dirty.distinct(), closing, nodes, edges, activity, batch)
        spent["scores"] = time.time() - began
        self._compact(batch)
        rows = [(stage, s * 1e3) for stage, s in spent.items()]
        latency = (F.col("detection_latency_s") * 1e3).alias("ms")
        alerts = scored.where("alert").select(F.lit("detection_latency").alias("stage"), latency)
        times = self.spark.createDataFrame(rows, "stage string, ms double").unionByName(alerts)
        self._save(timing_sketches(times, ["stage"]), "timings", batch)
        if batch > 1:
            self._forget(*[self._path(n, batch - 2) for n in ("numbered", "prepared", "matched", "state/tail", "state/clock")])

    def _increments(self, opened: DataFrame, closing: DataFrame, clock: DataFrame, batch: int):
        """Folds what no event can precede any more; gives the increments of this batch's sessions."""
        open_events = self._before("state/tail", batch, opened).unionByName(opened)
        event = F.struct(*opened.columns).alias("event")
        like = opened.select(*SESSION, F.lit("").alias("role"), F.lit("").alias("key"), event)
        active = open_events.select(*SESSION).distinct()
        known = merged_memory(self._grown("memory", batch, like).join(active, SESSION, "left_semi"))
        known = known.select("event.*").dropDuplicates([*SESSION, "event_id"])
        both = known.withColumn("known", F.lit(True)).unionByName(open_events.withColumn("known", F.lit(False)))
        # counts of written rows prove a bound that saves counting groups over all joins
        bound = open_events.count() + self._grown("memory", batch, like).count()
        log, largest = number_rows(both, SESSION, ORDER, "seq", bound=bound)
        # written once: the events are prepared from four readings of it; facts are read on all cores
        log = self._save(log, "numbered", batch).repartition(self._partitions(), *SESSION)
        behind = self.rules.retry_s + self.rules.reorder_s
        settled_at = clock.select(F.col("run_id").alias("_run"), (F.col("now_ts") - behind).alias("_at"))
        prepared = (
            graph.prepared_events(log, bound=largest)
            .withColumn("_run", F.regexp_replace("run_id", "@[^@]*$", ""))
            .join(settled_at, "_run")
            .withColumn("settled", F.col("timestamp_unix") < F.col("_at"))
            .drop("_run", "_at")
        )
        prepared = self._save(prepared.hint("rebalance"), "prepared", batch)  # no files of few rows
        fresh = prepared.where("NOT known")
        gone = closing.where("reason IN ('end', 'forgotten')")
        tail = fresh.where("NOT settled").select(*opened.columns).join(gone, SESSION, "left_anti")
        counts = fresh.groupBy(*SESSION, "settled").agg(
            F.count(F.lit(1)).alias("n_events"), F.max("timestamp_unix").alias("last_event_ts")
        )
        tables = {
            "state/tail": tail,
            "nodes": node_increments(fresh),
            "edges": edge_increments(fresh),
            "activity": counts,
            "memory": memories(fresh.where("settled"), opened.columns),
        }
        with ThreadPoolExecutor(len(tables)) as pool:  # small jobs side by side
            done = pool.map(lambda x: self._save(x[1], x[0], batch), tables.items())
            nodes, edges, activity = list(done)[1:4]
        return nodes, edges.drop("event_ids"), activity

    def _score(self, dirty, closing, nodes, edges, activity, batch: int) -> DataFrame:
        """Verdicts of the sessions that changed or closed, from merged increments."""

        def whole(name: str, now: DataFrame) -> DataFrame:
            now = now.drop("settled")
            return self._grown(name, batch, now).unionByName(now).join(dirty, SESSION, "left_semi")

        parts = whole("nodes", nodes)
        merged = nodes_of(merged_nodes(parts if self.model_scores else lean(parts)))
        linked = merged_edges(whole("edges", edges))
        counts = merged_activity(whole("activity", activity))
        # written once: their order takes a count first
        found, largest = B.order_behaviors(self._save(B.match_behaviors(merged, linked), "matched", batch))
        rules = risk.best_chain(risk.chain_scores(found, bound=largest))
        if self.model_scores:
            model = self.model_scores(merged, linked, found)
        else:
            model = counts.select(*SESSION, F.lit(0.0).alias("gat_score"))
        kinds = found.groupBy(*SESSION).agg(
            F.array_sort(F.collect_set("behavior")).alias("behaviors")  # at most one per rule
        )
        sizes = merged.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n_nodes"))
        # a close counts as final if nothing came after it in this batch
        closed = closing.groupBy(*SESSION).agg(
            F.max("n_events").alias("_closed"), F.max_by("reason", "n_events").alias("reason")
        )
        scored = risk.assess(counts, rules, model, self.theta)
        for extra in (kinds, sizes, closed):
            scored = scored.join(extra, SESSION, "left")
        high = scored.where("status <> 'benign'").select(*SESSION)
        alerted = self._grown("alerted", batch, high).withColumn("_before", F.lit(True)).distinct()
        scored = (
            scored.join(alerted, SESSION, "left")
            .withColumns(
                {
                    "final": F.coalesce(F.col("_closed") == F.col("n_events"), F.lit(False)),
                    "alert": (F.col("status") != "benign") & F.col("_before").isNull(),
                    "scored_at": F.unix_micros(F.current_timestamp()) / 1e6,
                }
            )
            .withColumn("detection_latency_s", F.when(F.col("alert"), F.col("scored_at") - F.col("last_event_ts")))
            .drop("_closed", "_before")
        )
        return self._save(scored, "scored", batch)

    def timing_summary(self) -> DataFrame:
        """Mean, median, 95th percentile and maximum of each stage and of the alert latency."""
        return sketch_summary(merge_sketches(self.table("timings"), ["stage"]))

    def _compact(self, batch: int) -> None:
        """Merge all increments into a base, closed sessions left out."""
        if batch == 0 or batch % self.compact:
            return
        merge = {
            "nodes": merged_nodes, "edges": merged_edges, "activity": merged_activity,
            "memory": merged_memory, "alerted": DataFrame.distinct, "gone": lambda df: df.limit(0),
        }
        like = {"alerted": SESSION, "gone": SESSION}

        def upto(name):
            folder, rows = GROWN[name]
            own = self.spark.read.parquet(self._path(folder, batch)).where(rows)
            own = session_of_moves(own) if folder == "moves" else own
            own = own.select(*like[name]) if name in like else own.drop("settled", "event_ids")
            return self._grown(name, batch, own).unionByName(own)

        gone = upto("gone").distinct()

        def base(name: str) -> None:
            rows = upto(name)
            kept = merge[name](rows.join(gone, SESSION, "left_anti"))
            self._save(kept.select(*rows.columns), f"base/{name}", batch)

        with ThreadPoolExecutor(len(merge)) as pool:  # small jobs side by side
            list(pool.map(base, merge))
        old = range(max(0, batch - 2 * self.compact), batch - self.compact + 1)
        names = ["nodes", "activity", "memory", *[f"base/{n}" for n in GROWN]]
        self._forget(*[self._path(n, b) for n in names for b in old if b < batch - self.compact or not n.startswith("base/")])


def memories(settled: DataFrame, columns: list[str]) -> DataFrame:
    """What later events need to know of folded ones."""
    audit = F.col("source") == "postgres"
    roles = (
        ("process", F.col("syscall").isin(graph.PROCESS_CALLS), F.col("pid").cast("string")),
        ("program", audit & F.col("is_program"), F.lit("")),
        ("start", audit & (F.col("event_type") == "ExecutorStart"), F.coalesce(F.sha2("query", 256), F.lit(""))),
    )
    marks = [F.when(cond, F.struct(F.lit(role).alias("role"), key.alias("key"))) for role, cond, key in roles]
    event = F.struct(*columns).alias("event")
    marked = settled.select(*SESSION, F.explode(F.array_compact(F.array(*marks))).alias("_r"), event)
    return merged_memory(marked.select(*SESSION, "_r.*", "event"))


def named(rows: DataFrame) -> DataFrame:
    """Run and first event again as columns of their own."""
    opened = F.element_at(F.split("run_id", "@"), -1).cast("long")
    return rows.withColumns({"opened": opened, "run_id": F.regexp_replace("run_id", "@[^@]*$", "")})
