"""Event-time windows over streams: idle sessions, first alerts, replay ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, Fold, running


def idle_sessions(events: DataFrame, key: str, ts: str, idle: str) -> DataFrame:
    """Sessions that end after ``idle`` without events; for streams and tables alike."""
    return (
        events.groupBy(key, F.session_window(ts, idle).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("last_ts"))
        .select(key, F.col("_w.start").alias("first_ts"), "last_ts", "n_events")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all available input and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def folder_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the Parquet files of a folder, each run taking those that are new."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder)


def first_per_key(stream: DataFrame, key: Sequence[str], ts: str, within: str) -> DataFrame:
    """Only the first record of each key for as long as the watermark keeps its state."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(key))


def tick_activity(
    events: DataFrame,
    group: Sequence[str],
    ts: str,
    every_s: float,
    start: DataFrame | None = None,
    seg_rows: int = SEG_ROWS,
) -> DataFrame:
    """Ticks at which a group has new events, with the events seen before the tick.

    Tick i falls i times ``every_s`` seconds after the start of its run; the
    rows of ``start`` are (first group column, start_ts).
    """
    run = group[0]
    if start is None:
        start = events.groupBy(run).agg(F.min(ts).alias("start_ts"))
    ticked = events.join(start, run).withColumn(
        "tick", F.floor((F.col(ts) - F.col("start_ts")) / every_s) + 1
    )
    per = ticked.groupBy(*group, "tick").agg(F.count(F.lit(1)).alias("new_events"))
    fold = {"events": Fold("sum", F.col("new_events"), inclusive=True)}
    return running(per, list(group), "tick", fold, None, seg_rows)
