"""Clock calibration and the merged, numbered event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, largest_group, number_rows
from spoorline.schemas import AUDIT_FIELDS, KERNEL_FIELDS
from spoorline.session import materialize

NS = 1e9


def clock_offsets(kernel: DataFrame, control: DataFrame, time_sync: DataFrame) -> DataFrame:
    """Per run: wall clock of LOGGING_START minus the first kernel record in file order."""
    first = (
        kernel.where(F.col("pid").isNotNull())
        .groupBy("run_id")
        .agg(F.min_by("timestamp", "pos").alias("first_ns"))
    )
    start = (
        control.where(F.col("marker") == "LOGGING_START")
        .groupBy("run_id")
        .agg(F.min_by("timestamp", "pos").alias("start_s"))
    )
    boot = time_sync.select("run_id", "server_boot_unix_time")
    return (
        first.join(start, "run_id", "left")
        .join(boot, "run_id", "left")
        .select(
            "run_id",
            F.coalesce(
                F.col("start_s") - F.col("first_ns") / F.lit(NS), F.col("server_boot_unix_time")
            ).alias("clock_offset"),
        )
    )


def calibrate(kernel: DataFrame, offsets: DataFrame) -> DataFrame:
    """Kernel records with `timestamp_unix` on the wall clock."""
    return kernel.join(offsets, "run_id").withColumn(
        "timestamp_unix", F.col("timestamp") / F.lit(NS) + F.col("clock_offset")
    )


def union_logs(kernel: DataFrame, audit: DataFrame) -> DataFrame:
    """Both logs in one schema; `source_rank` puts kernel before audit on equal times."""
    k = kernel.select(
        "run_id",
        "pos",
        F.lit(0).alias("source_rank"),
        F.lit("kernel").alias("source"),
        "timestamp_unix",
        *KERNEL_FIELDS,
    )
    a = audit.select(
        "run_id",
        "pos",
        F.lit(1).alias("source_rank"),
        F.lit("postgres").alias("source"),
        F.col("timestamp").cast("double").alias("timestamp_unix"),
        F.col("backend_pid").alias("pid"),
        *AUDIT_FIELDS,
    )
    return k.unionByName(a, allowMissingColumns=True)


def master_log(cap, seg_rows: int = SEG_ROWS) -> tuple[DataFrame, int]:
    """Calibrated, merged and numbered log of all runs, with the size of the largest run."""
    offsets = clock_offsets(cap.kernel, cap.control, cap.time_sync)
    merged = union_logs(calibrate(cap.kernel, offsets), cap.audit)
    rows = cap.kernel.select("run_id").union(cap.audit.select("run_id"))
    bound = largest_group(rows, ["run_id"])
    numbered, largest = number_rows(
        merged, ["run_id"], ["timestamp_unix", "source_rank", "pos"], "event_id", seg_rows, bound
    )
    return materialize(numbered, "events"), largest
