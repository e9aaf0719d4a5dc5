"""Ordered computations over groups of any size.

A plain window puts a whole group into one task. Here a group is ordered by a
dense counter (`number_rows`) and cut into segments of at most ``seg_rows``
counter values. Windows run inside a segment; one summary row per segment
carries the state of everything before it. When the largest group is known to
fit a single segment the plain window is used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.session import materialize

SEG_ROWS = 1 << 20


@dataclass(frozen=True)
class Fold:
    """One running value: ``kind`` is sum, last, max or min of ``expr``."""

    kind: str
    expr: Column
    inclusive: bool = False


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str = "event_id",
    seg_rows: int = SEG_ROWS,
    bound: int | None = None,
) -> tuple[DataFrame, int]:
    """Dense 0-based position of every row in its group; also the size of the largest group.

    ``order`` must be unique in a group. Groups over ``seg_rows`` are sorted
    by range over all tasks and numbered from the per-task counts. A proven
    ``bound`` of the group size saves the count.
    """
    known = bound is not None and bound <= seg_rows
    biggest = bound if known else largest_group(df, group)
    if biggest <= seg_rows:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long") - 1), biggest
    keys = [*group, *order]
    by_range = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__pos", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__pos", 33)),
        "numbered",
    )
    heads = by_range.groupBy(*group, "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first")
    )
    w = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    numbered = by_range.join(heads, [*group, "__part"]).withColumn(
        out, F.col("__pos") - F.col("__first") + F.col("__before")
    )
    return numbered.drop("__pos", "__part", "__n", "__first", "__before"), biggest


def _over(fold: Fold, window) -> Column:
    if fold.kind == "sum":
        return F.coalesce(F.sum(fold.expr).over(window), F.lit(0))
    if fold.kind == "last":
        return F.last(fold.expr, ignorenulls=True).over(window)
    return getattr(F, fold.kind)(fold.expr).over(window)


def running(
    df: DataFrame,
    group: Sequence[str],
    seq: str,
    folds: Mapping[str, Fold],
    bound: int | None = None,
    seg_rows: int = SEG_ROWS,
    reverse: bool = False,
) -> DataFrame:
    """Add running values along ``seq`` (unique in a group), exclusive or inclusive of the row.

    ``reverse`` runs from the end, so "last" is then the first value that follows.
    ``bound`` is a proven upper limit of a group's rows.
    """
    order = F.desc(seq) if reverse else F.asc(seq)
    first = Window.unboundedPreceding

    def frame(keys, fold, by=order):
        return Window.partitionBy(*keys).orderBy(by).rowsBetween(first, 0 if fold.inclusive else -1)

    if bound is not None and bound <= seg_rows:
        return df.withColumns({n: _over(f, frame(group, f)) for n, f in folds.items()})

    cut = df.withColumn("__seg", F.expr(f"`{seq}` div {seg_rows}"))
    keys = [*group, "__seg"]
    totals = []
    for name, f in folds.items():
        if f.kind == "last":
            at = F.when(f.expr.isNotNull(), F.col(seq))
            pick = F.min_by if reverse else F.max_by
            totals.append(pick(f.expr, at).alias(name))
        else:
            totals.append(getattr(F, f.kind)(f.expr).alias(name))
    seg_order = F.desc("__seg") if reverse else F.asc("__seg")
    before = Window.partitionBy(*group).orderBy(seg_order).rowsBetween(first, -1)
    carried = (
        cut.groupBy(*keys)
        .agg(*totals)
        .select(
            *keys,
            *[
                _over(Fold(f.kind, F.col(n)), before).alias(f"_carry_{n}")
                for n, f in folds.items()
            ],
        )
    )
    local = cut.withColumns({n: _over(f, frame(keys, f)) for n, f in folds.items()})
    out = local.join(carried, keys)
    merged = {}
    for n, f in folds.items():
        here, carry = F.col(n), F.col(f"_carry_{n}")
        if f.kind == "sum":
            merged[n] = here + carry
        elif f.kind == "last":
            merged[n] = F.coalesce(here, carry)
        else:
            merged[n] = (F.greatest if f.kind == "max" else F.least)(here, carry)
    return out.withColumns(merged).drop("__seg", *[f"_carry_{n}" for n in folds])


def medians(
    df: DataFrame, group: Sequence[str], column: str, out: str, seg_rows: int = SEG_ROWS
) -> DataFrame:
    """Exact interpolated median per group, from counts of distinct values in order."""
    per = df.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).alias("_v")).count()
    placed, largest = number_rows(per, group, ["_v"], "_at", seg_rows)
    before = {"_before": Fold("sum", F.col("count"))}
    placed = running(placed, group, "_at", before, largest, seg_rows)
    total = per.groupBy(*group).agg(F.sum("count").alias("_n"))
    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    upto = F.col("_before") + F.col("count")
    return (
        placed.join(total, list(group))
        .groupBy(*group)
        .agg(
            F.max(F.when((F.col("_before") <= low) & (low < upto), F.col("_v"))).alias("_lo"),
            F.max(F.when((F.col("_before") <= high) & (high < upto), F.col("_v"))).alias("_hi"),
        )
        .select(*group, ((F.col("_lo") + F.col("_hi")) / 2).alias(out))
    )
