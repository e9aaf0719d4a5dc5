"""What the operators share: table reading, Arrow tasks over texts, bounded word caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that become Python objects at a time; a single longer text goes alone.
SLICE = 256
SLICE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names hold."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and about ``SLICE_BYTES`` bytes."""
    for at in range(0, batch.num_rows, rows):
        yield from _halves(batch.slice(at, rows))


def _halves(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.nbytes > SLICE_BYTES:
        half = batch.num_rows // 2
        yield from _halves(batch.slice(0, half))
        yield from _halves(batch.slice(half))
    else:
        yield batch


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[list[tuple]], dict[str, list]]],
    schema: str,
    columns: list[str],
    rows: int = SLICE,
) -> DataFrame:
    """Run a per-slice function over rows in Arrow tasks.

    ``make`` is called once per task, so that models load once; what it returns
    gets tuples of ``columns`` and gives lists per output column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)
    narrow = df.select(*columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in slices(batch, rows):
                work = work or make()
                out = work(list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in arrow], schema=arrow
                )

    return narrow.mapInArrow(task, target)


#: Rows of ids that may be broadcast; a larger side is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def sized_broadcast(ids: DataFrame) -> DataFrame:
    """``ids`` (a few numbers a row) with a broadcast hint if a count proves that it is small."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(ids) if small else ids
