"""How five filters work together: what each removes at each place of each order.

A document fails a set of the filters A to E, five bits; with its labels (good,
toxic) that makes a mask of seven bits. Every mask stands for one big integer of
3,600 fields of 64 bits: six outcomes at each of the five steps of the 120
orders. Adding the integers of all documents of a part counts all outcomes at
once; documents of equal mask are counted first, so that a part adds at most 128
products of a count and an integer. A count is a long, so no field can overflow
into the next, and the fields of a sum are read back as one array.

Cases: a null text is empty, a null ``lang`` is the part ``""``. Texts are equal
if their SHA-256 is. A row without ``doc_id`` is neither a copy nor an original and has no label;
repeated rows with one id are no copies of each other, and each counts. Labels of
one id given several times add up (good if one row says so). Of long texts only
the distinct words are held. An empty table has no part and gives no row.
Columns other than those named are not read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spoorline.llm.common import SLICE, slices
from spoorline.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bits of a field. A Spark count has at most 63.
WIDTH = 64

MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent
MAX_UPPER = 3  # per cent
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
#: Texts longer than this are read word by word.
LONG_BYTES = 4 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")

GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_fails(text: bytes, code_points: int) -> int:
    """Bits 0 to 3: the filters A to D that a text fails."""
    if len(text) > LONG_BYTES:
        n, seen = 0, set()
        for m in _WORD.finditer(text):
            n += 1
            seen.add(m[0])
        distinct = len(seen)
    else:
        words = text.split()  # at ASCII white space
        n, distinct = len(words), len(set(words))
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        (n < MIN_WORDS)
        | (100 * distinct < MIN_DISTINCT * n) << 1
        | (100 * upper > MAX_UPPER * code_points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


@lru_cache(maxsize=None)
def packed(mask: int) -> int:
    """The integer of a mask: a one in the field of each outcome it has."""
    out = 0
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails = bool(mask & bit)
            removed = fails and not gone
            redundant = fails and gone
            gone = gone or fails
            outcome = (
                not gone, removed, redundant, mask & (GOOD - 1) == bit,
                removed and bool(mask & GOOD), removed and bool(mask & TOXIC),
            )
            for f, yes in enumerate(outcome):
                if yes:
                    out |= 1 << WIDTH * ((o * len(FILTERS) + s) * len(FIELDS) + f)
    return out


def unpack(total: int) -> np.ndarray:
    """Counts by order, step and outcome."""
    shape = (len(ORDERS), len(FILTERS), len(FIELDS))
    raw = total.to_bytes(np.prod(shape) * WIDTH // 8, "little")
    return np.frombuffer(raw, "<u8").astype(np.int64).reshape(shape)


def audit_rows(counts: list[tuple[int, int]]) -> pd.DataFrame:
    """The 600 rows of a part from its (mask, documents)."""
    table = unpack(sum(n * packed(mask) for mask, n in counts))
    flat = table.reshape(-1, len(FIELDS))
    letters = "".join(ORDERS)
    by_filter = pd.Series(flat[:, FIELDS.index("removed")]).groupby(list(letters)).sum()
    return pd.DataFrame(
        {
            "filter_order": np.repeat(ORDERS, len(FILTERS)),
            "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)),
            **{name: flat[:, f] for f, name in enumerate(FIELDS)},
            "shapley": by_filter.loc[list(letters)].to_numpy(),
        }
    )


def text_facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of A to D, and the digest of each text."""
    schema = StructType.fromDDL("part string, mask int, digest binary")
    schema = StructType([docs.schema["doc_id"], *schema.fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE):
                text = part.column("text").cast(pa.string())
                points = pc.utf8_length(text).to_pylist()
                raw = [b or b"" for b in text.cast(pa.binary()).to_pylist()]
                masks = [text_fails(b, n or 0) for b, n in zip(raw, points, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("part"),
                        pa.array(masks, pa.int32()),
                        pa.array([hashlib.sha256(b).digest() for b in raw], pa.binary()),
                    ],
                    names=["doc_id", "part", "mask", "digest"],
                )

    part = F.coalesce(F.col("lang"), F.lit("")).alias("part")
    return docs.select("doc_id", part, "text").mapInArrow(task, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see `RESULT`."""
    facts = materialize(text_facts(docs), "filter-facts")
    # written, so that a text with very many copies is split in the join below
    copied = materialize(
        facts.groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first_id"),
        "filter-copies",
    )
    marks = materialize(
        labels.where("quality = 1 OR toxic = 1")
        .groupBy("doc_id")
        .agg(
            F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        ),
        "filter-marks",
    )

    def bit(column, value):
        return F.when(F.coalesce(column, F.lit(False)), value).otherwise(0)

    mask = (
        F.col("mask")
        + bit(F.col("doc_id") > F.col("first_id"), 1 << FILTERS.index("E"))
        + bit(F.col("good"), GOOD)
        + bit(F.col("toxic"), TOXIC)
    )
    counts = (
        facts.join(copied, "digest", "left")
        .join(marks, "doc_id", "left")
        .groupBy("part", mask.cast("int").alias("mask"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def rows(group: pd.DataFrame) -> pd.DataFrame:
        out = audit_rows(list(zip(group["mask"].tolist(), group["n"].tolist(), strict=True)))
        out.insert(0, "part", group["part"].iloc[0])
        return out

    return counts.groupBy("part").applyInPandas(rows, RESULT)  # at most 128 rows a group
