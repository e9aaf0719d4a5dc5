"""Text helpers: masking, fingerprints, patterns in commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, number_rows


def mask_literals(text: Column) -> Column:
    """Lower-case statement with quoted literals as 'S' and numbers as N."""
    trimmed = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    quoted = F.regexp_replace(trimmed, "'[^']*'", "'S'")
    return F.regexp_replace(quoted, r"\b\d+(\.\d+)?\b", "N")


def hostnames(text: Column) -> Column:
    """All host names of http(s) addresses in a text."""
    return F.regexp_extract_all(text, F.lit(r"https?://([^/:'\s]+)"), F.lit(1))


def copied_query(text: Column) -> Column:
    """The inner query of COPY (…) TO PROGRAM, else null."""
    inner = F.regexp_extract(text, r"(?is)^\s*COPY\s*\((.*)\)\s*TO\s+PROGRAM", 1)
    return F.nullif(inner, F.lit(""))


def sequence_fingerprint(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    texts: dict[str, Column],
    seg_rows: int = SEG_ROWS,
    bound: int | None = None,
) -> DataFrame:
    """One fingerprint per group over its texts in order, the same at every size.

    Each row adds two 60-bit numbers, halves of the md5 of its place and text; a fingerprint
    is the number of rows and both sums. Sums merge in any way, so no row grows with a group.
    """
    hashed = df.select(*group, *order, *[F.md5(e).alias(n) for n, e in texts.items()])
    placed, _ = number_rows(hashed, group, order, "_no", seg_rows, bound)

    def part(digest: Column, start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")

    def total(name: str) -> Column:
        own = F.md5(F.concat_ws(":", F.col("_no").cast("string"), name))
        sums = [F.sum(part(own, at)).cast("string") for at in (1, 16)]
        return F.concat_ws("-", F.count(F.lit(1)).cast("string"), *sums).alias(name)

    return placed.groupBy(*group).agg(*[total(n) for n in texts])
