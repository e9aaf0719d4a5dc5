"""Line dedup by winnowing over line hashes.

A text's lines are its stretches up to a line break or the end of a sentence. Blank lines are
no part of a run. A window of two lines slides over the hashes of a text's lines; its smaller
hash is the fingerprint, kept with its neighbour in the window. Every window has one, so any run of
two lines or more that occurs twice is found, wherever it starts; a line of ``min_words`` words
is a fingerprint by itself. Fingerprints are joined on their hashes with the earliest position
(by document id, then line) that has the same one. Those that occur twice and follow each other
are candidates only, as each may have been repeated from another place. In them, the shortest runs
of ``min_words`` words from each line, forward and backward, are hashed whole and joined with
their own earliest position. Every longer repeat is made of such runs. A run of at least
``min_words`` words is deleted wherever it is a later repeat; its first occurrence stays, shorter
runs stay everywhere.

Everything is DataFrame expressions: no Python runs in tasks. A frequent line is pre-aggregated
to one row and joined back, where the adaptive join can split it; no pairs of occurrences are
made, and whole texts are shuffled once, to meet what is deleted from them.

Null texts stay null, empty ones empty. Rows of equal id have equal positions, so repeated rows
keep the same lines. Null ids count as the smallest, in the order of a sum of their texts. Lines are
compared as a whole: a passage that begins or ends inside a sentence loses the sentences between
only, and one without line breaks or sentence ends is found as a whole line or not at all. Other columns are kept as they are. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.llm.common import whole_row
from spoorline.llm.quality_rules import let
from spoorline.session import materialize

MIN_WORDS = 25

#: A line ends behind a line break, or behind the space after a full stop, ! or ?.
_ENDS = r"(?<=\n)|(?<=[.!?] )"
#: The same places, as the character that goes: quicker where only the lines count.
_BREAKS = r"\n| (?<=[.!?] )"
_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
_NULL_ID = -(1 << 63)


def split_lines(text: Column) -> Column:
    """The lines of a text with what ends them; joined they give the text again."""
    return F.split(text, _ENDS)


def word_count(text: Column) -> Column:
    """Words of a text that is not blank."""
    return F.size(F.split(F.btrim(text, F.lit(_SPACE)), _SPACES))


def words_up_to(line: Column, most: int) -> Column:
    """Words of a trimmed line that is not blank, ``most`` at most; spaces tell, if all stand alone."""
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    words = F.when(line.rlike(r"[\t\x0b\x0c\r]|  "), word_count(line)).otherwise(spaces + 1)
    return F.least(words, F.lit(most))


def lines_of(text: Column, min_words: int) -> Column:
    """line (from 0, blank ones counted), h, w, its words, and c, another hash, for long ones."""

    def trimmed(lines: Column) -> Column:
        return F.transform(
            lines, lambda x, i: F.struct(F.btrim(x, F.lit(_SPACE)).alias("t"), i.alias("line"))
        )

    counted = F.transform(
        F.filter(trimmed(F.split(text, _BREAKS)), lambda s: s["t"] != ""),
        lambda s: F.struct(s["t"].alias("t"), s["line"].alias("line"), words_up_to(s["t"], min_words).alias("w")),
    )
    return F.transform(
        counted,
        lambda s: F.struct(
            s["line"].alias("line"),
            F.xxhash64(s["t"]).alias("h"),
            s["w"].alias("w"),
            F.when(s["w"] >= min_words, F.hash(s["t"])).alias("c"),
        ),
    )


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per window and per long line of texts (_id, _sum, text), with its place and words."""

    def pair(x: Column, y: Column) -> Column:
        side = F.when(x["h"] <= y["h"], 1).otherwise(-1)
        return F.struct(
            F.xxhash64(F.least(x["h"], y["h"]), F.greatest(x["h"], y["h"]), side).alias("key"),
            F.hash(x["h"], y["h"]).alias("check"),
            x["line"].alias("line"),
            y["line"].alias("next_line"),
            x["w"].alias("w"),
            y["w"].alias("next_w"),
        )

    def alone(x: Column) -> Column:
        return F.struct(
            F.xxhash64(x["h"]).alias("key"),
            x["c"].alias("check"),
            x["line"].alias("line"),
            x["line"].alias("next_line"),
            x["w"].alias("w"),
            x["w"].alias("next_w"),
        )

    def windows(a: Column) -> Column:
        pairs = F.transform(
            F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: pair(x, F.get(a, i + 1))
        )
        return F.concat(pairs, F.transform(F.filter(a, lambda x: x["c"].isNotNull()), alone))

    return docs.where(F.col("text").isNotNull()).select(
        "_id", "_sum", F.inline(let(lines_of(F.col("text"), min_words), windows))
    )


def with_first(prints: DataFrame, tag: str) -> DataFrame:
    """Fingerprints that occur at two places or more, with the earliest place."""
    earliest = (
        prints.groupBy("key", "check")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where("first < last")
        .select("key", "check", "first")
    )
    return prints.join(materialize(earliest, tag), ["key", "check"])


def shortest_runs(pairs: Column, min_words: int) -> Column:
    """from, to, key and check of the shortest runs of enough words, from each line both ways.

    ``pairs`` are windows of two lines that follow each other; ``upto`` counts the words of their
    first lines so far. A run has two lines at least, so that blank ones between any two are within
    one, and ``most``, as every line has a word. Those of one line are fingerprints by themselves
    already.
    """
    most = max(min_words, 2)
    unit = 1 << 20  # more than a run's lines

    def runs(x: Column) -> Column:
        def words(start: Column, end: Column) -> Column:
            return F.get(x["upto"], end) - F.get(x["upto"], start)

        def shortest(start: Callable[[int], Column]) -> Column:
            """A run as one number, start and length: a set of numbers is hashed, one of structs is not."""
            out = F
            for n in range(2, most + 1):
                at = start(n)
                out = out.when(words(at, at + n) >= min_words, at.cast("bigint") * unit + n)
            return out

        def forward(_: Column, i: Column) -> Column:
            return shortest(lambda n: i)

        def backward(_: Column, i: Column) -> Column:
            return shortest(lambda n: i + (1 - n))

        def run(p: Column) -> Column:
            start, size = F.shiftright(p, 20).cast("int"), (p % unit).cast("int")
            keys = F.slice(x["keys"], start + 1, size - 1)
            return F.struct(
                F.get(x["lines"], start).alias("from"),
                F.get(x["lines"], start + size - 1).alias("to"),
                F.xxhash64(keys).alias("key"),
                F.hash(keys).alias("check"),
            )

        found = F.array_distinct(
            F.concat(F.transform(x["lines"], forward), F.transform(x["lines"], backward))
        )
        return F.transform(F.filter(found, lambda p: p.isNotNull()), run)

    last = F.element_at(pairs, -1)
    parts = F.struct(
        F.concat(pairs["line"], F.array(last["next_line"])).alias("lines"),
        # words before each line, and before the end: those between two places are a difference
        F.concat(
            F.transform(pairs, lambda p: p["upto"] - p["w"]), F.array(last["upto"], last["upto"] + last["next_w"])
        ).alias("upto"),
        F.transform(pairs, lambda p: F.struct(p["key"], p["check"])).alias("keys"),
    )
    return let(parts, runs)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _sum and ``ranges``: the first and last line of each run that is a later repeat."""

    def place(line: str) -> Column:
        return F.col("_id").cast("decimal(20,0)") * F.lit(1 << 32) + F.col(line)

    prints = materialize(fingerprints(docs, min_words), "prints").withColumn("place", place("line"))
    twice = with_first(prints, "earliest").withColumn("again", F.col("place") > F.col("first"))
    twice = materialize(twice.drop("place", "first"), "twice").distinct()
    # windows that go on where the one before ended may be one run
    order = Window.partitionBy("_id", "_sum").orderBy("line")
    chains = (
        twice.where(F.col("next_line") > F.col("line"))
        .withColumn("new", F.coalesce(F.lag("next_line").over(order) != F.col("line"), F.lit(True)))
        .withColumn("chain", F.sum(F.col("new").cast("int")).over(order))
        .withColumn("upto", F.sum("w").over(order))
        .groupBy("_id", "_sum", "chain")
        .agg(
            (F.sum("w") + F.max_by("next_w", "line")).alias("words"),
            F.sort_array(F.collect_list(F.struct("line", "next_line", "upto", "w", "next_w", "key", "check"))).alias("pairs"),
        )
        .where(F.col("words") >= min_words)
    )
    runs = chains.select("_id", "_sum", F.inline(shortest_runs(F.col("pairs"), min_words)))
    runs = materialize(runs, "runs").withColumn("place", place("from"))
    later = with_first(runs, "earliest-runs").where(F.col("place") > F.col("first"))
    singles = twice.where(F.col("again") & (F.col("next_line") == F.col("line")))
    gone = later.select("_id", "_sum", "from", "to").unionByName(
        singles.select("_id", "_sum", F.col("line").alias("from"), F.col("next_line").alias("to"))
    )
    return gone.groupBy("_id", "_sum").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))


def without(text: Column, ranges: Column) -> Column:
    """kept: the text without the lines in the ranges; gone: how many they are."""

    def cut(x: Column) -> Column:
        gone = F.flatten(F.transform(x["ranges"], lambda r: F.sequence(r["from"], r["to"])))
        numbers = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), gone)
        return F.struct(
            F.array_join(F.transform(numbers, lambda i: F.get(x["lines"], i)), "").alias("kept"),
            (F.size(x["lines"]) - F.size(numbers)).alias("gone"),
        )

    return let(F.struct(split_lines(text).alias("lines"), ranges.alias("ranges")), cut)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id") -> DataFrame:
    """Each row as ``_doc``, with ``_kept``, what is left of its text, and ``_gone``, lines deleted."""
    text_sum = F.crc32(F.coalesce(F.col("_doc.text"), F.lit("")).cast("binary"))
    rows = docs.select(whole_row(docs).alias("_doc")).select(
        "_doc",
        F.coalesce(F.col(f"_doc.{key}").cast("bigint"), F.lit(_NULL_ID) + text_sum).alias("_id"),
        text_sum.alias("_sum"),
    )
    found = repeats(rows.select("_id", "_sum", F.col("_doc.text").alias("text")), min_words)
    found = materialize(found, "repeats")
    text = F.col("_doc.text")
    whole = F.struct(text.alias("kept"), F.lit(0).alias("gone"))
    left = F.when(F.col("ranges").isNull(), whole).otherwise(without(text, F.col("ranges")))
    return (
        rows.join(found, ["_id", "_sum"], "left")
        .select("_doc", let(left, lambda x: x).alias("_left"))
        .select("_doc", F.col("_left.kept").alias("_kept"), F.col("_left.gone").alias("_gone"))
    )
