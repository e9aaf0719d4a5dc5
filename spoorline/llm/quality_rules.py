"""Quality rules: counts with fixed limits, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hash buckets of token n-grams are estimated: one from trusted texts, one
from the whole corpus. A document's score is the mean, over its n-grams, of the log of their
ratio. It is kept if it passes the base limits and its score reaches the threshold; every
document is decided in the same way and nothing is drawn at random.

Everything is DataFrame expressions: no Python runs in tasks, and documents are not shuffled.
The weights (one number a bucket) are broadcast; their size is a parameter.

Null and empty texts have no words: all counts 0, ``base_failed`` true. Repeated lines count from
their second occurrence in the text on. Without trusted texts all scores are 0, and documents
that pass the base limits are kept. Repeated rows are decided alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import whole_row

BUCKETS = 8192
NGRAM = 2
#: Added to the count of every bucket, as a share of the mean count.
SMOOTH = 0.05
#: Documents with a lower score are rejected.
THRESHOLD = -0.25
MIN_WORDS = 50
#: Trusted ids are broadcast up to this number, and joined by shuffle beyond it.
BROADCAST_IDS = 1_000_000

_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _split(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACES))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text.

    Windows are compared by 64-bit hashes. In most texts all differ, and a hash set shows that. In
    others they are sorted with their places, so that equal ones stand side by side; the places of
    those that do are spread over their three words.
    """

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            F.transform(
                F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def placed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = F.filter(
            s,
            lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]),
        )
        spread = F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(spread)))

    def repeats(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed(h), covered))

    return let(words, lambda w: let(windows(w), repeats))


def counts(text: Column) -> dict[str, Column]:
    """The base counts of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_words = let(
        _split(whole),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return {
        "_words": per_words,
        "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def tokens(text: Column) -> Column:
    """Words and runs of symbols, apart from each other."""
    return _split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([^\p{L}\p{N}\s]+)", " $1 "))


def buckets(text: Column, n: int = NGRAM, size: int = BUCKETS) -> Column:
    """Hash buckets of all n-grams of one to ``n`` tokens, 1 to ``size``."""

    def grams(t: Column, k: int) -> Column:
        def hashed(x: Column, i: Column) -> Column:
            parts = [x] + [F.get(t, i + j) for j in range(1, k)]
            return F.pmod(F.hash(*parts), F.lit(size)) + 1

        whole = t if k == 1 else F.slice(t, 1, F.greatest(F.size(t) - (k - 1), F.lit(0)))
        return F.transform(whole, hashed)

    return let(tokens(text), lambda t: F.concat(*[grams(t, k) for k in range(1, n + 1)]))


def log_ratios(
    docs: DataFrame, trusted: DataFrame, n: int = NGRAM, size: int = BUCKETS, key: str = "doc_id"
) -> DataFrame:
    """One row, one column ``_weights``: the log ratio of each bucket.

    ``trusted`` holds the ids of trusted documents. Counts cover all documents.
    """
    ids = trusted.where(F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(key).alias("_key"), "text")
    marked = texts.join(ids, F.col("_key") == F.col("_id"), "left")
    found = (
        marked.select(
            F.col("_id").isNotNull().cast("long").alias("_trusted"),
            F.explode(buckets(F.col("text"), n, size)).alias("bucket"),
        )
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("_trusted").alias("target"))
    )
    every = docs.sparkSession.range(1, size + 1).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(F.broadcast(found), "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("raw", "target")]
    )
    totals = filled.agg(
        F.sum("raw").alias("all_raw"),
        F.sum("target").alias("all_target"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"),
    )

    def share(count: Column, whole: Column) -> Column:
        return (count + whole * SMOOTH / size) / (whole * (1 + SMOOTH))

    ratio = F.transform(
        "rows",
        lambda r: F.when(
            F.col("all_target") > 0,
            F.log(share(r["target"], F.col("all_target")) / share(r["raw"], F.col("all_raw"))),
        ).otherwise(F.lit(0.0)),
    )
    return totals.select(ratio.cast("array<float>").alias("_weights"))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    n: int = NGRAM,
    size: int = BUCKETS,
    key: str = "doc_id",
) -> DataFrame:
    """Each document as ``_doc``, with ``_rules`` (counts and score), ``_failed`` and ``_kept``.

    Structs of their own, so that the documents' columns may have any names.
    """
    weights = log_ratios(docs, trusted, n, size, key).select("_weights", F.lit(0).alias("_one"))
    text = F.col("_doc.text")
    # one row of weights meets each document by a constant key
    packed = docs.select(whole_row(docs).alias("_doc"), F.lit(0).alias("_one"))
    joined = packed.join(F.broadcast(weights), "_one")
    score = let(
        buckets(text, n, size),
        lambda g: F.when(
            F.size(g) > 0,
            F.aggregate(g, F.lit(0.0), lambda a, b: a + F.element_at(F.col("_weights"), b)) / F.size(g),
        ).otherwise(F.lit(0.0)),
    )
    measured = joined.select(
        "_doc", score.alias("_score"), *[c.alias(f"_{k}") for k, c in counts(text).items()]
    )
    words = F.col("__words")
    rules = F.struct(
        words["n_words"].alias("n_words"),
        words["word_chars"].alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"),
        words["n_repeat_words"].alias("n_repeat_words"),
        F.col("_score").alias("score"),
    )
    failed = (F.col("_rules.n_words") < MIN_WORDS) | (
        100 * F.col("_rules.n_repeat_words") > 50 * F.col("_rules.n_words")
    )
    return measured.select("_doc", rules.alias("_rules")).select(
        "_doc",
        "_rules",
        failed.alias("_failed"),
        (~failed & (F.col("_rules.score") >= threshold)).alias("_kept"),
    )
