"""From raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but
the last return the columns of ``documents``; `run` writes each result as Parquet and reads
it again. Other columns that docs have are carried along.

Nulls, empty texts, ties and repeated rows are treated as the operators' docstrings say. An
empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm.common import table
from spoorline.llm.line_dedup import dedup_lines
from spoorline.llm.ngram_join import near_duplicates
from spoorline.llm.packing import pack, tokenizer_ids
from spoorline.llm.quality_rules import judge
from spoorline.llm.secrets import redact
from spoorline.session import materialize

ORACLE_SQL = None  # decoded secrets and packing are not for SQL; tests compare with brute force

_WORD = r"[^\x20\x09-\x0D]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the likelihood ratio; the others go."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return judge(docs, trusted).where("_kept").select("_doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs; a document of which nothing is left goes."""
    judged = dedup_lines(docs)
    had, has = (F.coalesce(F.col(c), F.lit("")).rlike(_WORD) for c in ("_doc.text", "_kept"))
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("bigint")}
    return judged.where(~had | has).select(
        *[new[c].alias(c) if c in new else F.col(f"_doc.`{c}`") for c in docs.columns]
    )


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id; its copies go.

    Rows are told apart by id and text, so rows of equal or no id are judged each by its own text. Of
    rows equal in both one stays.
    """
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("doc_id"), "text", F.col("doc_id").alias("_id"))
    members = materialize(near_duplicates(keyed.select("doc_id", "text")), "near-duplicates")
    ids = keyed.select("doc_id", "_id")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "doc_id"))
    heads = members.join(ids, "doc_id").groupBy("component_id").agg(first.alias("_f")).select(F.col("_f.doc_id").alias("_near_key"))
    twice = members.groupBy(F.col("doc_id").alias("_near_key")).count().where("count > 1").select("_near_key")
    kept = docs.withColumn("_near_key", key).join(heads, "_near_key", "left_semi")
    once = kept.join(twice, "_near_key", "left_anti")
    repeated = kept.join(twice, "_near_key", "left_semi").dropDuplicates(["_near_key"])
    return once.unionByName(repeated).drop("_near_key")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, every secret replaced by its kind."""
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    import public_tokenizers

    path, ranks = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    return pack(docs, tokenizer_ids(path, ranks, public_tokenizers.PATTERN))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
