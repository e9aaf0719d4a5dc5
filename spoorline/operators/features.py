"""Node features and the session scorer."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.operators.attribution import SESSION
from spoorline.operators.behaviors import node_text, words
from spoorline.operators.graph import NODE, NODE_TYPES

BUCKETS = 16
HEX = "0123456789abcdef"
NUMBERS = ["confidence", "s_struct", "s_sem", "s_temp", "has_ts", "recency", "in_degree", "out_degree"]
FEATURES = [f"h{i}" for i in range(BUCKETS)] + NUMBERS


def all_nodes(nodes: DataFrame, ordered: DataFrame) -> DataFrame:
    """Graph and behavior nodes with text, time and behavior scores."""
    zero = F.lit(0.0)
    plain = nodes.select(
        *NODE, node_text().alias("text"), "timestamp_unix",
        *[zero.alias(n) for n in NUMBERS[:4]],
    )
    found = ordered.select(
        *SESSION,
        F.lit("Behavior").alias("node_type"),
        F.col("chain_no").cast("string").alias("node_key"),
        F.col("label").alias("text"),
        "timestamp_unix",
        *NUMBERS[:4],
    )
    return plain.unionByName(found)


def all_edges(edges: DataFrame, evidence: DataFrame, chain: DataFrame) -> DataFrame:
    """Graph, evidence and chain edges as (src, dst) pairs."""
    beh = F.lit("Behavior")
    parts = [
        edges.select(*SESSION, "src_type", "src_key", "dst_type", "dst_key"),
        evidence.select(
            *SESSION,
            F.col("node_type").alias("src_type"),
            F.col("node_key").alias("src_key"),
            beh.alias("dst_type"),
            F.col("chain_no").cast("string").alias("dst_key"),
        ),
        chain.select(
            *SESSION,
            beh.alias("src_type"),
            F.col("chain_no").cast("string").alias("src_key"),
            beh.alias("dst_type"),
            F.col("next_no").cast("string").alias("dst_key"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def node_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """24 numbers per node: hashed words, behavior scores, time and degrees."""
    def degree(side, name):
        return edges.groupBy(
            *SESSION,
            F.col(f"{side}_type").alias("node_type"),
            F.col(f"{side}_key").alias("node_key"),
        ).agg(F.count(F.lit(1)).cast("double").alias(name))

    latest = nodes.groupBy(*SESSION).agg(F.max("timestamp_unix").alias("_latest"))
    bucket = F.transform(
        words(F.col("text")), lambda w: F.instr(F.lit(HEX), F.substring(F.md5(w), 1, 1)) - 1
    )

    def in_bucket(i):
        return F.size(F.filter("_buckets", lambda b: b == i)).cast("double")

    counts = {f"h{i}": in_bucket(i) for i in range(BUCKETS)}
    return (
        nodes.withColumn("_buckets", bucket)
        .withColumns(counts)
        .join(latest, SESSION)
        .join(degree("dst", "in_degree"), NODE, "left")
        .join(degree("src", "out_degree"), NODE, "left")
        .withColumns(
            {
                "has_ts": F.col("timestamp_unix").isNotNull().cast("double"),
                "recency": F.coalesce(F.col("timestamp_unix") / F.col("_latest"), F.lit(0.0)),
                "in_degree": F.coalesce("in_degree", F.lit(0.0)),
                "out_degree": F.coalesce("out_degree", F.lit(0.0)),
            }
        )
        .select(*NODE, *FEATURES)
    )


def neighbour_round(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Add to every node the mean of its in-neighbours, half and half."""
    src = features.select(
        *SESSION,
        F.col("node_type").alias("src_type"),
        F.col("node_key").alias("src_key"),
        *FEATURES,
    )
    mean = (
        edges.join(src, [*SESSION, "src_type", "src_key"])
        .groupBy(*SESSION, F.col("dst_type").alias("node_type"), F.col("dst_key").alias("node_key"))
        .agg(*[F.avg(f).alias(f"_n_{f}") for f in FEATURES])
    )
    mixed = [
        F.coalesce((F.col(f) + F.col(f"_n_{f}")) / 2, F.col(f)).alias(f) for f in FEATURES
    ]
    return features.join(mean, NODE, "left").select(*NODE, *mixed)


def pool(features: DataFrame) -> DataFrame:
    """Mean feature per node type, one row per session: means of one type each, then laid side by side."""
    per = features.groupBy(*SESSION, "node_type").agg(*[F.avg(f).alias(f) for f in FEATURES])
    means = F.collect_list(F.struct("node_type", F.array(*FEATURES)))  # one entry per node type
    held = per.groupBy(*SESSION).agg(F.map_from_entries(means).alias("_of"))
    cols = [
        F.coalesce(F.get(F.try_element_at("_of", F.lit(t)), F.lit(i)), F.lit(0.0)).alias(f"{t.lower()}_{f}")
        for t in [*NODE_TYPES, "Behavior"]
        for i, f in enumerate(FEATURES)
    ]
    return held.select(*SESSION, *cols)


def pooled_columns() -> list[str]:
    return [f"{t.lower()}_{f}" for t in [*NODE_TYPES, "Behavior"] for f in FEATURES]


def fit_scorer(pooled: DataFrame, labels: DataFrame, l2: float = 0.1):
    """Logistic regression on the pooled features; ``labels`` has (run_id, session_key, y)."""
    train = pooled.join(labels, SESSION)
    stages = [
        VectorAssembler(inputCols=pooled_columns(), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol="y", regParam=l2, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(train)


def score_sessions(model, pooled: DataFrame) -> DataFrame:
    return model.transform(pooled).select(
        *SESSION, vector_to_array("probability")[1].alias("gat_score")
    )
