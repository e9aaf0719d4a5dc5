"""From behavior chains and a model score to a risk and an alert."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.ordered import SEG_ROWS, Fold, running
from spoorline.operators.attribution import SESSION

RULE_WEIGHT = 0.75
MODEL_WEIGHT = 0.75
THETA = 0.55


@dataclass(frozen=True)
class Chain:
    """Behavior labels that have to occur in this order, not necessarily side by side."""

    scenario: str
    labels: tuple[str, ...]
    weight: float


CHAINS = (
    Chain("exfiltration", ("DATA_ACCESS", "UNIX_SHELL_EXECUTION", "EXTERNAL_TRANSFER"), 1.0),
    Chain("staged exfiltration", ("DATA_ACCESS", "DATA_PACKAGING", "EXTERNAL_TRANSFER"), 1.0),
    Chain("audit tampering", ("DESTRUCTIVE_DB_OPERATION", "DEFENSE_IMPAIRMENT"), 0.9),
    Chain("ingress tool transfer", ("UNIX_SHELL_EXECUTION", "POTENTIAL_INGRESS_TOOL_TRANSFER"), 0.6),
    Chain("data access and transfer", ("DATA_ACCESS", "EXTERNAL_TRANSFER"), 0.8),
    Chain("data packaging", ("DATA_ACCESS", "DATA_PACKAGING"), 0.5),
)


def chain_scores(
    ordered: DataFrame, chains=CHAINS, bound: int | None = None, seg_rows: int = SEG_ROWS
) -> DataFrame:
    """Sessions × chains that occurred: weight × mean confidence of the chain's labels."""
    df, marks = ordered.select(*SESSION, "chain_no", "behavior", "confidence"), {}
    longest = max(len(c.labels) for c in chains)
    for step in range(longest - 1):
        folds = {}
        for i, c in enumerate(chains):
            if step < len(c.labels) - 1:
                hit = F.col("behavior") == c.labels[step]
                if step:
                    hit = hit & F.col(f"_r{i}_{step - 1}").isNotNull()
                folds[f"_r{i}_{step}"] = Fold("max", F.when(hit, F.lit(1)))
        df = running(df, SESSION, "chain_no", folds, bound, seg_rows)
    per_session = []
    for i, c in enumerate(chains):
        last = F.col("behavior") == c.labels[-1]
        if len(c.labels) > 1:
            last = last & F.col(f"_r{i}_{len(c.labels) - 2}").isNotNull()
        part = F.col("behavior").isin(*c.labels)
        per_session += [
            F.max(last).alias(f"_hit{i}"),
            F.avg(F.when(part, F.col("confidence"))).alias(f"_conf{i}"),
        ]
        marks[i] = F.when(
            F.col(f"_hit{i}"),
            F.struct(
                F.lit(i).alias("chain_order"),
                F.lit(c.scenario).alias("scenario"),
                (F.lit(float(c.weight)) * F.col(f"_conf{i}")).alias("rule_score"),
            ),
        )
    return (
        df.groupBy(*SESSION)
        .agg(*per_session)
        .select(*SESSION, F.explode(F.array_compact(F.array(*marks.values()))).alias("_c"))
        .select(*SESSION, "_c.*")
    )


def best_chain(scores: DataFrame) -> DataFrame:
    """The highest-scoring chain of each session; ties keep the chain order."""
    best = F.max_by(
        F.struct("scenario", "rule_score"), F.struct("rule_score", (-F.col("chain_order")).alias("o"))
    )
    return scores.groupBy(*SESSION).agg(best.alias("_b")).select(*SESSION, "_b.*")


def fuse(rule: Column, model: Column, w_rule: float = RULE_WEIGHT, w_model: float = MODEL_WEIGHT):
    """Noisy-or of the weighted scores."""
    return 1.0 - (1.0 - w_rule * rule) * (1.0 - w_model * model)


def assess(
    sessions: DataFrame,
    rule_scores: DataFrame,
    model_scores: DataFrame,
    theta: float = THETA,
    w_rule: float = RULE_WEIGHT,
    w_model: float = MODEL_WEIGHT,
) -> DataFrame:
    """Risk and status of every session; a missing score counts as 0."""
    scored = sessions.join(rule_scores, SESSION, "left").join(model_scores, SESSION, "left")
    scored = scored.withColumns(
        {
            "rule_score": F.coalesce("rule_score", F.lit(0.0)),
            "gat_score": F.coalesce("gat_score", F.lit(0.0)),
        }
    )
    return decide(
        scored.withColumn("risk", fuse(F.col("rule_score"), F.col("gat_score"), w_rule, w_model)),
        theta,
    )


def decide(scored: DataFrame, theta: float = THETA) -> DataFrame:
    """Status and message at the alert threshold; a risk equal to it alerts."""
    alert = F.col("risk") >= theta
    return scored.withColumns(
        {
            "theta_a": F.lit(float(theta)),
            "status": F.when(alert, F.lit("alert")).otherwise(F.lit("benign")),
            "message": F.when(
                alert,
                F.concat(
                    F.lit("risk reached the alert threshold: "),
                    F.coalesce("scenario", F.lit("no chain rule")),
                ),
            ).otherwise(F.lit("")),
        }
    )
