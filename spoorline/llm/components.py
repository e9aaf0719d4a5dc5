"""Connected components of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.session import materialize

#: Steps along the chain of smallest neighbours in a round.
STEPS = 2


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that links reach, for every node with a link.

    Each round moves every node to its smallest neighbour, follows these moves on, and puts links
    where their ends have gone; a link whose ends have met goes. So links are joined while they
    still matter: in two rounds at most half of the nodes with links are left. Hot nodes are
    pre-aggregated; nothing goes to the driver but whether a link is left.
    """
    edges = materialize(_distinct(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    state = None
    while True:
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        near = edges.unionByName(turned).groupBy("u").agg(F.min("v").alias("v"))
        moved = materialize(near.select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "moved")
        for _ in range(STEPS):
            moved = materialize(_followed(moved, moved, "inner"), "moved")
        state = moved if state is None else materialize(_followed(state, moved, "left"), "roots")
        for end in ("u", "v"):
            to = moved.select(F.col("node").alias(end), F.col("root").alias("_to"))
            edges = edges.join(to, end).drop(end).withColumnRenamed("_to", end)
        edges = materialize(_distinct(edges.where("u <> v")), "edges")
        if not edges.limit(1).count():
            return state


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _followed(state: DataFrame, moved: DataFrame, how: str) -> DataFrame:
    """Roots replaced by where these have moved."""
    on = moved.select(F.col("node").alias("root"), F.col("root").alias("further"))
    return state.join(on, "root", how).select("node", F.coalesce("further", "root").alias("root"))
