"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.tables import saved


def _toward_minimum(links: DataFrame) -> DataFrame:
    """Links (u, v) with the smallest of u and all its v beside each."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _toward_minimum(both).where("v > u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    moved = _toward_minimum(links)
    ends = F.explode(F.array("u", "v")).alias("u")
    return moved.select(ends, F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; root is its component's smallest node.

    ``a`` and ``b`` are whole-number columns; a link from a node to itself, or with a null
    end, says nothing and is left out. Each round moves links to the smallest neighbour
    seen from above and from below, in a number of rounds that grows with the logarithm of
    the longest path. Per node only a minimum is gathered, so that a node with very many
    links is a hot join key, which Spark splits, and never a list.
    """
    links = links.where(f"{a} <> {b}").select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links, before = saved(links.distinct()), None
    while True:
        state = links.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select("v", "v").distinct())
        before, links = state, saved(_small_star(_large_star(links)))
