"""Connected components by alternating large and small stars, on checkpointed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: each node of ``links`` (a, b) with the least node that it is connected to.

    Nodes without a link to another node are not listed. A link is kept as
    (high, low). A large star ties every greater neighbour of a node to the
    least node in its neighbourhood, a small star the node itself and its
    lesser neighbours; both are a partial ``min`` per node and a join. They
    keep what is connected, and end in stars around each component's least
    node, long chains included, after about logarithmically many turns.
    """
    at = cut(_downward(links.select("a", "b")))
    while not _stars(at):
        at = cut(_small_star(_large_star(at)))
    low = at.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return at.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(low)


def _downward(pairs: DataFrame) -> DataFrame:
    a, b = pairs.columns
    return (pairs.filter(F.col(a) != F.col(b))
            .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct())


def _stars(at: DataFrame) -> bool:
    """Whether every node has one link down, to a node without any."""
    several = at.groupBy("high").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("high")
    inner = at.select(F.col("low").alias("high")).join(at, "high", "left_semi")
    return several.unionByName(inner).isEmpty()


def _large_star(at: DataFrame) -> DataFrame:
    both = at.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
        at.select(F.col("high").alias("u"), F.col("low").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _downward(both.filter("v > u").join(least, "u").select("v", "m"))


def _small_star(at: DataFrame) -> DataFrame:
    least = at.groupBy("high").agg(F.min("low").alias("m"))
    ties = at.join(least, "high").select("low", "m")
    return _downward(ties.unionByName(least.select(F.col("high").alias("low"), "m")))
