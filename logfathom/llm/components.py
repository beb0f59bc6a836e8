"""Connected components of a link table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfathom.llm.tables import stored

MAX_STEPS = 60


def fold_stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), v < u, all distinct.

    Large: every larger neighbour of a node is linked to the node's smallest
    neighbour. Small: every smaller one, and the node itself.
    """
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    pairs = near.join(least, "u")
    if large:
        out = pairs.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = pairs.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u > v").distinct()


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every linked node: the smallest node reachable.

    ``edges`` has ids ``u`` and ``v``. Each step is a stored table, so a lost
    executor costs a step at most. The number of steps grows with the logarithm
    of the longest path; neither nodes nor edges pass the driver.
    """
    edges = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links"
    )
    seen = state(edges)
    for _ in range(MAX_STEPS):
        edges = stored(fold_stars(fold_stars(edges, True), False), "links")
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
