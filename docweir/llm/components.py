"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _nearest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``u``, cut off so that a join on ``u`` can split a heavy hub."""
    return durable(edges.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = durable(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    near = _nearest(both).select("u", F.least("u", "m").alias("m"))
    return durable(both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    near = _nearest(edges)
    linked = edges.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
    return durable(linked.where("u <> v").distinct())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``links(u long, v long)``; a component is its smallest node.

    Links may repeat and go either way; those with a null or with equal ends
    are left out. A node without a link has no row. Nothing goes to the driver
    but two sums a round; each round's links are at most those before it, and
    the number of rounds grows with the logarithm of the longest path.
    """
    edges = durable(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
        if not mark.n:
            break
        edges = _small_star(_large_star(edges))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
