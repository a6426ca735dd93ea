"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import measured, tidy


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), each with u > v. Large: larger neighbours of a node go to its smallest neighbour. Small: the node and its smaller neighbours do."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(least, "u")
    out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def contracted(edges: DataFrame) -> tuple[DataFrame, dict]:
    """One round: edges (u, v) with u > v that join the same nodes, nearer to stars around the smallest ones, as a written table; their number and sum."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return measured(_star(_star(e, True), False), "components", n=F.count(F.lit(1)), total=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs to (node, component), component being the smallest node reachable.

    Nodes without edges don't appear; self links and nulls are ignored; an empty input gives an empty result.
    Rounds grow with the logarithm of the largest component; each is one written table, and only a count and a sum reach the driver.
    """
    e, now = contracted(edges)
    before = None
    while now["n"] and now != before:
        before = now
        e, now = contracted(e)
        tidy(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
