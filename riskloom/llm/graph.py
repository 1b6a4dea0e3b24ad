"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _done(e: DataFrame) -> bool:
    """Whether every node has one edge (u, v) and no v is a u: then the edges are stars already."""
    twice = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    inner = e.select(F.col("v").alias("u")).distinct().join(e.select("u").hint("merge"), "u", "left_semi")
    return twice.unionByName(inner).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node reachable) of every node in the edges (a, b).

    Each round links every node's greater neighbours to its least neighbour, then its lesser ones; rounds end when
    only stars are left, after a number of them that grows with the logarithm of the nodes.  Least neighbours are
    pre-aggregated, and the joins that follow have one row a node on one side, so a hub is split by adaptive joins.
    """
    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _done(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        e = saved(small.distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
