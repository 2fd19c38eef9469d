"""Connected components of an edge table, by alternating large stars and small stars.

Each step points nodes at the smallest name they see; edges never outnumber the first step's. Minima are aggregated
before they are shuffled, and stand in tables before they are joined to the edges, so that Spark can split the join
where one node has a large part of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node, pointed at the smallest name among it and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    pointed = both.filter("b > a").join(written(least, "large"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pointed.distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, pointed at the smallest of them. Edges have a > b."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "small")
    pointed = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pointed.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node points at one other at most, and no node that is pointed at points on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("met"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("met")))
    ends = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("met").alias("met"))
    return ends.filter("points > 1 or points = 1 and met = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest name of its component."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    while not _is_forest(edges):
        edges = written(_small(written(_large(edges), "stars")), "edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
