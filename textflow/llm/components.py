"""Connected components of a link table that no machine could hold.

Large-star and small-star steps in turn (Kiveris et al., 2014): every step
replaces links by links to the smallest neighbour, and keeps components.  The
number of rounds grows with the logarithm of the longest path.  The smallest
neighbour of every node is written before rows are joined to it, so a node
with very many links is split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textflow.llm.stored import discard, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (a, b) with a > b.  Large star: every larger neighbour of a
    node moves to the smallest of the node and its neighbours.  Small star:
    the node and its smaller neighbours move to the smallest of these."""
    if large:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = store(seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    near = seen.where("v > u") if large else seen
    moved = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return store(moved.where("a <> b").distinct(), "star")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent or is one, so that all links lead to a component's smallest id."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("u").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or c = 1 and p = 1").take(1)


def connected(links: DataFrame) -> DataFrame:
    """``links``: (l, r), integers.  Returns (id, component) for every node of
    a link with another node; component is the smallest id reachable.  Null
    ends, self links and repeated links are ignored; no links, no rows."""
    edges = store(links.where("l is not null and r is not null and l <> r")
                  .select(F.greatest("l", "r").alias("a"), F.least("l", "r").alias("b")).distinct(), "links")
    while not _settled(edges):
        wide = _star(edges, True)
        new = _star(wide, False)
        discard(wide)
        discard(edges)
        edges = new
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
