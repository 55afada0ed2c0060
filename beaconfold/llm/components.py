"""Connected components of an edge table by alternating stars, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Up to so many edges (a few megabytes) a round runs in one task, which saves its shuffles; more are spread.
EDGES_A_TASK = 100_000


def _gathered(df: DataFrame, few: bool) -> DataFrame:
    return df.coalesce(1) if few else df


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of ``u`` gets an edge to the least of ``u`` and its neighbours."""
    both = _gathered(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """``u`` and its smaller neighbours get edges to the least of those; edges have ``u > v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _gathered(moved.union(least.select("u", F.col("m").alias("v"))), few).distinct()


def _settled(edges: DataFrame, few: bool) -> bool:
    """Whether every node points to one node at most, which points nowhere."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("from"), F.lit(0).alias("to")).union(edges.select("v", F.lit(0), F.lit(1)))
    counts = _gathered(ends, few).groupBy("x").agg(F.sum("from").alias("from"), F.max("to").alias("to"))
    return counts.where("`from` > 1 or (`from` > 0 and `to` > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``u, v``: every node of ``edges(u, v)`` that isn't the least of its component, and that least node.

    Each round is written to the shared folder; rounds end once all edges point
    to nodes that point nowhere, after about the logarithm of the longest chain.
    """
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = stored(oriented, "edges")
    few = current.count() <= EDGES_A_TASK
    while not _settled(_gathered(current, few), few):
        following = stored(_small_star(_large_star(_gathered(current, few), few), few), "edges")
        forget(current)
        current = following
    return _gathered(current, few).distinct()
