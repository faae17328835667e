"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, forget


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them. Here a > b holds."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the long columns (a, b) of ``edges``, which has been written; the root is the least node that can be reached.

    Each round ends with a checkpoint; only two sums of the edges come to the driver. It needs O(log² n) rounds.
    """
    edges = edges.where("a != b")
    rows = edges.count()
    e = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    before = e.select(mark.alias("m")).first().m
    while before.n:
        e = checkpoint(_small(_large(e)), before.n)
        after = e.select(mark.alias("m")).first().m
        if after == before:
            break
        before = after
    found = checkpoint(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), rows)
    forget(edges.sparkSession)
    return found


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) with ``links`` (a, b), which have been written, added. Only the roots that they connect are gone through."""
    ends = links.join(labels.toDF("a", "ra"), "a", "left").join(labels.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    n = links.count()
    new = checkpoint(ends.where("a != b").distinct(), n)
    if new.isEmpty():
        return labels
    moved = connected_components(new).toDF("root", "new")
    old = labels.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = moved.join(labels.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("new").alias("root"))
    return checkpoint(old.union(fresh), labels.count() + 2 * n)
