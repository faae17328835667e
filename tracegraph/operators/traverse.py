"""Bounded traversals: one set-oriented step for each level, never a loop over symbols."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEEPEST = 10


def clamp(depth: int) -> int:
    return max(1, min(DEEPEST, depth))


#: Nodes of a frontier up to which the steps are filtered by them; beyond, they are joined.
FEW = 1000


def _from(steps: DataFrame, frontier: DataFrame) -> DataFrame:
    """The steps from a small frontier by a filter, which reaches the scan, so that most row groups aren't read."""
    few = [r.id for r in frontier.select("id").distinct().limit(FEW + 1).collect()]
    if len(few) > FEW:
        return steps
    if not isinstance(steps.schema["a"].dataType, T.StructType):
        return steps.where(F.col("a").isin(*few))
    return steps.where(F.col("a.qname").isin(*sorted({x.qname for x in few})))


def reach(seeds: DataFrame, steps: DataFrame, depth: int, cut: Callable[[DataFrame], DataFrame], with_seeds: bool = False) -> DataFrame:
    """(start, id, depth) of what ``steps`` (a, b) reach from ``seeds`` (start, id) in at most ``depth`` steps, for each start at its least depth.
    Without a column start all seeds are one.

    Seeds count as reached only if a cycle leads back to them, unless ``with_seeds``. ``cut`` ends the lineage of each level.
    """
    key = ["start", "id"] if "start" in seeds.columns else ["id"]
    start = frontier = cut(seeds.select(*key).distinct())
    seen = [start.withColumn("depth", F.lit(0))] if with_seeds else []
    for level in range(1, depth + 1):
        found = frontier.withColumnRenamed("id", "a").join(_from(steps, frontier), "a").select(*key[:-1], F.col("b").alias("id")).distinct()
        for before in seen:
            found = found.join(before.select(*key), key, "left_anti")
        frontier = cut(found)
        if frontier.isEmpty():
            break
        seen.append(frontier.withColumn("depth", F.lit(level)))
    if not seen:
        return start.where("false").withColumn("depth", F.lit(0))
    return reduce(DataFrame.unionByName, seen)


def impact_steps(pairs: DataFrame, least: float, ambiguous: bool, kinds: tuple[str, ...]) -> DataFrame:
    """Target to source of calls in the wide sense. ``pairs`` are edges or edge_pairs with confidence and meta."""
    kept = pairs.where(F.col("kind").isin(*kinds) & (F.col("confidence") >= least))
    if not ambiguous:
        kept = kept.where(~F.coalesce(F.col("meta.ambiguous"), F.lit(False)))
    a, b = F.struct(F.col("dst_qname").alias("qname"), F.col("dst_kind").alias("kind")), F.struct(F.col("src_qname").alias("qname"), F.col("src_kind").alias("kind"))
    return kept.select(a.alias("a"), b.alias("b"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct()


def neighbourhood(nodes: DataFrame, links: DataFrame, focus: str, depth: int, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes with a focus flag, links) within ``depth`` undirected steps of the nodes that ``focus`` names: their id, what ends in
    ``::focus``, or the last part of their name."""
    named = (F.col("id") == focus) | F.col("id").endswith(f"::{focus}") | (F.substring_index("id", "::", -1) == focus)
    seeds = nodes.where(named).select("id").distinct()
    near = reach(seeds, both_ways(links), max(1, depth), cut, with_seeds=True)
    inside = near.select("id")
    kept = nodes.drop("focus").join(inside, "id", "left_semi").withColumn("focus", named)
    ends = links.join(inside.withColumnRenamed("id", "a"), "a", "left_semi").join(inside.withColumnRenamed("id", "b"), "b", "left_semi")
    return kept, ends
