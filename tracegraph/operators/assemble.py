"""Nodes and edges from layers, and the views on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X
from ..sources.config import module_of


def definition_nodes(definitions: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    return definitions.select("name", "qname", "kind", "file", "line_start", "line_end", "signature", "is_static", module_of(F.col("file"), rules or []).alias("module"), F.lit("ctags").alias("origin"), F.lit(schema.CONFIDENCE["ctags"]).alias("confidence"))


def file_nodes(files: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    return files.select(X.basename(F.col("path")).alias("name"), F.col("path").alias("qname"), F.lit("file").alias("kind"), F.col("path").alias("file"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(None).cast("string").alias("signature"), F.lit(False).alias("is_static"), module_of(F.col("path"), rules or []).alias("module"), F.lit("ctags").alias("origin"), F.lit(1.0).alias("confidence"))


def first_wins(edges: DataFrame, rank: str = "rank", key: tuple[str, ...] = schema.EDGE_KEY) -> DataFrame:
    """Of edges with one key, the one with the least rank, whole. Partial results are merged before the shuffle."""
    rest = [c for c in edges.columns if c not in key and c != rank]
    best = edges.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(rank)).alias("__b"))
    return best.select(*key, *(F.col("__b")[c].alias(c) for c in rest)).select(*(c for c in edges.columns if c != rank))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def edge_pairs(edges: DataFrame) -> DataFrame:
    """A row for each (source, target, kind): the best confidence, first site, number of sites, origins (sorted), and the meta that stands for
    the pair: one that says something before an empty one, then by origin and site."""
    said = F.when(schema.meta_json(F.col("meta")) == "{}", 1).otherwise(0)
    order = F.struct(said.alias("a"), F.col("origin").alias("b"), F.col("file").alias("c"), F.col("line").alias("d"))
    return edges.groupBy("src_qname", "src_kind", "dst_qname", "dst_kind", "kind").agg(
        F.max("confidence").alias("confidence"),
        F.min(X.site_key(F.col("file"), F.col("line"))).alias("first_site"),
        F.count("*").alias("site_count"),
        F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"),
        F.min_by("meta", order).alias("meta"),
    )


def file_deps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_file, dst_file, kind): where an edge's site is, and where its target is defined, if elsewhere."""
    sites = edges.where("file is not null").select(F.col("file").alias("src_file"), F.col("dst_qname").alias("qname"), F.col("dst_kind").alias("k"), F.col("kind").alias("edge")).distinct()
    places = nodes.select("qname", F.col("kind").alias("k"), F.col("file").alias("dst_file"))
    return sites.join(places, ["qname", "k"]).where("src_file != dst_file").select("src_file", "dst_file", F.col("edge").alias("kind")).distinct()


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def truncated(df: DataFrame, order: list[Column], limit: int, by: list[str] | None = None) -> DataFrame:
    """The first rows of each group by ``order``, with total and truncated; a limit of 0 or less keeps all.

    Totals are counted apart, so that Spark cuts each group by rank before the shuffle as well as after it."""
    if by:
        with_total = df.join(df.groupBy(*by).agg(F.count("*").alias("total")), by)
        if limit > 0:
            rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
            with_total = df.withColumn("__r", rank).where(F.col("__r") <= limit).drop("__r").join(df.groupBy(*by).agg(F.count("*").alias("total")), by)
    else:
        total = df.agg(F.count("*").alias("total")).scalar()
        with_total = (df.orderBy(*order).limit(limit) if limit > 0 else df).withColumn("total", total)
    return with_total.withColumn("truncated", (F.col("total") > limit) & F.lit(limit > 0))
