"""Names to definitions.

All joins here meet one row for each key on the definitions' side, so a name that occurs often costs no more than its rows,
and nothing is grouped by occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Lines in a bucket of the range join.
BUCKET = 512


def qualify(definitions: DataFrame) -> DataFrame:
    """Adds qname: ``file::name`` for static or repeated (name, kind), else the name; a repeated result gets ``:line``."""
    counts = definitions.groupBy("name", "kind").agg(F.count("*").alias("__n"))
    base = F.when(F.col("is_static") | (F.col("__n") > 1), F.concat_ws("::", "file", "name")).otherwise(F.col("name"))
    first = definitions.join(counts, ["name", "kind"]).withColumn("__q", base)
    order = F.expr("row_number() over (partition by __q, kind order by seq)")
    again = F.concat_ws(":", "__q", F.col("line_start").cast("string"))
    return first.withColumn("qname", F.when(order == 1, F.col("__q")).otherwise(again)).drop("__n", "__q")


def repeated_qnames(nodes: DataFrame) -> DataFrame:
    """(qname, kind, n) that still repeat, which a graph can't hold."""
    return nodes.groupBy("qname", "kind").agg(F.count("*").alias("n")).where("n > 1")


def attribute_sources(occurrences: DataFrame, definitions: DataFrame, scope: str = "scope") -> DataFrame:
    """Joins each occurrence to the definition that its scope names; others are dropped.

    The ladder: the only one around its line in its file, else the only one in its file, else the only one at all.
    Adds src_qname, src_kind and src_name.
    """
    keyed = definitions.select(F.col("name").alias(scope), "file", "line_start", "line_end", F.struct("qname", "kind", "name").alias("d"))
    by_file = keyed.groupBy(scope, "file").agg(F.count("*").alias("__m"), F.min("d").alias("__one"))
    by_name = keyed.groupBy(scope).agg(F.count("*").alias("__n"), F.min("d").alias("__only"))
    # lines only decide between several of one name in one file, so only their sites are compared with them
    several = by_file.where("__m > 1").select(scope, "file")
    sites = occurrences.select(scope, "file", "line").join(several, [scope, "file"], "left_semi").distinct()
    hits = sites.join(keyed.join(several, [scope, "file"], "left_semi"), [scope, "file"]).where("line between line_start and line_end")
    around = hits.groupBy(scope, "file", "line").agg(F.count("*").alias("c"), F.min("d").alias("__hit")).where("c = 1").drop("c")
    found = F.coalesce("__hit", F.when(F.col("__m") == 1, F.col("__one")), F.when(F.col("__n") == 1, F.col("__only")))
    joined = occurrences.join(by_name, scope).join(by_file, [scope, "file"], "left").join(around, [scope, "file", "line"], "left").withColumn("__src", found).where("__src is not null")
    return joined.withColumns({"src_qname": F.col("__src.qname"), "src_kind": F.col("__src.kind"), "src_name": F.col("__src.name")}).drop("__m", "__one", "__hit", "__n", "__only", "__src")


def choose_targets(occurrences: DataFrame, definitions: DataFrame, name: str = "name") -> DataFrame:
    """A row for each definition that the name may mean at its site, with dst_qname, dst_kind and candidates (their number).

    Static definitions are seen from their own file only, but those in headers from everywhere. A site asks for its name twice in one join, as
    everyone sees it and as its file does; both counts are known before.
    """
    open_ = ~F.col("is_static") | X.is_header(F.col("file"))
    seen = definitions.select(F.col("name").alias(name), F.when(open_, "").otherwise(F.col("file")).alias("__from"), F.col("qname").alias("dst_qname"), F.col("kind").alias("dst_kind"))
    counts = seen.groupBy(name, "__from").agg(F.count("*").cast("int").alias("__n"))
    n_open = counts.where("__from = ''").select(name, F.col("__n").alias("__open"))
    n_here = counts.where("__from != ''").select(name, F.col("__from").alias("file"), F.col("__n").alias("__here"))
    counted = occurrences.join(n_open, name, "left").join(n_here, [name, "file"], "left")
    counted = counted.withColumns({"__open": F.coalesce("__open", F.lit(0)), "__here": F.coalesce("__here", F.lit(0))})
    asked = F.array_compact(F.array(F.when(F.col("__open") > 0, F.lit("")), F.when(F.col("__here") > 0, F.col("file"))))
    columns = [*occurrences.columns, "candidates", "dst_qname", "dst_kind"]
    return counted.withColumn("candidates", F.col("__open") + F.col("__here")).withColumn("__from", F.explode(asked)).join(seen, [name, "__from"]).select(*columns)


def enclosing(sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """Joins (file, line) to the first definition (by seq) around it; others are dropped. Adds src_qname, src_kind, src_name.

    A range join on buckets of lines; the candidates of a site are reduced before they meet it again, so sites keep their columns.
    """
    spans = definitions.select("file", "seq", "line_start", "line_end", F.struct("qname", "kind", "name").alias("d"), F.explode(F.sequence(F.floor(F.col("line_start") / BUCKET), F.floor(F.greatest("line_start", "line_end") / BUCKET))).alias("__b"))
    places = sites.select("file", "line").distinct().withColumn("__b", F.floor(F.col("line") / BUCKET))
    hits = places.join(spans, ["file", "__b"]).where("line between line_start and line_end")
    first = hits.groupBy("file", "line").agg(F.min_by("d", "seq").alias("__d"))
    return sites.join(first, ["file", "line"]).withColumns({"src_qname": F.col("__d.qname"), "src_kind": F.col("__d.kind"), "src_name": F.col("__d.name")}).drop("__d")


def ambiguity(candidates: Column) -> dict[str, Column]:
    """Meta fields of a name that may mean several definitions."""
    many = candidates > 1
    return {"ambiguous": F.when(many, True), "candidates": F.when(many, candidates), "rule": F.when(many, "non-static-dup")}
