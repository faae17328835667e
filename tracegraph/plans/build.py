"""The whole graph from facts, and from facts plus the graph before."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X
from ..operators import assemble, layers, resolve
from ..sources import files as S
from . import storage


@dataclass
class Facts:
    """What extractors give. ``files`` are (path, content, content_hash)."""

    files: DataFrame
    definitions: DataFrame
    occurrences: DataFrame
    registrations: DataFrame | None = None
    links: DataFrame | None = None
    commits: DataFrame | None = None
    semantic: DataFrame | None = None
    real_compile_database: bool = False
    rules: list[tuple[str, str]] = field(default_factory=list)
    manual_hash: str | None = None
    #: The lines of ``files``, where they have been read.
    lines: DataFrame | None = None


@dataclass
class Graph:
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _text_layers(facts: Facts, definitions: DataFrame, spark: SparkSession) -> tuple[list[DataFrame], DataFrame]:
    """Layers that are always computed in full, and the names that the manual table uses, resolved."""
    registrations = facts.registrations if facts.registrations is not None else storage.empty(spark, schema.REGISTRATIONS)
    links = facts.links if facts.links is not None else storage.empty(spark, schema.LINKS)
    lines = facts.lines if facts.lines is not None else storage.checkpoint(S.source_lines(facts.files))
    names = registrations.select(F.col("handler").alias("symbol")).union(links.select("src")).union(links.select("dst"))
    resolved = layers.resolve_names(names, definitions)
    found = [layers.callbacks(lines, definitions), layers.dispatched(lines, definitions), layers.registered(lines, registrations, definitions, resolved, storage.checkpoint), layers.linked(links, resolved)]
    if facts.commits is not None:
        found.append(layers.co_changes(facts.commits, facts.files))
    return found, resolved


def _nodes(facts: Facts, definitions: DataFrame, resolved: DataFrame) -> DataFrame:
    nodes = assemble.union([assemble.definition_nodes(definitions, facts.rules), assemble.file_nodes(facts.files, facts.rules), layers.placeholders(resolved)])
    twice = resolve.repeated_qnames(nodes).limit(5).collect()
    if twice:
        raise ValueError("more than one node for " + ", ".join(f"{r.qname} ({r.kind})" for r in twice))
    return nodes


def _index_layers(occurrences: DataFrame, definitions: DataFrame, files: DataFrame) -> list[DataFrame]:
    return [layers.calls(occurrences, definitions), layers.accesses(occurrences, definitions), layers.expands(occurrences, definitions), layers.includes(occurrences, files)]


def build(spark: SparkSession, facts: Facts) -> Graph:
    definitions = storage.checkpoint(resolve.qualify(facts.definitions))
    text, resolved = _text_layers(facts, definitions, spark)
    nodes = _nodes(facts, definitions, resolved)
    edges = assemble.first_wins(assemble.union(_index_layers(facts.occurrences, definitions, facts.files) + text))
    return Graph(facts.files.select("path", F.lit("c").alias("lang"), "content_hash"), nodes, storage.checkpoint(edges))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) by content hash: changed, added or deleted."""
    a, b = old.select("path", F.col("content_hash").alias("was")), new.select("path", F.col("content_hash").alias("is"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("change")).where("change is not null")


def rebuild(spark: SparkSession, facts: Facts, before: Graph, inputs_changed: bool = False) -> Graph:
    """The graph of ``facts``, keeping index edges of ``before`` that no change can have touched.

    If no file changed, ``before`` is the result, unless the caller says that other inputs did (the manual table, module
    rules or commits).

    An edge goes if its site is in a touched file or an end was defined in one, before or now. What is looked up again: every
    name that such files define or mention, and every name at a site whose scope such files define: its source may have gone, changed or
    become the only one. All other layers are computed in full, so the result equals a full build, but for the tags of a semantic import.
    """
    changed = storage.checkpoint(changes(before.files, facts.files))
    if changed.isEmpty() and not inputs_changed:
        return before
    touched = changed.where("change != 'deleted'").select("path")
    gone = changed.select("path")
    definitions = storage.checkpoint(resolve.qualify(facts.definitions))

    old_names = before.nodes.where("kind != 'file'").join(gone.withColumnRenamed("path", "file"), "file", "left_semi").select("name")
    new_names = definitions.join(touched.withColumnRenamed("path", "file"), "file", "left_semi").select("name")
    redefined = storage.checkpoint(old_names.union(new_names).distinct())
    # a name that became repeated, or stopped to be, changes the qnames of its other definitions too
    named = before.nodes.select(F.col("qname").alias("q"), F.col("kind").alias("k"), "name")
    kept = before.edges.where(F.col("origin").isin("cscope", "clink")).join(gone.withColumnRenamed("path", "file"), "file", "left_anti")
    for end in ("src", "dst"):
        kept = kept.join(named.toDF(f"{end}_qname", f"{end}_kind", f"{end}_name"), [f"{end}_qname", f"{end}_kind"])
    # sites in such a name may have another source now, or a first one
    again = facts.occurrences.where("op != 'include'").join(redefined.withColumnRenamed("name", "scope"), "scope", "left_semi").select("name").distinct()
    kept = kept.join(redefined.withColumnRenamed("name", "src_name"), "src_name", "left_anti").join(redefined.withColumnRenamed("name", "dst_name"), "dst_name", "left_anti")
    nodes_now = definitions.select("qname", "kind").union(facts.files.select("path", F.lit("file")))
    for end in ("src", "dst"):
        kept = kept.join(nodes_now.toDF(f"{end}_qname", f"{end}_kind"), [f"{end}_qname", f"{end}_kind"], "left_semi")

    content = facts.files.join(touched, "path", "left_semi").select(F.decode(F.expr("make_valid_utf8(cast(content as string))").cast("binary"), "utf-8").alias("t"))
    mentioned = content.select(F.explode(F.regexp_extract_all("t", F.lit(X.IDENTIFIER), F.lit(0))).alias("name")).distinct()
    specs = content.select(F.explode(F.regexp_extract_all("t", F.lit(X.INCLUDE), F.lit(1))).alias("spec")).distinct()
    affected = storage.checkpoint(mentioned.join(definitions.select("name").distinct(), "name", "left_semi").union(redefined).union(again).distinct())
    # includes are swept by header: a touched one, or one that a touched file may name
    bases = specs.select(X.basename(F.col("spec")).alias("name")).union(gone.select(X.basename(F.col("path")))).distinct()
    swept = facts.occurrences.where("op != 'include'").join(affected, "name", "left_semi").unionByName(facts.occurrences.where("op = 'include'").join(bases, "name", "left_semi").select(*facts.occurrences.columns).select("name", *[c for c in facts.occurrences.columns if c != "name"]))

    text, resolved = _text_layers(facts, definitions, spark)
    nodes = _nodes(facts, definitions, resolved)
    rank = F.struct(F.lit(0).alias("layer"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("seq"))
    columns = [*before.edges.columns]
    edges = assemble.union([kept.select(*columns).withColumn("rank", rank), *_index_layers(swept, definitions, facts.files), *text])
    return Graph(facts.files.select("path", F.lit("c").alias("lang"), "content_hash"), nodes, storage.checkpoint(assemble.first_wins(edges)))


def import_semantic(graph: Graph, facts: DataFrame, real: bool = False, root: str = "") -> tuple[Graph, dict[str, int]]:
    """Replace the semantic layer and mark what it confirms; with the numbers of edges added (calls, writes), of sites without a source
    (dropped) and of index edges confirmed and absent. Running it again changes nothing. Definitions are the graph's own nodes, so
    that names and visibility are those of its edges."""
    definitions = storage.checkpoint(graph.nodes.where((F.col("origin") == "ctags") & (F.col("kind") != "file")))
    own = graph.edges.where("origin != 'clink'").withColumn("meta", F.col("meta").withField("semantic", F.lit(None).cast("string")).withField("semantic_by", F.lit(None).cast("string")))
    layer = assemble.first_wins(layers.semantic(facts, definitions, real, root))
    edges = storage.checkpoint(layers.confirm(own.unionByName(layer)))
    sites = layers.semantic_sites(facts, root)
    told = edges.agg(*(F.count_if((F.col("origin") == "clink") & (F.col("kind") == k)).alias(k) for k in ("calls", "writes")), *(F.count_if(F.col("meta.semantic") == x).alias(x) for x in ("confirmed", "absent"))).first().asDict()
    dropped = sites.count() - resolve.attribute_sources(sites, definitions.where("kind = 'function'")).count()
    return Graph(graph.files, graph.nodes, edges), told | {"dropped": dropped}


def history_row(spark: SparkSession, action: str, n_files: int, seconds: float, **more: str) -> DataFrame:
    now = datetime.datetime.now().isoformat(timespec="seconds")
    return spark.createDataFrame([(now, action, n_files, round(seconds, 1), json.dumps(more, sort_keys=True))], "ts string, action string, files long, seconds double, details string")


def tables(spark: SparkSession, graph: Graph, meta: dict[str, str], history: DataFrame) -> dict[str, DataFrame]:
    pairs = assemble.edge_pairs(graph.edges)
    return {"files": graph.files, "nodes": graph.nodes, "edges": graph.edges, "edge_pairs": pairs, "file_deps": assemble.file_deps(graph.edges, graph.nodes), "meta": storage.kv(spark, {"schema_version": str(schema.SCHEMA_VERSION), **meta}), "history": history}
