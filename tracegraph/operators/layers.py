"""Edge layers. Each takes facts and definitions with qnames and gives edges with a rank that orders their insertion.

The rank is (layer, kind of row, seq): of edges with one key the least rank wins, in ``assemble.first_wins``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X
from . import resolve

NOWHERE = ("<global>", "<unknown>")


def _edges(df: DataFrame, kind: str | Column, origin: str, meta: Column, layer: int, step: int | Column = 0, confidence: float | None = None) -> DataFrame:
    worth = F.lit(confidence if confidence is not None else schema.CONFIDENCE[origin])
    rank = F.struct(F.lit(layer).alias("layer"), (step if isinstance(step, Column) else F.lit(step)).cast("int").alias("step"), F.col("seq").alias("seq"))
    return df.select("src_qname", "src_kind", "dst_qname", "dst_kind", (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), "file", F.col("line").cast("int").alias("line"), F.lit(origin).alias("origin"), worth.cast("double").alias("confidence"), meta.alias("meta"), rank.alias("rank"))


def _of(definitions: DataFrame, *kinds: str) -> DataFrame:
    return definitions.where(F.col("kind").isin(*kinds))


OTHER = "not (src_qname = dst_qname and src_kind = dst_kind)"


def _sites(occurrences: DataFrame, op: str) -> DataFrame:
    return occurrences.where((F.col("op") == op) & ~F.col("scope").isin(*NOWHERE))


def calls(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    functions = _of(definitions, "function")
    found = resolve.choose_targets(resolve.attribute_sources(_sites(occurrences, "call"), functions), functions)
    return _edges(found.where(OTHER), "calls", "cscope", schema.meta(**resolve.ambiguity(F.col("candidates"))), 1)


def expands(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """Functions that use a macro. A function isn't the same as a macro of its name."""
    found = resolve.choose_targets(resolve.attribute_sources(_sites(occurrences, "call"), _of(definitions, "function")), _of(definitions, "macro"))
    return _edges(found, "expands", "cscope", schema.meta(**resolve.ambiguity(F.col("candidates"))), 3)


def accesses(occurrences: DataFrame, definitions: DataFrame) -> DataFrame:
    """Writes are the assignments; reads the references at sites that don't write the same name. A line that does both gives
    the other edge as well, marked rmw and inserted after it."""
    sites = occurrences.where("op in ('ref', 'assign')")
    wrote = sites.where("op = 'assign'").select("name", "file", "line", F.lit(True).alias("__wrote")).distinct()
    both = sites.join(wrote, ["name", "file", "line"], "left").where(((F.col("op") == "assign") | F.col("__wrote").isNull()) & ~F.col("scope").isin(*NOWHERE)).drop("__wrote")
    found = resolve.choose_targets(resolve.attribute_sources(both, _of(definitions, "function")), _of(definitions, "global"))
    writes = F.col("op") == "assign"
    plain = F.struct(F.when(writes, "writes").otherwise("reads").alias("kind"), F.when(writes, 0).otherwise(2).alias("step"), F.lit(None).cast("boolean").alias("rmw"))
    other = F.struct(F.when(writes, "reads").otherwise("writes").alias("kind"), F.when(writes, 1).otherwise(3).alias("step"), F.lit(True).alias("rmw"))
    again = X.is_changed_in_place(F.col("text"), F.col("name"))
    each = found.withColumn("e", F.explode(F.array_compact(F.array(plain, F.when(again, other)))))
    return _edges(each, F.col("e.kind"), "cscope", schema.meta(**resolve.ambiguity(F.col("candidates")), rmw=F.col("e.rmw")), 2, F.col("e.step"))


def includes(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """Files that include a known header, by base name, then by the directories that the directive names."""
    known = files.select("path")
    headers = known.where(X.is_header(F.col("path"))).select(F.col("path").alias("dst_qname"), X.basename(F.col("path")).alias("base"))
    shared = headers.groupBy("base").agg(F.count("*").alias("sharing"))
    spec = X.include_spec(F.col("text"))
    sites = occurrences.where("op = 'include'").withColumnRenamed("name", "base").withColumn("spec", spec).join(known.withColumnRenamed("path", "file"), "file", "left_semi")
    found = sites.join(headers.join(shared, "base"), "base").where((F.col("dst_qname") != F.col("file")) & (F.col("spec").isNull() | X.include_matches(F.col("spec"), F.col("dst_qname"))))
    found = found.withColumns({"src_qname": F.col("file"), "src_kind": F.lit("file"), "dst_kind": F.lit("file")})
    many = F.col("spec").isNotNull() & (F.instr("spec", "/") == 0) & (F.col("sharing") > 1)
    return _edges(found, "includes", "cscope", schema.meta(ambiguous=F.when(many, True), rule=F.when(many, "dup-basename")), 4)


def _handlers(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(field, dst_qname, dst_kind) that assignments of functions to fields register."""
    named = lines.select("file", "line", "seq", F.inline(X.registrations(F.col("clean")))).withColumnRenamed("handler", "name")
    return resolve.choose_targets(named, functions).select("field", "dst_qname", "dst_kind").distinct()


def dispatch_sites(lines: DataFrame, functions: DataFrame) -> DataFrame:
    named = lines.select("file", "line", "seq", F.explode(X.dispatches(F.col("clean"))).alias("field"))
    return resolve.enclosing(named, functions)


def callbacks(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """Functions named as an argument inside another function."""
    functions = _of(definitions, "function")
    named = lines.select("file", "line", "seq", F.explode(X.arguments(F.col("clean"))).alias("name")).join(functions.select("name").distinct(), "name", "left_semi")
    found = resolve.choose_targets(resolve.enclosing(named, functions).where("src_name != name"), functions)
    return _edges(found.where(OTHER), "callback", "callback", schema.meta(**resolve.ambiguity(F.col("candidates")), heur=F.lit("fn-as-arg")), 5)


def fan_out(handlers: DataFrame, limit: int = schema.FANOUT_LIMIT) -> DataFrame:
    """Handlers of fields that have no more than ``limit``, with their number."""
    counts = handlers.groupBy("field").agg(F.count("*").cast("int").alias("handlers")).where(F.col("handlers") <= limit)
    return handlers.join(counts, "field")


def dispatched(lines: DataFrame, definitions: DataFrame, limit: int = schema.FANOUT_LIMIT) -> DataFrame:
    """Dispatch through a field to the functions registered under its name, unless too many are."""
    functions = _of(definitions, "function")
    found = dispatch_sites(lines, functions).join(fan_out(_handlers(lines, functions), limit), "field")
    return _edges(found.where(OTHER), "fnptr", "fnptr", schema.meta(field=F.col("field"), handlers=F.col("handlers")), 6)


def resolve_names(names: DataFrame, definitions: DataFrame) -> DataFrame:
    """(symbol, qname, kind, missing): an exact qname of any kind (the last defined wins), else the only function of that name, else
    a placeholder function."""
    exact = definitions.groupBy(F.col("qname").alias("symbol")).agg(F.max_by(F.struct("qname", "kind"), "seq").alias("e"))
    only = _of(definitions, "function").groupBy(F.col("name").alias("symbol")).agg(F.count("*").alias("n"), F.min(F.struct("qname", "kind")).alias("f")).where("n = 1")
    both = names.select("symbol").distinct().join(exact, "symbol", "left").join(only, "symbol", "left")
    found = F.coalesce("e", "f")
    return both.select("symbol", F.coalesce(found.qname, F.col("symbol")).alias("qname"), F.coalesce(found.kind, F.lit("function")).alias("kind"), found.isNull().alias("missing"))


def placeholders(resolved: DataFrame) -> DataFrame:
    """Nodes for names that nothing defines."""
    return resolved.where("missing").select(F.col("symbol").alias("name"), "qname", "kind", F.lit("(manual)").alias("file"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit(None).cast("string").alias("signature"), F.lit(False).alias("is_static"), F.lit("").alias("module"), F.lit("manual").alias("origin"), F.lit(1.0).alias("confidence"))


#: Fields that have a bit of their own where sites and handlers meet; others are compared as arrays.
BITS = 512
#: Pairs of a site and a handler that a group of the join by bits compares, about; fewer where there would be few groups.
GROUP = 1 << 25


def registered(lines: DataFrame, registrations: DataFrame, definitions: DataFrame, resolved: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df.localCheckpoint()) -> DataFrame:
    """Dispatch sites of a field that the user registered a handler for, however many. ``keep`` writes a table down.

    A row for each edge: of several fields that a site and a handler share, the site's first (by seq, then name) gives it. The fields with most
    pairs have bits. Where they make more pairs than there are of sites and handlers, each site meets each handler once and their bits
    decide; this is exact, nothing is left to fields then but pairs that share no bit. Else they meet by field, and what comes before at the
    site, and what a handler is registered for, goes along as bits and as an array of the rest, so that other pairs end in the join.
    No pairs are shuffled.
    """
    key, many = ["src_qname", "src_kind", "file", "line"], [f"__b{k}" for k in range(BITS // 64)]
    by_hand = keep(registrations.where("field is not null").join(resolved.withColumnRenamed("symbol", "handler"), "handler").groupBy("field", F.col("qname").alias("dst_qname"), F.col("kind").alias("dst_kind")).agg(F.min(F.when(F.col("struct") != "", F.col("struct"))).alias("struct")))
    named = lines.where(F.col("clean").rlike(X.DISPATCH)).select("file", "line", "seq", F.explode(X.dispatches(F.col("clean"))).alias("field")).groupBy("file", "line", "field").agg(F.min("seq").alias("seq"))
    known = keep(named.join(by_hand.select("field").distinct(), "field", "left_semi"))
    sites = keep(resolve.enclosing(known, _of(definitions, "function")).select(*key, "field", "seq"))
    pairs = by_hand.groupBy("field").agg(F.count("*").alias("n")).join(sites.groupBy("field").agg(F.count("*").alias("m")), "field").select("field", (F.col("n") * F.col("m")).alias("n"))
    ids = keep(pairs.orderBy(F.desc("n"), "field").limit(BITS).select("field", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "field")) - 1).alias("__id")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("__id", F.lit(64)).cast("int"))
    bits = {b: F.bit_or(F.when(F.floor(F.col("__id") / 64) == k, bit)) for k, b in enumerate(many)}
    zero = F.lit(0).cast("long")
    sites, by_hand = (rows.join(F.broadcast(ids.drop("n")), "field", "left") for rows in (sites, by_hand))

    def gathered(rows: DataFrame, by: list[str], **more: Column) -> DataFrame:
        """A row for each of ``by`` that has a field with a bit."""
        one = rows.groupBy(*by).agg(*(F.coalesce(v, zero).alias(b) for b, v in bits.items()), *(v.alias(k) for k, v in more.items()))
        return one.where(" or ".join(f"{b} != 0" for b in many))

    def told(rows: DataFrame, seen: WindowSpec, before: WindowSpec | None = None) -> DataFrame:
        """Bits and array of the other fields in these windows."""
        rest = F.collect_list(F.when(F.col("__id").isNull(), F.col("field"))).over(before or seen)
        return rows.withColumns({b: F.coalesce(v.over(seen), zero) for b, v in bits.items()} | {"__rest": rest})

    # ends are compared by numbers, of which each target has its own
    targets = keep(by_hand.where("__id is not null").select("dst_qname", "dst_kind").distinct().withColumn("__n", F.monotonically_increasing_id()))
    n_sites, n_targets = sites.where("__id is not null").select(*key).distinct().count(), targets.count()
    met, whole = [], Window.partitionBy(*key)
    before = whole.orderBy("seq", "field").rowsBetween(Window.unboundedPreceding, -1)
    if dense := (ids.agg(F.sum("n")).first()[0] or 0) > n_sites * n_targets:
        x = gathered(sites, key, __at=F.array_sort(F.collect_list(F.struct("seq", "field")))).join(targets.select(F.col("dst_qname").alias("src_qname"), F.col("dst_kind").alias("src_kind"), F.col("__n").alias("__self")), ["src_qname", "src_kind"], "left")
        y = gathered(by_hand, ["dst_qname", "dst_kind"], __for=F.map_from_entries(F.collect_list(F.struct("field", "struct")))).join(targets, ["dst_qname", "dst_kind"])
        met.append(_by_bits(x.withColumn("__self", F.coalesce("__self", F.lit(-1).cast("long"))), y, many, n_sites, n_targets))
    if not dense or sites.where("__id is null").limit(1).count():
        x = (told(sites, whole, before).where("__id is null") if dense else told(sites, before)).alias("x")
        y = told(by_hand, Window.partitionBy("dst_qname", "dst_kind")).alias("y")
        other = " and ".join(f"x.{b} & y.{b} = 0" for b in many)
        both = x.join(y, F.expr(f"x.field = y.field and {other} and (size(x.__rest) = 0 or size(y.__rest) = 0 or not arrays_overlap(x.__rest, y.__rest))"))
        met.append(both.where(OTHER).select(*key, "x.field", "seq", "dst_qname", "dst_kind", "struct"))
    return _edges(reduce(DataFrame.unionByName, met), "fnptr", "manual", schema.meta(manual=F.lit(True), field=F.col("field"), struct=F.col("struct")), 7)


def _by_bits(sites: DataFrame, handlers: DataFrame, many: list[str], n_sites: int, n_handlers: int) -> DataFrame:
    """Every site with every handler that shares a bit, and the first field of the site that the handler has.

    Both sides are dealt into parts of like size, and each two parts make a group of a merge join: no task holds more than one part.
    """
    pairs = n_sites * n_handlers
    groups = max(1.0, min(8192.0, pairs / GROUP), min(128.0, 32 * pairs / GROUP))  # enough for the cores, and no more tasks than Spark can plan
    a = max(1, round(math.sqrt(groups * n_sites / n_handlers)))
    b = max(1, math.ceil(groups / a))

    def dealt(rows: DataFrame, by: list[str], mine: str, n: int, other: str, m: int) -> DataFrame:
        each = rows.withColumns({mine: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
        return each.withColumn("__g", F.col("__p") * b + F.col("__q")).drop("__p", "__q").repartition(2 * a * b, "__g")

    x = dealt(sites, ["src_qname", "src_kind", "file", "line"], "__p", a, "__q", b).alias("x")
    y = dealt(handlers, ["dst_qname", "dst_kind"], "__q", b, "__p", a).alias("y")
    shared = " or ".join(f"x.{c} & y.{c} != 0" for c in many)
    first = F.expr("filter(__at, e -> map_contains_key(__for, e.field))[0]")
    met = x.join(y.hint("merge"), F.expr(f"x.__g = y.__g and ({shared}) and x.__self != y.__n")).withColumn("__first", first)
    return met.select("src_qname", "src_kind", "file", "line", "__first.field", "__first.seq", "dst_qname", "dst_kind", F.expr("__for[__first.field]").alias("struct"))


def linked(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """What the user links, also to itself."""
    ends = [resolved.select(F.col("symbol").alias(c), F.col("qname").alias(f"{c}_qname"), F.col("kind").alias(f"{c}_kind")) for c in ("src", "dst")]
    found = links.join(ends[0], "src").join(ends[1], "dst").withColumns({"file": F.lit("(manual)"), "line": F.lit(0), "seq": F.lit(0).cast("long")})
    return _edges(found, "fnptr", "manual", schema.meta(manual=F.lit(True)), 8)


def co_change_pairs(commits: DataFrame, largest: int = 20, least: int = 2) -> DataFrame:
    """(a, b, count): files that changed together in at least ``least`` commits of 2 to ``largest`` files."""
    once = commits.select("commit_id", "path").distinct()
    fit = once.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, largest)).select("commit_id")
    kept = once.join(fit, "commit_id", "left_semi")
    a, b = kept.select("commit_id", F.col("path").alias("a")), kept.select("commit_id", F.col("path").alias("b"))
    return a.join(b, "commit_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("count")).where(F.col("count") >= least)


def co_changes(commits: DataFrame, files: DataFrame, window: int = 500) -> DataFrame:
    known = commits.join(files.select("path"), "path", "left_semi")
    pairs = co_change_pairs(known)
    found = pairs.select(F.col("a").alias("src_qname"), F.lit("file").alias("src_kind"), F.col("b").alias("dst_qname"), F.lit("file").alias("dst_kind"), "count", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(0).cast("long").alias("seq"))
    return _edges(found, "co_changes", "git", schema.meta(count=F.col("count"), window=F.lit(window)), 9)


def semantic_sites(facts: DataFrame, root: str = "") -> DataFrame:
    """Sites of calls (category 1) and writes (4) that have a parent; their paths are relative to ``root``."""
    path = F.col("path")
    if root:
        inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
        path = F.when(inside, F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(path)
    kept = facts.where(F.col("category").isin(1, 4) & F.col("parent").isNotNull())
    return kept.select(F.when(F.col("category") == 1, "calls").otherwise("writes").alias("op"), "name", F.col("parent").alias("scope"), path.alias("file"), "line", F.lit(0).cast("long").alias("seq"))


def semantic(facts: DataFrame, definitions: DataFrame, real: bool = False, root: str = "") -> DataFrame:
    """Calls and writes that a compiler front end attributed."""
    found = resolve.attribute_sources(semantic_sites(facts, root), _of(definitions, "function"))
    each = [resolve.choose_targets(found.where(F.col("op") == k), _of(definitions, d)).where(OTHER) for k, d in (("calls", "function"), ("writes", "global"))]
    meta = schema.meta(**resolve.ambiguity(F.col("candidates")))
    return _edges(reduce(DataFrame.unionByName, each), F.col("op"), "clink", meta, 10, confidence=schema.CLINK_REAL if real else None)


def confirm(edges: DataFrame, by: str = "clink") -> DataFrame:
    """Marks cscope calls and writes as confirmed where the semantic layer has the same pair and kind, else absent."""
    pairs = edges.where((F.col("origin") == "clink") & F.col("kind").isin("calls", "writes")).select("src_qname", "src_kind", "dst_qname", "dst_kind", "kind").distinct().withColumn("__told", F.lit(True))
    told = edges.join(pairs, ["src_qname", "src_kind", "dst_qname", "dst_kind", "kind"], "left")
    subject = (F.col("origin") == "cscope") & F.col("kind").isin("calls", "writes")
    marked = F.col("meta").withField("semantic", F.when(F.col("__told"), "confirmed").otherwise("absent")).withField("semantic_by", F.lit(by))
    return told.withColumn("meta", F.when(subject, marked).otherwise(F.col("meta"))).select(*edges.columns)
