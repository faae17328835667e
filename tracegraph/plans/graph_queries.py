"""Registered queries of the graph operators, with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X
from ..operators import assemble, layers, reports, resolve, traverse
from ..sources import config as C
from ..sources import crossref
from ..sources import files as S
from . import build as B
from . import projections as P
from . import sqlgate, storage, verbs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with their qnames, written once: layers use them many times."""
    return storage.checkpoint(resolve.qualify(P.definitions(spark, sf_dir)))


def _plain(edges: DataFrame) -> DataFrame:
    """Edges by key with the meta fields that these tables use."""
    return _flat(assemble.first_wins(edges))


def _flat(edges: DataFrame) -> DataFrame:
    return edges.select("src_qname", "dst_qname", "kind", "file", "line", "origin", "confidence", P.flag(F.col("meta")).alias("ambiguous"), F.coalesce("meta.candidates", F.lit(1)).alias("candidates"), F.coalesce("meta.rmw", F.lit(False)).alias("rmw"))


# --- views and neighbours


@query(f"WITH {P.PAIRS} SELECT src, dst, kind, confidence, first_site, site_count, origins, amb FROM pairs")
def edge_pairs(spark, sf_dir):
    return assemble.edge_pairs(P.edges(spark, sf_dir)).select(F.col("src_qname").alias("src"), F.col("dst_qname").alias("dst"), "kind", "confidence", "first_site", "site_count", "origins", P.flag(F.col("meta")).alias("amb"))


def _neighbours(spark, sf_dir, symbol, direction, limit=schema.LIST_LIMIT):
    pairs = assemble.edge_pairs(P.edges(spark, sf_dir))
    return verbs.neighbours(pairs, P.nodes(spark, sf_dir), symbol, direction, limit=limit).select("qname", "kind", "site", "sites", "origins", "confidence", "tags", "total", "truncated")


def _neighbour_sql(symbol, near, far, limit):
    cut = f"WHERE r <= {limit}" if limit else ""
    return f"""WITH {P.PAIRS} SELECT * EXCLUDE (r) FROM (SELECT {far} AS qname, kind, regexp_replace(first_site, ':0+([0-9]+)$', ':\\1') AS site, site_count AS sites, origins, confidence,
        concat('[', origins, CASE WHEN amb THEN '; ambiguous 2 candidates' ELSE '' END, ']') AS tags, count(*) OVER () AS total, {f"count(*) OVER () > {limit}" if limit else "false"} AS truncated,
        row_number() OVER (ORDER BY {far}, kind) AS r FROM pairs WHERE {near} = '{symbol}' AND confidence >= 0.7) {cut}"""


@query(_neighbour_sql("p7", "dst", "src", 40))
def callers_of(spark, sf_dir):
    return _neighbours(spark, sf_dir, "p7", "dst")


@query(_neighbour_sql("s3", "src", "dst", 40))
def callees_of(spark, sf_dir):
    return _neighbours(spark, sf_dir, "s3", "src")


@query(_neighbour_sql("s5", "src", "dst", 0))
def callees_unlimited(spark, sf_dir):
    return _neighbours(spark, sf_dir, "s5", "src", 0)


@query(f"""WITH {P.PAIRS}, x AS (SELECT 'callers' AS section, src AS qname, kind AS detail, regexp_replace(first_site, ':0+([0-9]+)$', ':\\1') AS site, row_number() OVER (ORDER BY src, kind) AS r, count(*) OVER () AS total FROM pairs WHERE dst = 's3' AND confidence >= 0.7
    UNION ALL SELECT 'callees', dst, kind, regexp_replace(first_site, ':0+([0-9]+)$', ':\\1'), row_number() OVER (ORDER BY dst, kind), count(*) OVER () FROM pairs WHERE src = 's3' AND confidence >= 0.7
    UNION ALL SELECT 'globals', dst, 'reads', concat(file, ':', line), row_number() OVER (ORDER BY dst, concat(file, ':', line), origin), count(*) OVER () FROM e WHERE src = 's3' AND kind = 'callback')
    SELECT section, qname, detail, site, total, total > 40 AS truncated FROM x WHERE r <= 40""")
def explore_sections(spark, sf_dir):
    e = P.edges(spark, sf_dir)
    as_reads = e.withColumn("kind", F.when(F.col("kind") == "callback", "reads").otherwise(F.col("kind")))
    tables = {"nodes": P.nodes(spark, sf_dir), "edges": as_reads, "edge_pairs": assemble.edge_pairs(e)}
    return verbs.explore(tables, "s3").select("section", "qname", "detail", "site", "total", "truncated")


@query(f"WITH {P.EDGES} SELECT src, dst, kind, origin, file, line, total, total > 3 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY src) AS total, row_number() OVER (PARTITION BY src ORDER BY dst, kind, origin, file, line) AS r FROM e) WHERE r <= 3")
def truncated_with_total(spark, sf_dir):
    e = P.edges(spark, sf_dir).select(F.col("src_qname").alias("src"), F.col("dst_qname").alias("dst"), "kind", "origin", "file", "line")
    return assemble.truncated(e, [F.col(c) for c in ("dst", "kind", "origin", "file", "line")], 3, ["src"])


@query(f"WITH {P.EDGES} SELECT src, dst, kind, file, line, origin, confidence, amb FROM e")
def first_wins_edges(spark, sf_dir):
    e = P.edges(spark, sf_dir)
    return e.select(F.col("src_qname").alias("src"), F.col("dst_qname").alias("dst"), "kind", "file", "line", "origin", "confidence", P.flag(F.col("meta")).alias("amb"))


@query(f"WITH {P.EDGES}, {P.NODES} SELECT DISTINCT e.file AS src_file, n.file AS dst_file, kind FROM e JOIN n ON e.dst = n.qname WHERE e.file <> n.file")
def file_deps(spark, sf_dir):
    return assemble.file_deps(P.edges(spark, sf_dir), P.nodes(spark, sf_dir))


# --- traversal


def _impact_sql(where, depth, seed="p1"):
    return f"""WITH RECURSIVE {P.WALKS}, w AS (SELECT src AS id, 1 AS depth FROM b WHERE dst = '{seed}' AND {where} UNION SELECT b.src, w.depth + 1 FROM w JOIN b ON b.dst = w.id WHERE w.depth < {depth} AND {where}),
        {P.NODES}, r AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"""


@query(_impact_sql("NOT amb", 3) + " SELECT id AS qname, depth, file, line FROM r JOIN n ON n.qname = id")
def impact_depth(spark, sf_dir):
    return verbs.impact(P.walks(spark, sf_dir), P.nodes(spark, sf_dir), "p1", 3).select("qname", "depth", "file", "line")


@query(_impact_sql("true", 2, "p2") + " SELECT id AS qname, depth, file, line FROM r JOIN n ON n.qname = id")
def impact_with_ambiguous(spark, sf_dir):
    return verbs.impact(P.walks(spark, sf_dir), P.nodes(spark, sf_dir), "p2", 2, ambiguous=True).select("qname", "depth", "file", "line")


@query(_impact_sql("NOT amb", 3) + " SELECT file, count(*) AS n, string_agg(id, ',' ORDER BY id) AS names FROM r JOIN n ON n.qname = id GROUP BY file")
def impact_by_file(spark, sf_dir):
    return verbs.impact(P.walks(spark, sf_dir), P.nodes(spark, sf_dir), "p1", 3).groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("qname")), ",").alias("names"))


@query(f"WITH {P.WALKS} SELECT dst AS qname, count(*) AS hint FROM b WHERE amb GROUP BY dst")
def impact_hints(spark, sf_dir):
    w = P.walks(spark, sf_dir).select("src_qname", "dst_qname", P.flag(F.col("meta")).alias("amb")).distinct()
    return w.where("amb").groupBy(F.col("dst_qname").alias("qname")).agg(F.count("*").alias("hint"))


@query(f"""WITH RECURSIVE {P.WALKS}, l AS (SELECT DISTINCT src, dst FROM b), u AS (SELECT src AS a, dst AS b FROM l UNION SELECT dst, src FROM l),
    w AS (SELECT 'p1' AS id, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.id WHERE w.depth < 1), near AS (SELECT DISTINCT id FROM w)
    SELECT src AS a, dst AS b FROM l WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""")
def viz_neighbourhood(spark, sf_dir):
    links = P.walks(spark, sf_dir).select(F.col("src_qname").alias("a"), F.col("dst_qname").alias("b")).distinct()
    ids = P.nodes(spark, sf_dir).select(F.col("qname").alias("id"))
    return traverse.neighbourhood(ids, links, "p1", 1, storage.checkpoint)[1]


@query(f"""WITH {P.EDGES}, {P.NODES}, l AS (SELECT DISTINCT src, dst, kind FROM e WHERE kind IN ('calls', 'fnptr', 'callback')), k AS (SELECT * FROM n WHERE qname IN (SELECT src FROM l UNION SELECT dst FROM l)),
    m AS (SELECT module, row_number() OVER (ORDER BY min(qname), module) - 1 AS i FROM k WHERE module <> '' GROUP BY module)
    SELECT qname AS id, file, line, k.module, concat('hsl(', coalesce(i * 47 % 360, 200), ',60%,50%)') AS color FROM k LEFT JOIN m USING (module)""")
def graph_export(spark, sf_dir):
    return verbs.view(P.edges(spark, sf_dir), P.nodes(spark, sf_dir))[0].select("id", "file", "line", "module", "color")


# --- resolution


@query(f"WITH {P.QUALIFIED} SELECT seq, name, kind, qname FROM q")
def qname_disambiguation(spark, sf_dir):
    return _qualified(spark, sf_dir).select("seq", "name", "kind", "qname")


@query(f"WITH {P.DEFINITIONS} SELECT name AS qname, kind, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1")
def repeated_qnames(spark, sf_dir):
    """What a graph would refuse if plain names were its keys."""
    return resolve.repeated_qnames(P.definitions(spark, sf_dir).withColumn("qname", F.col("name")))


@query(f"WITH {P.QUALIFIED}, {P.OCCURRENCES}, {P.source_of()} SELECT seq, name, file, line, src_qname FROM src")
def attribute_src_ladder(spark, sf_dir):
    d = _qualified(spark, sf_dir).where("kind = 'function'")
    return resolve.attribute_sources(P.occurrences(spark, sf_dir), d).select("seq", "name", "file", "line", "src_qname")


@query(f"WITH {P.QUALIFIED}, {P.OCCURRENCES}, {P.targets_of('o', 'function')} SELECT seq, name, file, line, dst_qname, candidates FROM dst")
def choose_dst_visibility(spark, sf_dir):
    d = _qualified(spark, sf_dir).where("kind = 'function'")
    return resolve.choose_targets(P.occurrences(spark, sf_dir), d).select("seq", "name", "file", "line", "dst_qname", "candidates")


@query(f"WITH {P.QUALIFIED}, {P.OCCURRENCES}, {P.targets_of('o', 'function')} SELECT name, file, candidates, count(*) AS n FROM dst WHERE candidates > 1 GROUP BY ALL")
def ambiguous_candidates(spark, sf_dir):
    d = _qualified(spark, sf_dir).where("kind = 'function'")
    return resolve.choose_targets(P.occurrences(spark, sf_dir), d).where("candidates > 1").groupBy("name", "file", "candidates").agg(F.count("*").alias("n"))


@query(f"WITH {P.QUALIFIED}, {P.OCCURRENCES}, k AS (SELECT o.file, o.line, arg_min(q.qname, q.seq) AS src_qname FROM (SELECT DISTINCT file, line FROM o) o JOIN q ON q.kind = 'function' AND q.file = o.file AND o.line BETWEEN q.line_start AND q.line_end GROUP BY o.file, o.line) SELECT seq, name, file, line, src_qname FROM o JOIN k USING (file, line)")
def enclosing_range_join(spark, sf_dir):
    d = _qualified(spark, sf_dir).where("kind = 'function'")
    return resolve.enclosing(P.occurrences(spark, sf_dir), d).select("seq", "name", "file", "line", "src_qname")


@query(f"WITH {P.DEFINITIONS} SELECT seq, CASE WHEN regexp_matches(coalesce(file, ''), '^src[0-4]/') THEN 'core' WHEN regexp_matches(file, 'brand#3', 'i') THEN 'third' WHEN regexp_matches(file, '\\.h$') THEN 'headers' ELSE '' END AS module FROM d")
def module_map_first_match(spark, sf_dir):
    rules = C.parse_module_rules("# comment\n^SRC[0-4]/,core\n\nbrand#3,third\n\\.h$,headers\n")
    return P.definitions(spark, sf_dir).select("seq", C.module_of(F.col("file"), rules).alias("module"))


@query(f"WITH {P.LINES} SELECT file, line, regexp_matches(clean, '\\bder\\b') OR (coalesce(regexp_matches(up, '\\bder\\b'), false) AND NOT regexp_matches(up, '[;}}{{.]\\s*$')) AS is_static FROM (SELECT *, lag(clean) OVER (PARTITION BY file ORDER BY line) AS up FROM t)")
def static_detection(spark, sf_dir):
    """The rule on prose: a word for the keyword, and a full stop as one more end of a statement."""
    lines = P.text_lines(spark, sf_dir)
    above = lines.select("file", (F.col("line") + 1).alias("line"), F.col("clean").alias("up"))
    word = lambda c: F.regexp_replace(F.regexp_replace(c, r"\bder\b", "static"), r"\.(\s*)$", ";$1")
    return lines.join(above, ["file", "line"], "left").select("file", "line", X.is_static(word(F.col("clean")), word(F.col("up"))).alias("is_static"))


# --- layers


def _ambiguity_sql(extra="false AS rmw"):
    return f"src_qname, dst_qname, kind, file, line, 'cscope' AS origin, CAST(0.9 AS DOUBLE) AS confidence, candidates > 1 AS ambiguous, candidates, {extra}"


_CALLS_SQL = f"""s AS (SELECT * FROM o WHERE op = 'call' AND scope NOT IN ('<global>', '<unknown>')), {P.source_of("s")}, {P.targets_of("src", "function")}
    SELECT DISTINCT {_ambiguity_sql().replace("kind,", "'calls' AS kind,")} FROM dst WHERE src_qname <> dst_qname"""
_EXPANDS_SQL = f"""s AS (SELECT * FROM o WHERE op = 'call' AND scope NOT IN ('<global>', '<unknown>')), {P.source_of("s")}, {P.targets_of("src", "macro")}
    SELECT DISTINCT {_ambiguity_sql().replace("kind,", "'expands' AS kind,")} FROM dst"""
_ACCESSES_SQL = f"""a AS (SELECT seq, op, name, scope, file, line, text FROM o WHERE op = 'assign' UNION ALL SELECT seq, op, name, scope, file, line, text FROM o WHERE op = 'ref' AND NOT EXISTS (SELECT 1 FROM o w WHERE w.op = 'assign' AND w.name = o.name AND w.file = o.file AND w.line = o.line)),
    s AS (SELECT * FROM a WHERE scope NOT IN ('<global>', '<unknown>')), {P.source_of("s")}, {P.targets_of("src", "global")},
    two AS (SELECT *, CASE op WHEN 'assign' THEN 'writes' ELSE 'reads' END AS kind, CASE op WHEN 'assign' THEN 0 ELSE 2 END AS step, false AS rmw FROM dst
        UNION ALL SELECT *, CASE op WHEN 'assign' THEN 'reads' ELSE 'writes' END, CASE op WHEN 'assign' THEN 1 ELSE 3 END, true FROM dst WHERE regexp_matches(text, '[+]=') OR len(string_split(text, name)) > 2)
    SELECT {_ambiguity_sql("rmw")} FROM (SELECT *, row_number() OVER (PARTITION BY src_qname, dst_qname, kind, file, line ORDER BY step, seq) AS r FROM two) WHERE r = 1"""


@query(f"WITH {P.QUALIFIED}, {P.OCCURRENCES}, {_CALLS_SQL}")
def calls_edges(spark, sf_dir):
    return _plain(layers.calls(P.occurrences(spark, sf_dir), _qualified(spark, sf_dir)))


@query(f"WITH {P.QUALIFIED}, {P.OCCURRENCES}, {_EXPANDS_SQL}")
def expands_edges(spark, sf_dir):
    return _plain(layers.expands(P.occurrences(spark, sf_dir), _qualified(spark, sf_dir)))


@query(f"""WITH {P.OCCURRENCES} SELECT seq, name, file, line FROM o WHERE op = 'ref' AND NOT EXISTS (SELECT 1 FROM o w WHERE w.op = 'assign' AND w.name = o.name AND w.file = o.file AND w.line = o.line)""")
def reads_minus_writes(spark, sf_dir):
    o = P.occurrences(spark, sf_dir)
    wrote = o.where("op = 'assign'").select("name", "file", "line").distinct()
    return o.where("op = 'ref'").join(wrote, ["name", "file", "line"], "left_anti").select("seq", "name", "file", "line")


@query(f"WITH {P.QUALIFIED}, {P.OCCURRENCES}, {_ACCESSES_SQL}")
def rmw_compensation(spark, sf_dir):
    return _plain(layers.accesses(P.occurrences(spark, sf_dir), _qualified(spark, sf_dir)))


_HREFS = """h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS spec FROM pages), u AS (SELECT DISTINCT regexp_extract(url, '^https?://(.*)/[^/]*$', 1) AS path FROM pages)"""


def _includes(spark, sf_dir):
    pages = P.table(spark, sf_dir, "pages")
    specs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("spec"))
    headers = pages.select(F.regexp_extract("url", "^https?://(.*)/[^/]*$", 1).alias("path")).distinct()
    return specs, headers


@query(f"WITH {_HREFS} SELECT page_id, spec, path, count(*) AS n FROM h JOIN u ON CASE WHEN contains(spec, '/') THEN path = spec OR ends_with(path, '/' || spec) ELSE regexp_extract(path, '[^/]*$') = spec END GROUP BY ALL")
def includes_suffix_match(spark, sf_dir):
    specs, headers = _includes(spark, sf_dir)
    keyed = headers.withColumn("base", X.basename(F.col("path")))
    found = specs.withColumn("base", X.basename(F.col("spec"))).join(keyed, "base").where(X.include_matches(F.col("spec"), F.col("path")))
    return found.groupBy("page_id", "spec", "path").agg(F.count("*").alias("n"))


@query(f"""WITH {P.DEFINITIONS}, f AS (SELECT DISTINCT file FROM d), hs AS (SELECT file AS path, regexp_extract(file, '[^/]*$') AS base, count(*) OVER (PARTITION BY regexp_extract(file, '[^/]*$')) AS sharing FROM f WHERE regexp_matches(file, '\\.(h|hpp|hh)$')),
    inc AS (SELECT DISTINCT d.file, d.line_start AS line, CASE WHEN d.seq % 2 = 0 THEN x.file ELSE regexp_extract(x.file, '[^/]*$') END AS spec FROM d JOIN d x ON x.seq = d.seq - d.seq % 7 WHERE d.seq % 3 = 0)
    SELECT inc.file AS src_qname, path AS dst_qname, line, bool_and(NOT contains(spec, '/') AND sharing > 1) AS ambiguous FROM inc JOIN hs ON regexp_extract(spec, '[^/]*$') = base WHERE path <> inc.file AND (NOT contains(spec, '/') OR path = spec OR ends_with(path, '/' || spec)) GROUP BY ALL HAVING count(DISTINCT spec) = 1""")
def includes_edges(spark, sf_dir):
    d = P.definitions(spark, sf_dir)
    x = d.select(F.col("seq").alias("x"), F.col("file").alias("header"))
    found = d.where("seq % 3 = 0").withColumn("x", F.expr("seq - seq % 7")).join(x, "x")
    spec = F.when(F.col("seq") % 2 == 0, F.col("header")).otherwise(X.basename(F.col("header")))
    rows = found.select(F.lit(0).cast("long").alias("seq"), F.lit("include").alias("op"), X.basename(F.col("header")).alias("name"), F.lit("<global>").alias("scope"), "file", F.col("line_start").alias("line"), F.concat(F.lit('#include "'), spec, F.lit('"')).alias("text")).distinct()
    edges = layers.includes(rows, d.select(F.col("file").alias("path")).distinct())
    flat = edges.select("src_qname", "dst_qname", "line", P.flag(F.col("meta")).alias("ambiguous"))
    return flat.groupBy("src_qname", "dst_qname", "line").agg(F.bool_and("ambiguous").alias("ambiguous"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("""WITH h AS (SELECT DISTINCT p_type AS field, concat('p', p_partkey) AS dst_qname FROM part), c AS (SELECT field, CAST(count(*) AS INTEGER) AS handlers FROM h GROUP BY field)
    SELECT field, dst_qname, handlers FROM h JOIN c USING (field) WHERE handlers BETWEEN 1 AND 16""")
def fnptr_fanout_cap(spark, sf_dir):
    handlers = P.table(spark, sf_dir, "part").selectExpr("p_type as field", "concat('p', p_partkey) as dst_qname").distinct()
    return layers.fan_out(handlers)


@query(f"WITH {P.LINES}, w AS (SELECT file, line, unnest(regexp_extract_all(regexp_replace(clean, ',', ',,', 'g'), '[(,&] *([A-Za-z_][0-9A-Za-z_\\pL]*) *[,)]', 1)) AS name FROM t) SELECT file, line, name, count(*) AS n FROM w GROUP BY ALL")
def callback_token_rule(spark, sf_dir):
    lines = P.text_lines(spark, sf_dir)
    return lines.select("file", "line", F.explode(X.arguments(F.col("clean"))).alias("name")).groupBy("file", "line", "name").agg(F.count("*").alias("n"))


@query(f"WITH {P.CODE} SELECT file, line, name, count(*) AS n FROM (SELECT file, line, unnest(regexp_extract_all(clean, '(?:->|\\.)\\s*([0-9A-Za-z_]+)\\s*\\(', 1)) AS name FROM cl) GROUP BY ALL")
def dispatch_sites(spark, sf_dir):
    return P.code_lines(spark, sf_dir).select("file", "line", F.explode(X.dispatches(F.col("clean"))).alias("name")).groupBy("file", "line", "name").agg(F.count("*").alias("n"))


_REGISTERED = "SELECT file, line, unnest(regexp_extract_all(clean, '[.>]\\s*([0-9A-Za-z_]+)\\s*=\\s*&?\\s*([0-9A-Za-z_]+)', 1)) AS field, unnest(regexp_extract_all(clean, '[.>]\\s*([0-9A-Za-z_]+)\\s*=\\s*&?\\s*([0-9A-Za-z_]+)', 2)) AS handler FROM cl"


@query(f"WITH {P.CODE} SELECT file, line, field, handler, count(*) AS n FROM ({_REGISTERED}) GROUP BY ALL")
def registration_pairs(spark, sf_dir):
    pairs = P.code_lines(spark, sf_dir).select("file", "line", F.inline(X.registrations(F.col("clean"))))
    return pairs.groupBy("file", "line", "field", "handler").agg(F.count("*").alias("n"))


@query(f"""WITH {P.QUALIFIED}, {P.CODE}, {P.AROUND}, rp AS ({_REGISTERED}),
    h AS (SELECT DISTINCT field, q.qname AS dst FROM rp JOIN q ON q.name = rp.handler AND q.kind = 'function' WHERE NOT q.is_static OR q.file = rp.file OR regexp_matches(q.file, '\\.(h|hpp|hh)$')),
    c AS (SELECT field, CAST(count(*) AS INTEGER) AS handlers FROM h GROUP BY field HAVING count(*) <= 16), s AS (SELECT file, line, unnest(regexp_extract_all(clean, '(?:->|\\.)\\s*([0-9A-Za-z_]+)\\s*\\(', 1)) AS field, seq FROM cl)
    SELECT src_qname, dst AS dst_qname, file, line, min(field) AS field, min(handlers) AS handlers FROM (SELECT ar.src_qname, h.dst, s.file, s.line, s.field, handlers, row_number() OVER (PARTITION BY ar.src_qname, h.dst, s.file, s.line ORDER BY s.seq) AS r FROM s JOIN ar USING (file, line) JOIN h USING (field) JOIN c USING (field) WHERE ar.src_qname <> h.dst) WHERE r = 1 GROUP BY ALL""")
def dispatched_edges(spark, sf_dir):
    e = assemble.first_wins(layers.dispatched(P.code_lines(spark, sf_dir), _qualified(spark, sf_dir)))
    return e.select("src_qname", "dst_qname", "file", "line", F.col("meta.field").alias("field"), F.col("meta.handlers").alias("handlers"))


@query(f"""WITH {P.QUALIFIED}, {P.CODE}, {P.AROUND}, n AS (SELECT seq, file, line, regexp_extract(clean, ', (sym[0-9]+) ,', 1) AS name FROM cl WHERE contains(clean, 'qsort')), s AS (SELECT n.*, src_qname FROM n JOIN ar USING (file, line) WHERE src_name <> name), {P.targets_of("s", "function")}
    SELECT DISTINCT src_qname, dst_qname, file, line, candidates > 1 AS ambiguous FROM dst WHERE src_qname <> dst_qname""")
def callback_edges(spark, sf_dir):
    e = assemble.first_wins(layers.callbacks(P.code_lines(spark, sf_dir), _qualified(spark, sf_dir)))
    return e.select("src_qname", "dst_qname", "file", "line", P.flag(F.col("meta")).alias("ambiguous"))


@query()
def strip_comments_lines(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return S.source_lines(docs).select("file", "line", "clean")


@query(f"""WITH {P.CODE} SELECT 'call' AS op, name, file, line FROM (SELECT file, line, unnest(regexp_extract_all(clean, '([A-Za-z_][0-9A-Za-z_]*)\\s*\\(', 1)) AS name FROM cl) WHERE name NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'defined')""")
def lexical_occurrences(spark, sf_dir):
    return S.lexical_occurrences(P.code_lines(spark, sf_dir)).select("op", "name", "file", "line")


_NAMES = f"""{P.QUALIFIED}, s AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN concat('sym', l_partkey // 3) WHEN l_linenumber = 2 THEN concat('none', l_partkey % 50) ELSE f.qname END AS symbol FROM lineitem JOIN q f ON f.seq = l_partkey),
    ex AS (SELECT qname AS symbol, arg_max(kind, seq) AS kind FROM q GROUP BY qname), un AS (SELECT name AS symbol, min(qname) AS qname FROM q WHERE kind = 'function' GROUP BY name HAVING count(*) = 1),
    r AS (SELECT symbol, CASE WHEN ex.kind IS NOT NULL THEN symbol ELSE coalesce(un.qname, symbol) END AS qname, coalesce(ex.kind, 'function') AS kind, ex.kind IS NULL AND un.qname IS NULL AS missing FROM s LEFT JOIN ex USING (symbol) LEFT JOIN un USING (symbol))"""


def _resolved(spark, sf_dir):
    q = _qualified(spark, sf_dir)
    l = P.table(spark, sf_dir, "lineitem").select("l_partkey", F.least("l_linenumber", F.lit(3)).alias("l_linenumber")).distinct()  # noqa: E741
    named = l.join(q.select(F.col("seq").alias("l_partkey"), "qname"), "l_partkey")
    symbol = F.when(F.col("l_linenumber") == 1, F.expr("concat('sym', l_partkey div 3)")).when(F.col("l_linenumber") == 2, F.expr("concat('none', l_partkey % 50)")).otherwise(F.col("qname"))
    return layers.resolve_names(named.select(symbol.alias("symbol")), q), q


@query(f"WITH {_NAMES} SELECT symbol, qname, kind, missing FROM r")
def manual_links_ladder(spark, sf_dir):
    return _resolved(spark, sf_dir)[0]


@query(f"WITH {_NAMES} SELECT qname, kind, '(manual)' AS file, 'manual' AS origin FROM r WHERE missing")
def manual_placeholders(spark, sf_dir):
    return layers.placeholders(_resolved(spark, sf_dir)[0]).select("qname", "kind", "file", "origin")


@query(f"""WITH {_NAMES}, {P.CODE}, {P.AROUND}, g AS (SELECT DISTINCT concat('f', l_suppkey % 400) AS field, concat('sym', l_partkey // 3) AS handler FROM lineitem WHERE l_linenumber = 1),
    site AS (SELECT file, line, unnest(regexp_extract_all(clean, '(?:->|\\.)\\s*([0-9A-Za-z_]+)\\s*\\(', 1)) AS field FROM cl)
    SELECT DISTINCT src_qname, r.qname AS dst_qname, site.file, site.line, 'manual' AS origin, true AS manual FROM site JOIN ar USING (file, line) JOIN g USING (field) JOIN r ON r.symbol = g.handler WHERE NOT (src_qname = r.qname AND r.kind = 'function')""")
def manual_registrations(spark, sf_dir):
    resolved, definitions = _resolved(spark, sf_dir)
    l = P.table(spark, sf_dir, "lineitem").where("l_linenumber = 1")  # noqa: E741
    by_hand = l.selectExpr("l_suppkey % 400 as f", "l_partkey div 3 as h").distinct().selectExpr("concat('f', f) as field", "concat('sym', h) as handler", "cast(null as string) as struct")
    # a row for each edge already; a symbol of these stands for one qname, and no two for the same
    edges = layers.registered(P.code_lines(spark, sf_dir, distinct=False), by_hand, definitions, resolved, storage.checkpoint)
    return edges.select("src_qname", "dst_qname", "file", "line", "origin", F.col("meta.manual").alias("manual"))


_PAIRS = """g AS (SELECT DISTINCT l_orderkey AS c, concat('p', l_partkey) AS path FROM lineitem), s AS (SELECT c FROM g GROUP BY c HAVING count(*) BETWEEN 2 AND 20),
    pr AS (SELECT x.path AS a, y.path AS b, count(*) AS count FROM g x JOIN g y ON x.c = y.c AND x.path < y.path WHERE x.c IN (SELECT c FROM s) GROUP BY ALL HAVING count(*) >= 2)"""


def _commits(spark, sf_dir):
    return P.table(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as string) as commit_id", "concat('p', l_partkey) as path")


@query(f"WITH {_PAIRS} SELECT a, b, count FROM pr")
def co_change_pairs(spark, sf_dir):
    return layers.co_change_pairs(_commits(spark, sf_dir))


@query(f"WITH {_PAIRS}, top AS (SELECT min(a) AS f FROM pr) SELECT CASE WHEN a = f THEN b ELSE a END AS file, CAST(count AS INTEGER) AS count FROM pr, top WHERE a = f OR b = f")
def co_changed_with(spark, sf_dir):
    c = _commits(spark, sf_dir)
    edges = storage.checkpoint(assemble.first_wins(layers.co_changes(c, c.select("path").distinct())))
    return verbs.co_changed(edges, edges.agg(F.min("src_qname").alias("f")).first().f)


_ENTRIES = """e AS (SELECT CAST(s_nationkey % 3 AS INTEGER) AS db_prio, CAST(s_suppkey AS INTEGER) AS pos, concat('/w/./d', s_suppkey % 5, '/x/..') AS directory, concat('f', s_suppkey % 17, '.c') AS file, concat('cc -DV=', s_suppkey % 4) AS command FROM supplier),
    k AS (SELECT *, concat('/w/d', pos % 5, '/', file) AS key FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY db_prio, pos) AS r FROM k)"""


def _entries(spark, sf_dir):
    s = P.table(spark, sf_dir, "supplier").selectExpr("cast(s_nationkey % 3 as int) as db_prio", "cast(s_suppkey as int) as pos", "concat('/w/./d', s_suppkey % 5, '/x/..') as directory", "concat('f', s_suppkey % 17, '.c') as file", "cast(null as array<string>) as arguments", "concat('cc -DV=', s_suppkey % 4) as command")
    return C.merge_compile_entries(s)


@query(f"WITH {_ENTRIES} SELECT key, db_prio, pos, command FROM f WHERE r = 1")
def compile_db_first_wins(spark, sf_dir):
    return _entries(spark, sf_dir)[0].select("key", "db_prio", "pos", "command")


@query(f"WITH {_ENTRIES} SELECT x.key, x.db_prio, x.pos FROM f x JOIN f y ON y.key = x.key AND y.r = 1 WHERE x.r > 1 AND x.command <> y.command")
def compile_db_conflicts(spark, sf_dir):
    return _entries(spark, sf_dir)[1]


@query(f"""WITH {P.DEFINITIONS}, f AS (SELECT DISTINCT file FROM d), i AS (SELECT string_agg(DISTINCT concat('-I/w/', regexp_extract(file, '^(.*)/', 1)), ' ' ORDER BY concat('-I/w/', regexp_extract(file, '^(.*)/', 1))) AS flags FROM f WHERE ends_with(file, '.h'))
    SELECT file, concat('cc -std=gnu11 ', flags, ' -c ', file) AS command FROM f, i WHERE ends_with(file, '.c')""")
def compile_db_synthesized(spark, sf_dir):
    files = P.definitions(spark, sf_dir).select(F.col("file").alias("path")).distinct()
    return C.synthesize_compile_entries(files, "/w").select("file", F.array_join("arguments", " ").alias("command"))


@query(f"""WITH {P.EDGES} SELECT src, dst, kind, file, line, origin, CASE WHEN origin = 'cscope' AND kind = 'calls' THEN CASE WHEN EXISTS (SELECT 1 FROM e c WHERE c.origin = 'clink' AND c.src = e.src AND c.dst = e.dst AND c.kind = e.kind) THEN 'confirmed' ELSE 'absent' END ELSE '' END AS semantic FROM e""")
def semantic_confirm(spark, sf_dir):
    told = layers.confirm(P.edges(spark, sf_dir))
    return told.select(F.col("src_qname").alias("src"), F.col("dst_qname").alias("dst"), "kind", "file", "line", "origin", F.coalesce("meta.semantic", F.lit("")).alias("semantic"))


@query(f"""WITH {P.QUALIFIED}, {P.OCCURRENCES}, s AS (SELECT seq, op, name, scope, file, line, text FROM o WHERE op IN ('call', 'assign')), {P.source_of("s")},
    t AS (SELECT *, CASE op WHEN 'call' THEN 'calls' ELSE 'writes' END AS kind FROM src), {P.targets_of("t", "function").replace("dst AS", "d1 AS")}, {P.targets_of("t", "global").replace("dst AS", "d2 AS")}
    SELECT DISTINCT src_qname, dst_qname, kind, file, line, 'clink' AS origin, CAST(0.93 AS DOUBLE) AS confidence, candidates > 1 AS ambiguous, candidates, false AS rmw FROM (SELECT * FROM d1 WHERE kind = 'calls' AND src_qname <> dst_qname UNION ALL SELECT * FROM d2 WHERE kind = 'writes')""")
def semantic_import(spark, sf_dir):
    o = P.occurrences(spark, sf_dir).where("op in ('call', 'assign')")
    facts = o.select(F.when(F.col("op") == "call", 1).otherwise(4).alias("category"), "name", F.col("scope").alias("parent"), F.col("file").alias("path"), "line")
    return _plain(layers.semantic(facts, _qualified(spark, sf_dir)))


# --- incremental


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 2)
    SELECT concat('doc', coalesce(a.doc_id, b.doc_id)) AS path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def drift_full_outer(spark, sf_dir):
    """Two versions of a tree, made from documents."""
    d = P.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("path"), "text")
    old = d.where("doc_id % 10 != 1").select("path", F.sha2("text", 256).alias("content_hash"))
    new = d.where("doc_id % 10 != 2").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return B.changes(old, new)


def _facts(spark, sf_dir, touched: bool) -> B.Facts:
    """A tree whose files name what they define and use; some change, some go."""
    d, o = P.definitions(spark, sf_dir), P.occurrences(spark, sf_dir)
    if touched:
        d = d.where("file not like 'src3/%'").withColumn("line_end", F.when(F.col("file").like("src5/%"), F.col("line_end") + 3).otherwise(F.col("line_end")))
        o = o.where("file not like 'src3/%' and not (file like 'src5/%' and seq % 4 = 0)")
    # one definition for each qname that would repeat
    d = d.withColumn("__r", F.expr("row_number() over (partition by file, kind, name order by seq)")).where("__r = 1").drop("__r")
    words = d.select("file", F.concat_ws(" ", "name", "line_end").alias("w")).union(o.select("file", F.concat_ws(" ", "text", "line", "scope").alias("w")))
    text = words.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("w")), "\n").alias("t"))
    files = text.select(F.col("file").alias("path"), F.col("t").cast("binary").alias("content"), F.sha2("t", 256).alias("content_hash"))
    return B.Facts(files, storage.checkpoint(d), storage.checkpoint(o))


_TOUCHED = f"""{P.QUALIFIED.replace(P.DEFINITIONS, P.DEFINITIONS.replace("d AS (", "d0 AS (", 1) + """,
    d AS (SELECT * EXCLUDE (r) FROM (SELECT * EXCLUDE (line_end), CASE WHEN file LIKE 'src5/%' THEN line_end + 3 ELSE line_end END AS line_end, row_number() OVER (PARTITION BY file, kind, name ORDER BY seq) AS r FROM d0 WHERE file NOT LIKE 'src3/%') WHERE r = 1)""")},
    {P.OCCURRENCES.replace("o AS (", "o0 AS (", 1)}, o AS (SELECT * FROM o0 WHERE file NOT LIKE 'src3/%' AND NOT (file LIKE 'src5/%' AND seq % 4 = 0))"""


@query(f"""WITH {_TOUCHED} SELECT * FROM (WITH {_CALLS_SQL}) UNION ALL SELECT * FROM (WITH {_EXPANDS_SQL}) UNION ALL SELECT * FROM (WITH {_ACCESSES_SQL})""")
def incremental_equals_full(spark, sf_dir):
    """Calls, expansions and accesses of a rebuild after files changed and went; the SQL builds them from nothing."""
    before = B.build(spark, _facts(spark, sf_dir, False))
    edges = B.rebuild(spark, _facts(spark, sf_dir, True), before).edges
    return _flat(edges.where("origin = 'cscope' and kind in ('calls', 'expands', 'reads', 'writes')"))


@query(f"WITH {P.PAIRS} SELECT src, dst, kind, site_count, origins FROM pairs")
def published_pairs(spark, sf_dir):
    """Pairs as a reader of the published graph finds them, by source."""
    folder = f"{storage.shared_dir(spark)}/published-{uuid.uuid4().hex}"
    storage.publish(spark, folder, {"edge_pairs": assemble.edge_pairs(P.edges(spark, sf_dir))})
    found = storage.load(spark, folder)["edge_pairs_by_src"]
    return found.select(F.col("src_qname").alias("src"), F.col("dst_qname").alias("dst"), "kind", "site_count", "origins")


# --- sources


@query(f"WITH {P.DEFINITIONS} SELECT name, kind, file, line_start, line_end, signature FROM d")
def tags_read(spark, sf_dir):
    """Tags as an extractor writes them, with lines of other kinds and of no kind between."""
    folder = f"{storage.shared_dir(spark)}/tags-{uuid.uuid4().hex}"
    kind = F.when(F.col("kind") == "global", "variable").otherwise(F.col("kind"))
    tag = F.to_json(F.struct(F.lit("tag").alias("_type"), "name", F.concat(F.lit("./"), "file").alias("path"), F.col("line_start").alias("line"), F.col("line_end").alias("end"), kind.alias("kind"), "signature"))
    other = F.to_json(F.struct(F.lit("tag").alias("_type"), "name", F.col("file").alias("path"), F.col("line_start").alias("line"), F.lit("typedef").alias("kind")))
    P.definitions(spark, sf_dir).select(F.explode(F.array(tag, other, F.lit("not json"), F.lit('{"_type": "ptag", "name": "x"}')))).write.text(folder)
    return C.read_tags(spark, folder).select("name", "kind", "file", "line_start", "line_end", "signature")


@query(f"WITH {P.OCCURRENCES} SELECT name, concat('fn', seq % 97) AS scope, file, line, concat('y = ', name, '(1);') AS text FROM o")
def crossref_read(spark, sf_dir):
    """Calls from a cross-reference with a section for each file."""
    folder = f"{storage.shared_dir(spark)}/crossref-{uuid.uuid4().hex}"
    record = F.format_string("\t$fn%d\n%d y = \n\t`%s\n(1);\n\n\t}\n", F.col("seq") % 97, "line", "name")
    sections = P.occurrences(spark, sf_dir).groupBy("file").agg(F.array_join(F.collect_list(record), "").alias("body")).select(F.lit(1).alias("at"), F.concat("file", F.lit("\n\n"), "body").alias("value"))
    ends = spark.createDataFrame([(0, "cscope 15 /w -c               0000000001"), (2, "\n0\n")], "at int, value string")
    ends.unionByName(sections).repartition(1).sortWithinPartitions("at").select("value").write.option("lineSep", "\n\t@").text(folder)
    return crossref.read_crossref(spark, folder).where("op = 'call'").select("name", "scope", "file", "line", "text")


# --- other verbs


_ACCESS = f"WITH {P.EDGES}, a AS (SELECT *, CASE kind WHEN 'calls' THEN 'reads' ELSE 'writes' END AS acc FROM e WHERE kind <> 'callback')"


def _accesses(spark, sf_dir):
    e = P.edges(spark, sf_dir).where("kind != 'callback'")
    return e.withColumn("kind", F.when(F.col("kind") == "calls", "reads").otherwise("writes")).withColumn("dst_kind", F.lit("global"))


@query(_ACCESS + ", w AS (SELECT DISTINCT src FROM a WHERE dst = 'p7' AND acc = 'writes'), r AS (SELECT src FROM a WHERE dst = 'p7' AND acc = 'reads' EXCEPT SELECT src FROM w) SELECT 'writer' AS role, src AS qname FROM w UNION ALL SELECT 'reader', src FROM r")
def globals_readers_writers(spark, sf_dir):
    nodes = P.nodes(spark, sf_dir).withColumn("kind", F.lit("global"))
    return verbs.global_users(_accesses(spark, sf_dir), nodes, "p7").select("role", "qname")


@query(_ACCESS + " SELECT dst AS qname, acc AS access, concat(file, ':', line) AS site, origin FROM a WHERE src = 's3'")
def vars_of(spark, sf_dir):
    return verbs.accesses_of(_accesses(spark, sf_dir), P.nodes(spark, sf_dir), "s3").select("qname", "access", "site", "origin")


@query(f"WITH {P.EDGES} SELECT DISTINCT src AS file FROM e WHERE dst = 'p7'")
def who_includes(spark, sf_dir):
    e = P.edges(spark, sf_dir).withColumn("kind", F.lit("includes"))
    return verbs.includers(e, P.nodes(spark, sf_dir).withColumn("kind", F.lit("file")), "p7")


@query(f"WITH {P.EDGES}, {P.NODES} SELECT 'nodes' AS what, 'function' AS kind, '' AS origin, count(*) AS n FROM n UNION ALL SELECT 'edges', kind, origin, count(*) FROM e GROUP BY kind, origin")
def schema_counts(spark, sf_dir):
    return verbs.layer_counts(P.nodes(spark, sf_dir), P.edges(spark, sf_dir))


@query(f"WITH {P.EDGES} SELECT o.origin, count(e.origin) AS n FROM (VALUES ('cscope'), ('clink'), ('fnptr'), ('git')) o(origin) LEFT JOIN e USING (origin) GROUP BY o.origin")
def layer_fill(spark, sf_dir):
    known = spark.createDataFrame([("cscope",), ("clink",), ("fnptr",), ("git",)], "origin string")
    return known.join(assemble.counts(P.edges(spark, sf_dir), "origin"), "origin", "left").select("origin", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {P.EDGES} SELECT origin FROM (VALUES ('fnptr'), ('callback'), ('clink'), ('clangd')) o(origin) WHERE origin NOT IN (SELECT origin FROM e)")
def pending_layers(spark, sf_dir):
    return verbs.missing_layers(P.edges(spark, sf_dir)).select("origin")


@query("""WITH i AS (SELECT event_type, CASE WHEN value > 95 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END AS s FROM events) SELECT event_type, CASE max(s) WHEN 2 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'OK' END AS health, count(*) FILTER (s > 0) AS issues FROM i GROUP BY event_type""")
def status_health(spark, sf_dir):
    rank = F.when(F.col("value") > 95, 2).when(F.col("value") > 50, 1).otherwise(0)
    names = F.array(*(F.lit(verbs.health_of({x})) for x in verbs.SEVERITY))
    return P.table(spark, sf_dir, "events").groupBy("event_type").agg(F.get(names, F.max(rank)).alias("health"), F.count_if(rank > 0).alias("issues"))


@query("SELECT origin, CAST(confidence AS DOUBLE) AS confidence, confidence >= 0.7 AS shown FROM (VALUES ('manual', 1.0), ('ctags', 0.95), ('clangd', 0.95), ('cscope', 0.9), ('cindex', 0.9), ('treesitter', 0.85), ('fnptr', 0.8), ('clink', 0.93), ('clangd-nobuild', 0.75), ('callback', 0.7), ('git', 0.5)) v(origin, confidence)")
def confidence_registry(spark, sf_dir):
    t = schema.confidence_table(spark)
    return t.select("origin", schema.confidence(F.col("origin")).alias("confidence"), (F.col("confidence") >= schema.MIN_CONFIDENCE).alias("shown"))


@query(f"""WITH {P.EDGES} SELECT src, dst, kind, file, line, origin, CASE WHEN amb THEN '{{"ambiguous":true,"candidates":2}}' ELSE '{{}}' END AS meta, concat('[', origin, CASE WHEN amb THEN '; ambiguous 2 candidates' ELSE '' END, ']') AS tags FROM e""")
def meta_rendering(spark, sf_dir):
    """Meta as JSON, read back and rendered."""
    e = P.edges(spark, sf_dir).withColumn("json", schema.meta_json(F.col("meta")))
    return e.select(F.col("src_qname").alias("src"), F.col("dst_qname").alias("dst"), "kind", "file", "line", "origin", F.col("json").alias("meta"), X.tags(F.col("origin"), schema.meta_of_json(F.col("json"))).alias("tags"))


@query("""SELECT d, n, (SELECT count(DISTINCT l_shipdate::DATE) FROM lineitem) > 200 AS more FROM (SELECT l_shipdate::DATE::VARCHAR AS d, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY d LIMIT 200)""")
def sql_gate_capped(spark, sf_dir):
    """A query of more rows than are shown, and that there are more."""
    rows, more = sqlgate.run(spark, "SELECT cast(to_date(l_shipdate) AS string) AS d, count(*) AS n FROM gate_lines GROUP BY 1 ORDER BY 1", {"gate_lines": P.table(spark, sf_dir, "lineitem")})
    return spark.createDataFrame([(*r, more) for r in rows], "d string, n long, more boolean")


# --- reports over runs


_MEDIANS = "m AS (SELECT CAST(l_orderkey AS VARCHAR) AS question, l_returnflag AS arm, CAST(floor(median(l_quantity)) AS BIGINT) AS score, max(l_quantity) - min(l_quantity) >= 2 AS wide FROM lineitem GROUP BY ALL HAVING count(*) = 3)"


def _medians(spark, sf_dir):
    scores = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("question"), F.col("l_returnflag").alias("arm"), F.col("l_quantity").alias("score"))
    return reports.medians(scores)


@query(f"WITH {_MEDIANS} SELECT * FROM m")
def repetition_medians(spark, sf_dir):
    return _medians(spark, sf_dir)


@query(f"WITH {_MEDIANS} SELECT question, max(score) FILTER (arm = 'A') AS a, max(score) FILTER (arm = 'N') AS n, max(score) FILTER (arm = 'R') AS r FROM m GROUP BY question")
def arm_pivot_median(spark, sf_dir):
    wide = reports.by_question(_medians(spark, sf_dir), "question", "arm", ["A", "N", "R"], F.col("score"))
    return wide.select("question", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query(f"WITH {_MEDIANS}, c AS (SELECT l_returnflag AS arm, sum(l_extendedprice) AS cost FROM lineitem GROUP BY 1), t AS (SELECT arm, CAST(sum(score) AS BIGINT) AS points FROM m GROUP BY arm) SELECT arm, points, round(cost, 2) AS cost, round(cost / points, 4) AS cost_per_point FROM t JOIN c USING (arm)")
def points_by_cost(spark, sf_dir):
    costs = P.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_extendedprice").alias("cost"))
    return reports.points(_medians(spark, sf_dir), costs).select("arm", "points", F.round("cost", 2).alias("cost"), F.round("cost_per_point", 4).alias("cost_per_point"))


@query("""WITH u AS (SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS VARCHAR) AS id, text, regexp_extract(ltrim(text), '^\\S*') AS word FROM conversations WHERE role = 'assistant'), r AS (SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn - 1 AS VARCHAR) AS id, max(length(text)) AS bytes FROM conversations WHERE role <> 'assistant' GROUP BY ALL)
    SELECT session, id, CASE WHEN trim(text) = '' THEN '(empty)' ELSE concat('other:', regexp_extract(word, '[^/]*$')) END AS sig, CAST(coalesce(r.bytes, 0) AS INTEGER) AS bytes FROM u LEFT JOIN r USING (session, id)""")
def transcript_calls(spark, sf_dir):
    """Conversations as transcripts: what an assistant says is a command, what follows is its result."""
    c = P.table(spark, sf_dir, "conversations")
    said = F.struct(F.lit("tool_use").alias("type"), F.col("turn").cast("string").alias("id"), F.lit("Bash").alias("name"), F.struct(F.col("text").alias("command")).alias("input"))
    told = F.struct(F.lit("tool_result").alias("type"), (F.col("turn") - 1).cast("string").alias("tool_use_id"), F.col("text").alias("content"))
    message = lambda block: F.to_json(F.struct(F.struct(F.array(block).alias("content")).alias("message")))
    lines = c.select(F.col("conv_id").cast("string").alias("session"), F.when(F.col("role") == "assistant", message(said)).otherwise(message(told)).alias("value"))
    return reports.transcript_calls(lines).select("session", "id", "sig", "bytes")


@query("SELECT replace(concat('/old/w', s_nationkey), '/old', '/new') AS directory, concat('f', s_suppkey, '.c') AS file, concat('cc -I/new/i', s_suppkey) AS command, concat('cc /new/', s_name) AS arguments FROM supplier")
def moved_compile_entries(spark, sf_dir):
    entries = P.table(spark, sf_dir, "supplier").selectExpr("concat('/old/w', s_nationkey) as directory", "concat('f', s_suppkey, '.c') as file", "concat('cc -I/old/i', s_suppkey) as command", "array('cc', concat('/old/', s_name)) as arguments")
    return reports.moved_entries(entries, "/old", "/new").select("directory", "file", "command", F.array_join("arguments", " ").alias("arguments"))


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'PASS' ELSE 'FAIL' END AS verdict, concat('line ', l_orderkey, '/', l_linenumber) AS text FROM lineitem WHERE l_returnflag <> 'R'")
def verdict_lines(spark, sf_dir):
    lines = P.table(spark, sf_dir, "lineitem").selectExpr("concat(CASE l_returnflag WHEN 'A' THEN 'PASS: ' WHEN 'N' THEN 'FAIL ' ELSE 'PASSED ' END, 'line ', l_orderkey, '/', l_linenumber) as value")
    return reports.verdicts(lines)


@query("SELECT DISTINCT p_brand AS question, p_size AS arm FROM part EXCEPT SELECT p_brand, p_size FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50")
def waiting_cells(spark, sf_dir):
    part = P.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("question"), F.col("p_size").alias("arm"))
    done = P.table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    return reports.waiting(part.select("question", "arm").distinct(), done, ["question", "arm"])


@query("WITH a AS (SELECT o_orderkey, o_totalprice AS s FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS s FROM orders WHERE o_orderstatus <> 'F') SELECT concat('o', coalesce(a.o_orderkey, b.o_orderkey)) AS path, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE a.s IS DISTINCT FROM b.s")
def dirty_sentinels(spark, sf_dir):
    """Two looks at sizes and times of files, made from orders."""
    o = P.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), F.col("o_totalprice").alias("size"), "o_custkey", "o_orderstatus")
    now = o.where("o_orderstatus != 'F'").withColumn("size", F.when(F.col("o_custkey") % 9 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return reports.dirty(o.where("o_orderstatus != 'P'"), now)


@query("""WITH s AS (SELECT role, regexp_extract(text, '^\\S+') AS sig, count(*) AS n, sum(strlen(text)) AS bytes FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY bytes DESC, sig) AS k FROM s)
    SELECT role, sig, n, CAST(bytes AS BIGINT) AS bytes, round(bytes / n, 2) AS avg_bytes FROM r WHERE k <= 12""")
def topk_signatures(spark, sf_dir):
    calls = P.table(spark, sf_dir, "conversations").select("role", F.regexp_extract("text", r"^\S+", 0).alias("sig"), F.octet_length("text").alias("bytes"))
    return reports.top_signatures(calls, "role").select("role", "sig", F.col("calls").alias("n"), F.col("bytes").cast("long").alias("bytes"), F.round("avg_bytes", 2).alias("avg_bytes"))


@query("SELECT l_returnflag AS arm, sum(CAST(l_quantity AS BIGINT)) AS turns, count(*) AS runs, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1")
def arm_sums(spark, sf_dir):
    runs = P.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_quantity").cast("long").alias("turns"), F.col("l_extendedprice").alias("cost"))
    return reports.sums(runs, "arm", ["turns", "cost"]).withColumn("cost", F.round("cost", 2))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY ALL")
def latest_run_upsert(spark, sf_dir):
    """Last wins: the newest row of each key."""
    rows = P.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return reports.latest(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", F.col("event_id").alias("last_id"))


@query("SELECT c_custkey AS run FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def runs_without_use(spark, sf_dir):
    calls = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderstatus").alias("name"))
    return reports.unused(P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session")), calls, "F").select(F.col("session").alias("run"))
