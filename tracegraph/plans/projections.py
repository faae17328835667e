"""The graph contract over the star-schema test tables, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FILE = "concat('src', {p}p_partkey % 11, '/', {p}p_brand, CASE WHEN {p}p_partkey % 7 = 0 THEN '.h' ELSE '.c' END)"
_KIND = "CASE {p}p_partkey % 5 WHEN 3 THEN 'global' WHEN 4 THEN 'macro' ELSE 'function' END"


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as seq", "concat('sym', p_partkey div 3) as name", f"{_KIND.format(p='')} as kind", f"{_FILE.format(p='')} as file", "cast(p_size * 10 as int) as line_start", "cast(p_size * 10 + 15 as int) as line_end", "p_size % 2 = 0 as is_static", "p_type as signature")


DEFINITIONS = f"""d AS (SELECT p_partkey AS seq, concat('sym', p_partkey // 3) AS name, {_KIND.format(p="")} AS kind, {_FILE.format(p="")} AS file,
    CAST(p_size * 10 AS INTEGER) AS line_start, CAST(p_size * 10 + 15 AS INTEGER) AS line_end, p_size % 2 = 0 AS is_static, p_type AS signature FROM part)"""

QUALIFIED = f"""{DEFINITIONS},
    dc AS (SELECT *, CASE WHEN is_static OR count(*) OVER (PARTITION BY name, kind) > 1 THEN concat(file, '::', name) ELSE name END AS q0 FROM d),
    q AS (SELECT * EXCLUDE (q0), CASE WHEN row_number() OVER (PARTITION BY q0, kind ORDER BY seq) = 1 THEN q0 ELSE concat(q0, ':', line_start) END AS qname FROM dc)"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")  # noqa: E741
    n, s = p.select([F.col(c).alias(f"n_{c}") for c in p.columns]), p.select([F.col(c).alias(f"s_{c}") for c in p.columns])
    both = l.join(n, F.col("l_partkey") == F.col("n_p_partkey")).join(s, F.col("l_suppkey") == F.col("s_p_partkey"))
    name = "concat('sym', l_partkey div 3)"
    return both.selectExpr(
        "l_orderkey * 8 + l_linenumber as seq",
        "CASE l_returnflag WHEN 'N' THEN 'call' WHEN 'A' THEN 'ref' ELSE 'assign' END as op",
        f"{name} as name",
        "CASE WHEN l_quantity < 3 THEN '<global>' ELSE concat('sym', l_suppkey div 3) END as scope",
        f"CASE WHEN l_linenumber % 3 = 0 THEN {_FILE.format(p='n_')} ELSE {_FILE.format(p='s_')} END as file",
        "cast(s_p_size * 10 + l_linenumber as int) as line",
        f"CASE l_linenumber % 3 WHEN 0 THEN concat({name}, ' += 1;') WHEN 1 THEN concat('y = f(', {name}, ', ', {name}, ');') ELSE concat('x = ', {name}, ';') END as text",
    )


OCCURRENCES = f"""o AS (SELECT l_orderkey * 8 + l_linenumber AS seq, CASE l_returnflag WHEN 'N' THEN 'call' WHEN 'A' THEN 'ref' ELSE 'assign' END AS op,
    concat('sym', l_partkey // 3) AS name, CASE WHEN l_quantity < 3 THEN '<global>' ELSE concat('sym', l_suppkey // 3) END AS scope,
    CASE WHEN l_linenumber % 3 = 0 THEN {_FILE.format(p="n.")} ELSE {_FILE.format(p="s.")} END AS file,
    CAST(s.p_size * 10 + l_linenumber AS INTEGER) AS line,
    CASE l_linenumber % 3 WHEN 0 THEN concat('sym', l_partkey // 3, ' += 1;') WHEN 1 THEN concat('y = f(sym', l_partkey // 3, ', sym', l_partkey // 3, ');') ELSE concat('x = sym', l_partkey // 3, ';') END AS text
    FROM lineitem JOIN part n ON l_partkey = n.p_partkey JOIN part s ON l_suppkey = s.p_partkey)"""


def source_of(name: str = "o", kind: str = "function") -> str:
    """The ladder of sources in SQL: rows of ``name`` with src_qname."""
    return f"""src AS (SELECT {name}.seq, {name}.op, {name}.name, {name}.file, {name}.line, {name}.text, src_qname FROM {name} JOIN (
        SELECT k_scope, k_file, k_line, c.qname AS src_qname FROM (
            SELECT k_scope, k_file, k_line, CASE WHEN n_hit = 1 THEN hit WHEN n_file = 1 THEN here WHEN n_all = 1 THEN lone END AS src_seq FROM (
                SELECT k_scope, k_file, k_line, count(*) FILTER (c_file = k_file AND k_line BETWEEN line_start AND line_end) AS n_hit, min(c_seq) FILTER (c_file = k_file AND k_line BETWEEN line_start AND line_end) AS hit,
                    count(*) FILTER (c_file = k_file) AS n_file, min(c_seq) FILTER (c_file = k_file) AS here, count(*) AS n_all, min(c_seq) AS lone
                FROM (SELECT DISTINCT scope AS k_scope, file AS k_file, line AS k_line FROM {name}) k JOIN (SELECT name AS c_name, file AS c_file, seq AS c_seq, line_start, line_end FROM q WHERE kind = '{kind}') c ON c_name = k_scope GROUP BY ALL) u) w
            JOIN q c ON c.seq = src_seq) z ON k_scope = {name}.scope AND k_file = {name}.file AND k_line = {name}.line)"""


def targets_of(name: str, kind: str) -> str:
    """The targets of names in SQL: rows of ``name`` with dst_qname and candidates."""
    return f"""dst AS (SELECT {name}.*, c.qname AS dst_qname, c.n AS candidates FROM {name} JOIN (
        SELECT k.name AS k_name, k.file AS k_file, q.qname, CAST(count(*) OVER (PARTITION BY k.name, k.file) AS INTEGER) AS n FROM (SELECT DISTINCT name, file FROM {name}) k
        JOIN q ON q.name = k.name AND q.kind = '{kind}' WHERE NOT q.is_static OR q.file = k.file OR regexp_matches(q.file, '\\.(h|hpp|hh)$')) c ON k_name = {name}.name AND k_file = {name}.file)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites from line items; repeated sites keep the least row."""
    from ..operators.assemble import first_wins

    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('s', l_suppkey) as src_qname", "'function' as src_kind", "concat('p', l_partkey) as dst_qname", "'function' as dst_kind",
        "CASE l_returnflag WHEN 'N' THEN 'calls' WHEN 'A' THEN 'fnptr' ELSE 'callback' END as kind",
        "concat('m', month(l_shipdate), '.c') as file", "cast(l_linenumber as int) as line",
        "CASE l_linestatus WHEN 'O' THEN 'cscope' ELSE 'clink' END as origin",
        "l_discount >= 0.08 as amb", "struct(l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax) as rank",
    )
    full = raw.select("src_qname", "src_kind", "dst_qname", "dst_kind", "kind", "file", "line", "origin", schema.confidence(F.col("origin")).alias("confidence"), schema.meta(ambiguous=F.when(F.col("amb"), True), candidates=F.when(F.col("amb"), 2)).alias("meta"), "rank")
    return first_wins(full)


EDGES = """e AS (SELECT * EXCLUDE (r) FROM (SELECT concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst,
    CASE l_returnflag WHEN 'N' THEN 'calls' WHEN 'A' THEN 'fnptr' ELSE 'callback' END AS kind, concat('m', month(l_shipdate), '.c') AS file, CAST(l_linenumber AS INTEGER) AS line,
    CASE l_linestatus WHEN 'O' THEN 'cscope' ELSE 'clink' END AS origin, CAST(CASE l_linestatus WHEN 'O' THEN 0.90 ELSE 0.93 END AS DOUBLE) AS confidence, l_discount >= 0.08 AS amb,
    row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag, l_linestatus, month(l_shipdate), l_linenumber ORDER BY l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax) AS r FROM lineitem) WHERE r = 1)"""

PAIRS = EDGES + """,
    pairs AS (SELECT src, dst, kind, max(confidence) AS confidence, min(printf('%s:%09d', file, line)) AS first_site, count(*) AS site_count,
        string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, arg_min(amb, (CASE WHEN amb THEN 0 ELSE 1 END, origin, file, line)) AS amb FROM e GROUP BY src, dst, kind)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) as qname", "concat('dir', s_nationkey, '/s.c') as file", "cast(s_suppkey as int) as line_start", "concat('mod', s_nationkey % 4) as module")
    p = table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) as qname", "concat('dir', p_size % 25, '/p.c') as file", "cast(p_size as int) as line_start", "'' as module")
    return s.unionByName(p).selectExpr("qname as name", "qname", "'function' as kind", "file", "line_start", "line_start + 9 as line_end", "cast(null as string) as signature", "false as is_static", "module", "'ctags' as origin", "0.95D as confidence")


NODES = """n AS (SELECT concat('s', s_suppkey) AS qname, concat('dir', s_nationkey, '/s.c') AS file, CAST(s_suppkey AS INTEGER) AS line, concat('mod', s_nationkey % 4) AS module FROM supplier
    UNION ALL SELECT concat('p', p_partkey), concat('dir', p_size % 25, '/p.c'), CAST(p_size AS INTEGER), '' FROM part)"""


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph of all line items: from a part to that of the next line of its order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_linestatus")  # noqa: E741
    nxt = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to"))
    found = l.join(nxt, ["l_orderkey", "l_linenumber"])
    edges = found.select(F.concat(F.lit("p"), "l_partkey").alias("src_qname"), F.lit("function").alias("src_kind"), F.concat(F.lit("p"), "to").alias("dst_qname"), F.lit("function").alias("dst_kind"), F.when(F.col("l_linestatus") == "O", "fnptr").otherwise("calls").alias("kind"), F.lit("x.c").alias("file"), F.col("l_linenumber").alias("line"), F.lit("cscope").alias("origin"), F.lit(0.9).alias("confidence"), schema.meta(ambiguous=F.when(F.col("l_discount") >= 0.08, True)).alias("meta"))
    return storage.checkpoint(edges)


WALKS = """b AS (SELECT DISTINCT concat('p', a.l_partkey) AS src, concat('p', c.l_partkey) AS dst, a.l_discount >= 0.08 AS amb FROM lineitem a
    JOIN lineitem c ON a.l_orderkey = c.l_orderkey AND c.l_linenumber = a.l_linenumber + 1)"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as source lines."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select(F.concat(F.lit("doc"), "doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "clean")).select("file", (F.col("line") + 1).alias("line"), "clean", F.col("clean").alias("text"), (F.col("line") + 1).cast("long").alias("seq"))


LINES = """t AS (SELECT concat('doc', doc_id) AS file, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line, unnest(string_split(text, chr(10))) AS clean FROM documents WHERE text IS NOT NULL)"""


def flag(meta: Column) -> Column:
    return F.coalesce(meta["ambiguous"], F.lit(False))


def code_lines(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Lines of code made from line items: registrations, dispatches and functions passed as arguments. Without ``distinct`` they may repeat."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_suppkey") == F.col("p_partkey"))  # noqa: E741
    sym = "concat('sym', l_partkey div 3)"
    text = f"CASE l_linenumber WHEN 1 THEN concat('  ops.f', l_partkey % 400, ' = &', {sym}, ';') WHEN 2 THEN concat('  return o->f', l_partkey % 400, ' (x) + p.g', l_suppkey % 7, '(y);') WHEN 3 THEN concat('  qsort(base, ', {sym}, ' , n);') ELSE concat('  x = ', {sym}, '(y);') END"
    lines = l.selectExpr("cast(l_orderkey * 8 + l_linenumber as bigint) as seq", f"{_FILE.format(p='')} as file", "cast(p_size * 10 + l_linenumber as int) as line", f"{text} as clean", f"{text} as text")
    return lines.distinct() if distinct else lines


CODE = f"""cl AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS seq, {_FILE.format(p="")} AS file, CAST(p_size * 10 + l_linenumber AS INTEGER) AS line,
    CASE l_linenumber WHEN 1 THEN concat('  ops.f', l_partkey % 400, ' = &sym', l_partkey // 3, ';') WHEN 2 THEN concat('  return o->f', l_partkey % 400, ' (x) + p.g', l_suppkey % 7, '(y);')
    WHEN 3 THEN concat('  qsort(base, sym', l_partkey // 3, ' , n);') ELSE concat('  x = sym', l_partkey // 3, '(y);') END AS clean FROM lineitem JOIN part ON l_suppkey = p_partkey)"""

#: The first function around each line of code.
AROUND = """ar AS (SELECT k.file, k.line, arg_min(q.qname, q.seq) AS src_qname, arg_min(q.name, q.seq) AS src_name FROM (SELECT DISTINCT file, line FROM cl) k JOIN q ON q.kind = 'function' AND q.file = k.file AND k.line BETWEEN q.line_start AND q.line_end GROUP BY k.file, k.line)"""
