"""Tables of the graph, and the registry of what each origin is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 2

DEFINITIONS = "seq long, name string, kind string, file string, line_start int, line_end int, is_static boolean, signature string"
OCCURRENCES = "seq long, op string, name string, scope string, file string, line int, text string"
SEMANTIC = "category int, name string, parent string, path string, line int"
REGISTRATIONS = "field string, handler string, struct string"
LINKS = "src string, dst string"
MODULE_RULES = "prio int, pattern string, module string"
COMMITS = "commit_id string, path string"
COMPILE_ENTRIES = "db_prio int, pos int, directory string, file string, arguments array<string>, command string"
FILES = "path string, lang string, content_hash string, indexed_at string, git_rev string"
META = "ambiguous boolean, candidates int, rule string, heur string, field string, handlers int, rmw boolean, manual boolean, struct string, semantic string, semantic_by string, count int, window int"
NODES = "name string, qname string, kind string, file string, line_start int, line_end int, signature string, is_static boolean, module string, origin string, confidence double"
EDGES = f"src_qname string, src_kind string, dst_qname string, dst_kind string, kind string, file string, line int, origin string, confidence double, meta struct<{', '.join(f.replace(' ', ':', 1) for f in META.split(', '))}>"

META_FIELDS = [f.split()[0] for f in META.split(", ")]
META_TYPE = T.StructType([T.StructField(a, T.IntegerType() if b == "int" else T.BooleanType() if b == "boolean" else T.StringType()) for a, b in (x.split() for x in META.split(", "))])

# The accuracy of each origin.
CONFIDENCE = {"manual": 1.00, "ctags": 0.95, "clangd": 0.95, "cscope": 0.90, "cindex": 0.90, "treesitter": 0.85, "fnptr": 0.80, "clink": 0.93, "clangd-nobuild": 0.75, "callback": 0.70, "git": 0.50}
#: Confidence of semantic edges under a real compile database.
CLINK_REAL = 0.95
# The least confidence that is shown, and the limits of lists, of SQL rows and of handlers of a field.
MIN_CONFIDENCE = 0.7
LIST_LIMIT = 40
SQL_LIMIT = 200
FANOUT_LIMIT = 16

# What each layer that may be missing would add.
LAYERS = {"fnptr": "dispatch through tables of functions, and the manual table", "callback": "functions passed as arguments", "clink": "calls and writes attributed by a compiler front end", "clangd": "calls, types and signatures from a language server"}

# The kinds of edges that calls in the wide sense, questions and drawings take.
CALL_KINDS = ("calls", "fnptr", "callback")
QUERY_KINDS = ("calls", "fnptr", "callback", "expands")
VIEW_KINDS = ("calls", "fnptr", "callback", "expands", "reads", "writes", "includes", "co_changes")

EDGE_KEY = ("src_qname", "src_kind", "dst_qname", "dst_kind", "kind", "origin", "file", "line")


def confidence(origin: Column) -> Column:
    """The registry as a chain of literals; null for an unknown origin."""
    pairs = [F.lit(x) for kv in CONFIDENCE.items() for x in kv]
    return F.element_at(F.create_map(*pairs), origin)


def confidence_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CONFIDENCE.items()), "origin string, confidence double")


def meta(**fields: Column) -> Column:
    """A meta struct; fields that aren't given are null."""
    kinds = {f.name: f.dataType for f in META_TYPE}
    return F.struct(*(fields.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in META_FIELDS))


def meta_json(m: Column) -> Column:
    """The meta struct as JSON text with sorted keys; ``{}`` if nothing is set."""
    return F.to_json(F.struct(*(m[n].alias(n) for n in sorted(META_FIELDS))))


def meta_of_json(text: Column) -> Column:
    """The reverse; text that isn't JSON is an empty meta."""
    parsed = F.from_json(text, META_TYPE, {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, meta())


def check_version(found: int | str | None, wanted: int = SCHEMA_VERSION) -> None:
    if found is None or int(found) != wanted:
        raise ValueError(f"schema version {found} where {wanted} is needed")
