"""Read-only SQL over the tables of a graph.

The text is parsed, and only what is listed here may stand in the plan, in its expressions and in those of its subqueries: plan nodes
of queries, functions by name, and relations that are tables of the graph or named by the query itself. So no path, no other catalog and no
function that calls into the JVM can be reached, however it is written. The dialect is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .. import schema

_PLANS = frozenset(
    "Project UnresolvedWith Aggregate Sort GlobalLimit LocalLimit Distinct Union Except Intersect Filter UnresolvedHaving SubqueryAlias "
    "UnresolvedInlineTable LocalRelation WithWindowDefinition Offset Tail UnresolvedRelation Join UnresolvedSubqueryColumnAliases Pivot Unpivot Generate "
    "LateralJoin Sample ResolvedInlineTable OneRowRelation UnresolvedTableValuedFunction Window".split()
)
#: What the parser leaves unresolved in expressions; anything else of that package is refused.
_UNRESOLVED = frozenset("UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedFunction UnresolvedAlias UnresolvedExtractValue UnresolvedOrdinal UnresolvedGenerator MultiAlias".split())
_FUNCTIONS = frozenset(
    "count sum avg mean min max min_by max_by median mode stddev variance corr percentile percentile_approx approx_count_distinct any_value first first_value last last_value "
    "collect_list collect_set array_agg listagg string_agg bool_and bool_or every some any count_if grouping grouping_id bit_and bit_or bit_xor "
    "row_number rank dense_rank percent_rank cume_dist ntile lag lead nth_value "
    "abs ceil ceiling floor round bround sign sqrt cbrt pow power exp ln log log2 log10 mod pmod div greatest least coalesce nvl nvl2 ifnull nullif nullifzero zeroifnull if isnull isnotnull isnan "
    "length char_length character_length octet_length lower lcase upper ucase initcap trim ltrim rtrim btrim lpad rpad left right substr substring substring_index replace translate repeat reverse "
    "concat concat_ws split split_part instr locate position contains startswith endswith like rlike regexp regexp_like regexp_extract regexp_extract_all regexp_replace regexp_count regexp_substr format_string printf "
    "ascii chr hex unhex md5 sha1 sha2 crc32 xxhash64 hash base64 unbase64 "
    "array array_contains array_distinct array_join array_max array_min array_position array_remove array_sort sort_array array_union array_intersect array_except arrays_overlap arrays_zip "
    "size cardinality element_at get slice sequence flatten transform filter exists forall aggregate reduce zip_with map map_keys map_values map_entries map_from_arrays map_from_entries struct named_struct "
    "get_json_object from_json to_json json_array_length cast string int bigint double float boolean date timestamp typeof "
    "to_date to_timestamp date_format date_trunc trunc year quarter month day dayofmonth dayofweek hour minute second date_add date_sub datediff months_between add_months extract date_part unix_timestamp from_unixtime".split()
)
_TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())


class Refused(ValueError):
    """Not a read-only query over the graph's tables."""


def _all(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _class(node) -> tuple[str, str]:
    package, _, name = node.getClass().getName().rpartition(".")
    return package, name.rstrip("$")


def parse(spark: SparkSession, text: str, tables: Iterable[str]) -> None:
    """Raises ``Refused`` unless ``text`` is a query over ``tables`` by the lists above."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    plans, expressions, known, asked = [plan], [], {t.lower() for t in tables}, []
    while plans or expressions:
        if plans:
            node = plans.pop()
            _, name = _class(node)
            if name not in _PLANS:
                raise Refused(f"only queries are allowed, not {name}")
            if name == "UnresolvedRelation":
                asked.append([str(p) for p in _all(node.multipartIdentifier())])
            elif name == "UnresolvedTableValuedFunction":
                _check([str(p) for p in _all(node.name())], _TABLE_FUNCTIONS)
            elif name == "UnresolvedWith":
                # names of a WITH hold in the whole text; one that hides no table can only be itself
                known |= {str(r._1()).lower() for r in _all(node.cteRelations())}
                plans += [r._2() for r in _all(node.cteRelations())]
            plans += _all(node.children())
            expressions += _all(node.expressions())
        else:
            node = expressions.pop()
            package, name = _class(node)
            if package.endswith(".analysis") and name not in _UNRESOLVED:
                raise Refused(f"{name} isn't allowed")
            if name == "UnresolvedFunction":
                _check([str(p) for p in _all(node.nameParts())], _FUNCTIONS | _TABLE_FUNCTIONS)
            elif name == "UnresolvedGenerator":
                _check([str(node.name().funcName())], _TABLE_FUNCTIONS)
            elif name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                plans.append(node.plan())
            expressions += _all(node.children())
    for parts in asked:
        if len(parts) != 1 or parts[0].lower() not in known:
            raise Refused(f"{'.'.join(parts)} is no table of the graph")


def _check(parts: list[str], allowed: frozenset[str]) -> None:
    if len(parts) != 1 or parts[0].lower() not in allowed:
        raise Refused(f"the function {'.'.join(parts)} isn't allowed")


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    parse(spark, text, tables)
    register(tables)
    return spark.sql(text)


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame], limit: int = schema.SQL_LIMIT) -> tuple[Iterator[tuple], bool]:
    """(rows, whether there are more). A limit of 0 or less gives all, as an iterator that holds one partition at a time."""
    df = query(spark, text, tables)
    if limit <= 0:
        return map(tuple, df.toLocalIterator()), False
    rows = [tuple(r) for r in df.limit(limit + 1).collect()]
    return iter(rows[:limit]), len(rows) > limit
