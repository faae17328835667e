import pytest
from pyspark.sql import functions as F

from tracegraph import schema
from tracegraph.functions import text as X
from tracegraph.sources.files import clean_line


@pytest.mark.parametrize(
    ("line", "inside", "want"),
    [
        ("x = 1; // no", False, ("x = 1; ", False)),
        ("a /* b */ c", False, ("a  c", False)),
        ("a /* b", False, ("a ", True)),
        ("b */ c", True, (" c", False)),
        ("still", True, ("", True)),
        ('call("f(x)", \'y\')', False, ("call(\"\", '')", False)),
        (r'"a\"b" + c', False, ('"" + c', False)),
        ('"open', False, ('""', False)),
        ("'\\", False, ("''", False)),
        ('"/*" d', False, ('"" d', False)),
        ("/**/ // /* x", False, (" ", False)),
        ("", False, ("", False)),
    ],
)
def test_clean_line(line, inside, want):
    assert clean_line(line, inside) == want


def test_expressions(spark):
    rows = [("x++;", "x", True), ("x = x + 1;", "x", True), ("x = 1;", "x", False), ("if (a == b)", "a", False), ("y <<= x;", "x", True), ("ñx = ñ;", "ñ", False)]
    df = spark.createDataFrame(rows, "t string, n string, want boolean")
    assert df.where(X.is_changed_in_place(F.col("t"), F.col("n")) != F.col("want")).count() == 0
    rows = [("util.h", "a/util.h", True), ("a/util.h", "a/util.h", True), ("a/util.h", "b/a/util.h", True), ("a/util.h", "ba/util.h", False), ("util.h", "a/mutil.h", False)]
    df = spark.createDataFrame(rows, "s string, h string, want boolean")
    assert df.where(X.include_matches(F.col("s"), F.col("h")) != F.col("want")).count() == 0
    rows = [("static int f(void)", "", True), ("f(void)", "static int", True), ("int f", "static int x;", False), ("int f", "static s = {  ", False), ("nonstatic f", None, False), ("f", None, False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(X.is_static(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_tokens_of_lines(spark):
    df = spark.createDataFrame([("sort(a, cmp, &other); f(x)",), ("o->run (1) + p.go(2)",), (".open = &fopen, x->close=fclose;",)], "c string")
    got = [(r.a, r.d, [tuple(x) for x in r.r]) for r in df.select(X.arguments(F.col("c")).alias("a"), X.dispatches(F.col("c")).alias("d"), X.registrations(F.col("c")).alias("r")).collect()]
    assert got == [(["a", "cmp", "other", "x"], [], []), ([], ["run", "go"], []), (["fopen"], [], [("open", "fopen"), ("close", "fclose")])]


def test_sites_and_meta(spark):
    df = spark.createDataFrame([("a/b.c", 7), (None, None), ("x:y.c", 0)], "f string, n int")
    assert [tuple(r) for r in df.select(X.site_key(F.col("f"), F.col("n")).alias("k")).select("k", X.site_of(F.col("k")).alias("s")).collect()] == [("a/b.c:000000007", "a/b.c:7"), (":000000000", ":0"), ("x:y.c:000000000", "x:y.c:0")]
    m = schema.meta(rmw=F.lit(True), candidates=F.lit(2), ambiguous=F.lit(True))
    row = spark.range(1).select(schema.meta_json(m).alias("j"), schema.meta_json(schema.meta()).alias("e"), schema.meta_of_json(F.lit("not json")).alias("b")).first()
    assert (row.j, row.e, row.b.rmw) == ('{"ambiguous":true,"candidates":2,"rmw":true}', "{}", None)
    with pytest.raises(ValueError, match="version"):
        schema.check_version(99)
