"""Every registered query of the graph side against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tracegraph.plans.graph_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    found = duck.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == columns
    assert got == plain(tuple(r[at[c]] for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_registry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0
