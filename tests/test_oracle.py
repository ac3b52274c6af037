"""Every query of the core with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import glob
import os

import pytest

from lodegraph.plans import contract_queries, core_queries, graph_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
QUERIES = core_queries.queries() | graph_queries.queries()
SQL = core_queries.oracle_sql() | graph_queries.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    result = duck.execute(SQL[name])
    names = [x[0] for x in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    theirs = sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())
    assert sorted(names) == columns
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns
    df.collect()
