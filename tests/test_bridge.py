"""The bridge queries on the smallest tables against DuckDB."""

import os

import pytest

from lodeweave.plans import bridge, verbs

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        path = f"{SMALL}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


QUERIES, SQL = bridge.queries() | verbs.queries(), bridge.oracle_sql() | verbs.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SMALL), con.sql(SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(str, want.select(", ".join(order)).fetchall()))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).columns == ["node", "depth"]
