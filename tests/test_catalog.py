"""Every registered query against its DuckDB counterpart, on the smallest tables."""

import duckdb
import pytest

from sparktl.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(None if x != x else x for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(rows(ours), key=key) == sorted(rows(theirs), key=key)
