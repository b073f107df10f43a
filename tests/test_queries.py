import glob
import os

import duckdb
import pytest

import __spark_entry__
from copperleaf.plans import catalog


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_against_sql(spark, sf, duck, name):
    df, want = catalog.QUERIES[name](spark, sf), duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = df.select(*(f"`{c}`" for c in want.columns)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["status", "n_lines", "revenue"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["comp3_decode", "zoned_overpunch", "ebcdic_text_cp037", "flagship", "fixed_scan_customer"])
def test_plans_have_no_python(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
