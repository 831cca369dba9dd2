"""Every registered query with SQL gives the rows of that SQL in another engine."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import check_queries  # noqa: E402

from blankweave.plans.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for name in check_queries.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, data_dir, duck, name):
    got = QUERIES[name](spark, data_dir).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check_queries.canonical(got) == check_queries.canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0
