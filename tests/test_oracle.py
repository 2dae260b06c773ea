"""Every registered query against its DuckDB twin on the sf0.001 tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql
from docweave.plans.oracle import ORACLE
from docweave.plans.registry import QUERIES
from conftest import SMOKE
from tools.oracle_check import TABLES, compare


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, SMOKE)
    assert res["cols"], res
    assert res["spark_rows"] == res["duck_rows"], res
    assert res["values"], res


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["request_id", "name", "keywords", "status", "n_fragments", "context"]
    assert df.count() > 0
