"""Every registered query equals its DuckDB twin on sf0.001 (the driver's gate
runs the same comparison on sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from seriesforge.plans.fixtures import DRIVER_TABLES
from seriesforge.plans.registry import QUERIES
from tools_check import digest, norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(set(E.oracle_sql()) & set(QUERIES)))
def test_query_matches_oracle(spark, duck, key):
    s = E.queries()[key](spark, SF).toPandas()
    o = duck.execute(E.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert digest(norm(s)) == digest(norm(o))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "data" in df.columns


def test_every_query_has_an_oracle():
    from seriesforge.plans.registry import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE)
