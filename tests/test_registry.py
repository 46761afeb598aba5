"""Every registered query of the engine against its SQL in DuckDB, and a check of plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from oplake import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    order = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.ORACLES) >= 30


def test_plans(spark):
    """Bounds reach the scan, values are not read where they are not asked for, and only the newest row of a key is shuffled."""
    from oplake.operators import visibility as vis

    path = f"{SF}/events.parquet"
    raw = spark.read.parquet(path).selectExpr("event_type AS user_key", "event_id AS sequence", "1 AS kind", "props AS value")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scan = plan(vis.visible(vis.between(raw.selectExpr("cast(user_key AS binary) AS user_key", "sequence", "kind", "value"), b"a", b"m"), 50))
    assert "PushedFilters" in scan and "LessThanOrEqual(event_id,50)" in scan
    keys = plan(vis.visible(raw).select("user_key"))
    assert "props" not in keys.split("ReadSchema")[1] and keys.count("WindowGroupLimit") == 2 and keys.count("Exchange") == 1
