"""Every registered query against its SQL at the smallest scale, and the shape of its plan."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, _bag
from registry.oracles import ORACLES
from registry.queries import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = _bag(df.columns, rows), _bag(columns, cursor.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "LocalTableScan [uid"):
        assert operator not in plan, operator


ONE_SCAN = {
    "geographic_test": "orders", "geographic_representation": "orders", "family_trends": "orders", "customer_trends": "orders",
    "case_persistence": "orders", "case_persistence_test": "orders", "weapon_summary": "orders", "year_by_weapon": "orders",
    "weapon_comparison": "orders", "state_proportions": "orders", "delay_by_part_type": "lineitem", "delay_anova": "lineitem",
    "category_test": "lineitem", "overview": "orders",
    "chart_weapon_comparison": "orders", "chart_summary_persistence": "orders", "distinct_labels": "orders",
    "document_quality": "documents", "validation_text_dates": "orders", "engineered_notices": "orders",
}


@pytest.mark.parametrize("name", sorted(ONE_SCAN))
def test_big_table_is_read_once(spark, sf, name):
    """Totals, labels and tests share the shuffle of the counts instead of reading the data again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from registry import queries

        df = queries.tidy(queries.QUERIES[name].__wrapped__(spark, sf))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = Counter(t for t in TABLES for line in plan.split("\n") if "FileScan" in line and f"/{t}.parquet" in line)
    assert scans[ONE_SCAN[name]] == 1, scans


def test_baseline_join_leaves_the_notices_in_place(spark, sf):
    from registry import queries

    plan = queries.QUERIES["engineered_notices"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [crime_family" not in plan
