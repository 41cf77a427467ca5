"""Audit states: one pass, merging, batches counted once."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from registry import tables as R
from skewlens import shared_folder
from skewlens.operators.counts import case_cube
from skewlens.operators.features import engineer_features
from skewlens.operators.joins import yearly_baseline
from skewlens.operators.persistence import value_counts
from skewlens.operators.state import ages_of, audit_state, cube_of, merge_states
from skewlens.plans.audit import AuditLog, AuditTables, analyze_state


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_state_has_the_cube_and_the_ages(spark, sf):
    f = R.features(spark, sf).withColumn("case_age_days", F.when(F.col("uid") > "N5", F.col("case_age_days")))
    f = f.withColumn("crime_family", F.when(F.col("uid") < "N9", F.col("crime_family")))
    state = audit_state(f)
    assert rows(cube_of(state)) == rows(case_cube(f))
    assert rows(ages_of(state)) == rows(value_counts(f, "crime_family", "case_age_days"))
    plan = state._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("FileScan") == 2  # orders and customers, once each


def test_states_of_parts_merge_to_the_state_of_the_whole(spark, sf):
    notices, baseline = R.notices(spark, sf), yearly_baseline(R.baseline(spark, sf))
    part = F.pmod(F.hash("uid"), F.lit(2))
    whole = audit_state(engineer_features(notices)).cache()
    halves = [audit_state(engineer_features(notices.where(part == i))).cache() for i in (0, 1)]
    merged = merge_states(*halves)
    assert rows(merged) == rows(merge_states(*reversed(halves))) == rows(whole)
    assert rows(merge_states(merged, halves[0].limit(0))) == rows(whole)
    a, b = analyze_state(whole, baseline, None), analyze_state(merged, baseline, None)
    assert list(a) == list(b) and len(a) > 25
    for name in a:
        assert rows(a[name]) == rows(b[name]), name


def test_batches_are_counted_once(spark, sf):
    notices = R.notices(spark, sf).cache()
    log = AuditLog(spark, shared_folder(spark))
    with pytest.raises(ValueError, match="no batch"):
        log.state()
    parts = [notices.where(F.pmod(F.hash("uid"), F.lit(3)) == i) for i in range(3)]
    with ThreadPoolExecutor(4) as pool:  # two writers bring the same batch
        added = list(pool.map(lambda i: AuditLog(spark, log.root).add(f"b{i}", parts[i]), (0, 1, 1, 2)))
    assert sorted(log.batches()) == ["b0", "b1", "b2"] and added.count(True) == 3 and added[0] and added[3]
    assert not log.add("b2", notices)
    assert rows(log.state()) == rows(audit_state(engineer_features(notices)))
    tables = log.tables(R.baseline(spark, sf))
    assert tables["report.overview"].first().total_cases == notices.count()


def test_tables_are_planned_when_they_are_asked_for(spark, sf):
    state = audit_state(R.features(spark, sf))
    tables = AuditTables(cube_of(state), ages_of(state))
    assert tables._planned == {}
    tables["weapons.totals"]
    assert set(tables._planned) == {"weapons"}
    for name in ("nothing.test", "weapons.nothing", "weapons"):
        with pytest.raises(KeyError):
            tables[name]
