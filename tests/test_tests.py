"""Representation, chi-square, trends, persistence, ANOVA: against brute force on small and skewed data."""

import math
import random
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewlens.operators import category as cat
from skewlens.operators import persistence as per
from skewlens.operators import representation as rep
from skewlens.operators import results as res
from skewlens.operators import trends as trd


@pytest.fixture(scope="module")
def geo_input(spark):
    population = {"CA": 39.5, "TX": 29.1, "NY": 19.8, "FL": 21.5}
    rows = [(s, population[s]) for s in ["CA", "TX", "CA", "NY", "FL"] * 20]
    return spark.createDataFrame(rows, "birth_state string, birth_state_population double")


def test_representation(geo_input):
    got = {r.birth_state: r for r in rep.representation(geo_input).collect()}
    assert {s: r.observed_cases for s, r in got.items()} == {"CA": 40, "TX": 20, "NY": 20, "FL": 20}
    assert math.isclose(got["CA"].expected_cases, 39.5 / 109.9 * 100)
    assert math.isclose(sum(r.expected_cases for r in got.values()), 100)
    test = rep.analyze_geography(geo_input)["test"].first()
    want = sum((r.observed_cases - r.expected_cases) ** 2 / r.expected_cases for r in got.values())
    assert math.isclose(test.chi_square_statistic, want, rel_tol=1e-9)
    assert (test.degrees_of_freedom, test.expected_rescaled, test.sample_size, test.status) == (3, False, 100, "ok")
    assert test.interpretation == (
        f"No significant geographic bias detected (p={test.p_value:.4f}). Representation appears proportional to population."
    )


def test_null_and_unknown_states(spark, geo_input):
    extra = spark.createDataFrame([(None, None)] * 30 + [("UNKNOWN", None)] * 50, geo_input.schema)
    both = geo_input.unionByName(extra)
    table = {r.birth_state: r for r in rep.representation(both).collect()}
    assert set(table) == {"CA", "TX", "NY", "FL"}
    assert math.isclose(sum(r.expected_cases for r in table.values()), 130)
    test = rep.analyze_geography(both)["test"].first()
    o = {s: r.observed_cases for s, r in table.items()}
    e = {s: r.expected_cases * 100 / 130 for s, r in table.items()}
    assert test.expected_rescaled and test.sample_size == 130
    assert math.isclose(test.chi_square_statistic, sum((o[s] - e[s]) ** 2 / e[s] for s in o), rel_tol=1e-9)


def test_too_few_rows_or_units(spark, geo_input):
    few = rep.analyze_geography(geo_input.limit(40))
    assert few["representation"].count() == 0
    row = few["test"].first()
    assert (row.status, row.error, row.p_value) == ("insufficient_data", "Insufficient data for geographic analysis", None)
    one = rep.analyze_geography(geo_input.where("birth_state = 'CA'").union(geo_input.where("birth_state = 'CA'")))["test"].first()
    assert (one.status, one.chi_square_statistic, one.interpretation) == ("too_few_units", None, None)
    empty = rep.analyze_geography(geo_input.where("birth_state = 'ZZ'"))["test"].first()
    assert (empty.sample_size, empty.status) == (0, "insufficient_data")


def test_significant_sentence_lists_units_by_cases(spark):
    rows = [("CA", 1.0)] * 200 + [("TX", 1.0)] * 150 + [("NY", 1.0)] * 5 + [("FL", 1.0)] * 20
    df = spark.createDataFrame(rows, "birth_state string, birth_state_population double")
    text = rep.analyze_geography(df)["test"].first().interpretation
    assert text == (
        "Significant geographic bias detected (p=0.0000). Over-represented states: CA, TX. Under-represented states: FL, NY."
    )


def test_chi_square_is_scaled(spark):
    df = spark.createDataFrame([(60, 30.0), (40, 30.0)], "observed_cases long, expected_cases double")
    row = rep.chi_square(df).first()
    assert math.isclose(row.chi_square_statistic, 4.0) and row.expected_rescaled
    big = spark.createDataFrame([(10**12 + 1000, 1e12), (10**12 - 1000, 1e12)], "observed_cases long, expected_cases double")
    assert math.isclose(rep.chi_square(big).first().chi_square_statistic, 2e-6, rel_tol=1e-6)


def test_categories(spark):
    notices = spark.createDataFrame([("Violent",)] * 60 + [("Other",)] * 30 + [("Terrorism",)] * 10, "crime_family string")
    base = spark.createDataFrame(
        [("violent_crime", 300), ("property_crime", 500), ("other", 100), ("cyber_crime", 100)], "crime_family string, count long")
    a = cat.analyze_categories(notices, base)
    ratio = {r.crime_family: (r.representation_ratio, r.over_represented, r.under_represented) for r in a["category_comparison"].collect()}
    assert ratio == {"Violent": (0.6 / 0.3, True, False), "Other": (0.3 / 0.6, False, False)}
    test, f = a["test"].first(), 90 / 900
    assert math.isclose(test.chi_square_statistic, (60 - 300 * f) ** 2 / (300 * f) + (30 - 600 * f) ** 2 / (600 * f))
    apart = cat.analyze_categories(notices, base, crosswalk=None)
    assert apart["category_comparison"].count() == 0
    assert (apart["test"].first().p_value, apart["test"].first().status) == (None, "too_few_units")
    assert set(cat.analyze_categories(notices)) == {"wanted_distribution"}


def _pearson(ys, ns):
    return None if len(set(ns)) == 1 else float(np.corrcoef(ys, ns)[0, 1])


def test_trend_against_brute_force(spark):
    random.seed(5)
    rows = [(random.choice("abcdef"), random.choice([2015, 2017, 2018, 2020, 2021])) for _ in range(300)]
    rows += [("hot", 2018)] * 150 + [("rare", 2021)] + [("flat", y) for y in (2015, 2017, 2018, 2020, 2021)] + [(None, 2015), ("a", None)]
    got = {r.k: r for r in trd.trend(spark.createDataFrame(rows, "k string, y int"), "k", "y").collect()}
    years = [2015, 2017, 2018, 2020, 2021]
    assert set(got) == {k for k, _ in rows if k}
    for k, r in got.items():
        ns = [sum(1 for a, b in rows if a == k and b == y) for y in years]
        want = _pearson(years, ns)
        assert r.correlation_with_time == pytest.approx(want, abs=1e-12) if want is not None else r.correlation_with_time is None
        assert r.percent_change == pytest.approx((ns[-1] - ns[0]) / ns[0] * 100 if ns[0] else 0.0)
        assert (r.total_cases, r.trend_direction) == (sum(ns), "increasing" if (want or 0) > 1e-12 else "decreasing")
    assert got["flat"].trend_p_value is None and not got["flat"].significant_trend


def test_trend_needs_three_periods(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "k string, y int")
    assert trd.trend(df, "k", "y").count() == 0
    line = spark.createDataFrame([("a", y) for y in (1, 2, 2, 3, 3, 3)], "k string, y int")
    row = trd.trend(line, "k", "y").first()
    assert (row.correlation_with_time, row.trend_p_value, row.significant_trend) == (1.0, 0.0, True)


def _skewed(spark, kind):
    """One category holds a third of all rows; one has a single row, one only nulls."""
    random.seed(7)
    rows = [("hot", random.randint(-50, 400)) for _ in range(2000)]
    rows += [(random.choice("abcd"), random.randint(0, 3000)) for _ in range(4000)]
    rows += [("one", 5)] + [("void", None)] * 3 + [("same", 7)] * 20 + [(None, 1)] * 4
    if kind == "double":
        rows = [(k, None if v is None else v + random.random() ** 5 * 1e4) for k, v in rows]
    return rows, spark.createDataFrame(rows, f"crime_family string, case_age_days {kind}")


@pytest.mark.parametrize("kind", ["int", "double"])
def test_persistence_against_brute_force(spark, kind):
    rows, df = _skewed(spark, kind)
    got = {r.crime_family: r for r in per.persistence(df, whole_days=kind == "int").collect()}
    box = {r.crime_family: r for r in per.box_stats(df, whole_days=kind == "int").collect()}
    assert set(got) == {"hot", "a", "b", "c", "d", "one", "void", "same"}
    for k, r in got.items():
        v = [x for g, x in rows if g == k and x is not None]
        assert r["count"] == len(v)
        if not v:
            assert r["mean"] is None and r["median"] is None and r["std"] is None
            continue
        assert r["mean"] == pytest.approx(mean(v)) and r["min"] == min(v) and r["max"] == max(v)
        assert r["median"] == pytest.approx(np.median(v))
        assert r["std"] is None if len(v) == 1 else r["std"] == pytest.approx(np.std(v, ddof=1), abs=1e-9)
        assert [box[k][n] for n in ("min", "q1", "median", "q3", "max")] == pytest.approx(list(np.percentile(v, [0, 25, 50, 75, 100])))


def test_any_quantiles_equal_those_of_days(spark):
    rows, df = _skewed(spark, "int")
    probabilities = (0.0, 0.1, 0.333, 0.5, 0.99, 1.0)
    counted = per.value_counts(df, "crime_family", "case_age_days")
    a = {r.crime_family: r.quantiles for r in per.day_quantiles(counted, "crime_family", "case_age_days", probabilities).collect()}
    b = {r.crime_family: r.quantiles for r in per.quantiles(df, "crime_family", "case_age_days", probabilities).collect()}
    for k in b:
        assert a[k] == pytest.approx(b[k]), k
    assert {k for k, v in a.items() if v is not None} == set(b)


def test_quantiles_of_a_heavy_tail_in_a_hot_category(spark):
    """Far outliers, many ties, and one category that holds most rows."""
    random.seed(3)
    values = {
        "hot": [random.paretovariate(0.3) for _ in range(30_000)] + [1e300, -1e9, 5e6] + [1.25] * 6000,
        "ties": [4.0] * 9000 + [5.0] * 9001, "few": [2.0, 1.0, 10.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "crime_family string, case_age_days double").repartition(5)
    probabilities = (0.0, 0.0001, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    table = per.quantiles(df, "crime_family", "case_age_days", probabilities)
    for r in table.collect():
        assert r.quantiles == pytest.approx(list(np.percentile(values[r.crime_family], [100 * p for p in probabilities])), rel=1e-9), r.crime_family
    assert table._jdf.queryExecution().sparkPlan().toString().count("Join") == 1


def test_rank_selection_keeps_every_task_bounded(spark, monkeypatch):
    """One hot category of continuous values that fills few cells: several rounds, and no task that orders its rows."""
    n, small = 200_000, 50
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("k"),
        (1000 + F.rand(5) * 1e-6 + F.when(F.col("id") % 1000 == 0, -1e6).otherwise(0)).alias("x"))
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/hot-values")
    df = spark.read.parquet(path)
    probabilities, tables, store = (0.0, 0.0004, 0.25, 0.5, 0.75, 1.0), [], per.stored
    monkeypatch.setattr(per, "stored", lambda t, name: tables.append((name, store(t, name))) or tables[-1][1])
    table = per.quantiles(df, "k", "x", probabilities, small=small)
    values = {}
    for k, x in df.collect():
        values.setdefault(k, []).append(x)
    got = {r.k: r.quantiles for r in table.collect()}
    assert got == {k: pytest.approx(list(np.percentile(v, [100 * p for p in probabilities])), rel=1e-14) for k, v in values.items()}
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "percentile" not in plan
    # each round narrows the cells; what meets in one place for the last step is one cell, of at most `small` rows
    most = [t.where("_lo < _hi").agg(F.max("n")).first()[0] for name, t in tables if name == "cells"]
    assert len(most) >= 2 and most == sorted(most, reverse=True) and most[0] > n / 2 and most[-1] <= small


def test_rank_selection_ends_in_one_round_where_rows_are_spread_evenly(spark, monkeypatch):
    """4,096 cells would leave 13 of these rows in each, 3 too many, and one more round."""
    n, small = 50_000, 10
    df = spark.range(n).select(F.lit("k").alias("k"), (1000 + F.col("id") * 1e-11).alias("x"))
    names, store = [], per.stored
    monkeypatch.setattr(per, "stored", lambda t, name: names.append(name) or store(t, name))
    got = per.quantiles(df, "k", "x", (0.1, 0.5), small=small).first().quantiles
    assert got == pytest.approx([1000 + 0.1 * (n - 1) * 1e-11, 1000 + 0.5 * (n - 1) * 1e-11], rel=1e-14)
    assert names.count("cells") == 2  # of magnitude, and those cut from one of them


def test_rank_selection_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    values = {"a": [0.0, -0.0, 1e-310, -1e-310, 5e-324, -5e-324], "b": [-inf, -1e308, 1e308, inf], "c": [1.0, nan], "d": [3.0], "e": [2.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("f", None), (None, 1.0)], "k string, x double")
    got = {r.k: r.quantiles for r in per.quantiles(df, "k", "x", (0.0, 0.2, 1.0), small=1).collect()}
    assert got["a"] == [-1e-310, -5e-324, 1e-310] and got["b"][0] == -inf and got["b"][2] == inf
    assert got["c"][0] == 1.0 and math.isnan(got["c"][2]) and got["d"] == [3.0] * 3 and got["e"] == [2.0] * 3
    assert set(got) == set("abcde")
    assert per.quantiles(df.limit(0), "k", "x").collect() == []


def test_statistics_of_any_values_read_them_once(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 2.5), ("b", None)] * 3, "k string, x double")
    tables = per.analyze_persistence(df, "k", "x")
    row = {r.k: r for r in tables["persistence_by_category"].collect()}["a"]
    assert (row["count"], row["mean"], row["median"], row["min"], row["max"]) == (6, 2.0, 2.0, 1.5, 2.5)
    for table in tables.values():
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and ", x#" not in plan.split("Aggregate [")[-1].split("]")[0]  # grouped by category alone


def test_default_way_of_an_unknown_column_is_the_general_one(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", 2.5)], "k string, x double")
    assert per.box_stats(df, "k", "x").first().asDict() == {"k": "a", "min": 1.5, "q1": 1.75, "median": 2.0, "q3": 2.25, "max": 2.5}
    assert "percentile(" not in per.persistence(df, "k", "x")._jdf.queryExecution().analyzed().toString()


def test_approximate_box_is_close(spark):
    _, df = _skewed(spark, "int")
    exact = {r.crime_family: r.median for r in per.box_stats(df).collect()}
    rough = {r.crime_family: r.median for r in per.approximate_box_stats(df).collect()}
    assert all(abs(exact[k] - rough[k]) <= 3 for k in "abcd")


def test_anova(spark):
    rows, df = _skewed(spark, "int")
    row = per.anova(df.where("crime_family <> 'void'")).first()
    groups = {}
    for k, v in rows:
        if k and v is not None:
            groups.setdefault(k, []).append(v)
    groups = {k: v for k, v in groups.items() if len(v) > 5}
    n, grand = sum(map(len, groups.values())), np.concatenate(list(groups.values())).mean()
    between = sum(len(v) * (np.mean(v) - grand) ** 2 for v in groups.values()) / (len(groups) - 1)
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / (n - len(groups))
    assert row.anova_f_statistic == pytest.approx(between / within)
    assert (row.groups, row.sample_size, row.df_between, row.df_within) == (6, n, 5, n - 6)
    from_counts = per.analyze_persistence(df)["test"].first()
    assert from_counts.anova_f_statistic == pytest.approx(between / within)
    assert from_counts.interpretation.startswith("Significant differences in case persistence detected (p=0.0000). '")


def test_anova_edges(spark):
    schema = "crime_family string, case_age_days int"
    one = per.anova(spark.createDataFrame([("a", i) for i in range(9)], schema)).first()
    assert (one.status, one.note, one.anova_p_value) == ("too_few_groups", "Insufficient data for statistical comparison", None)
    apart = per.anova(spark.createDataFrame([("a", 1)] * 7 + [("b", 2)] * 7, schema)).first()
    assert (apart.anova_f_statistic, apart.anova_p_value, apart.significant_differences) == (math.inf, 0.0, True)
    equal = per.anova(spark.createDataFrame([("a", 1)] * 7 + [("b", 1)] * 7, schema)).first()
    assert (equal.anova_f_statistic, equal.significant_differences) == (None, False)
    void = per.anova(spark.createDataFrame([("a", 1), ("a", 2)] * 4 + [("b", None)] * 7, schema)).first()
    assert (void.status, void.anova_f_statistic) == ("empty_group", None)
    nulls_count = per.anova(spark.createDataFrame([("a", 1), ("a", 2)] * 4 + [("b", None)] * 4 + [("b", 3), ("b", 5)], schema)).first()
    assert (nulls_count.groups, nulls_count.sample_size) == (2, 10)


def test_result_rows_and_findings(spark, geo_input):
    geo = rep.analyze_geography(geo_input)["test"].withColumn("significant_bias", F.lit(True))
    none = rep.analyze_geography(geo_input.limit(10))["test"]
    table = res.result_table(geographic=geo)
    assert table.count() == 1 and res.result_table(geographic=none).count() == 0
    moving = spark.createDataFrame([(True,), (False,)], "significant_trend boolean")
    assert [r.finding for r in res.findings(table, moving).collect()] == [
        "Geographic bias detected in state representation", "Significant temporal trends identified"]
