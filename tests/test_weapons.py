"""Weapon report on the fixture of 120 rows, 100 of them serious."""

import pytest

from skewlens.operators import weapons as wpn


@pytest.fixture(scope="module")
def cases(spark):
    weapons = ["firearm", "knife", "unknown", "none", "firearm", "blunt_object"] * 20
    serious = [True, True, True, False, True, True] * 20
    years = [2021] * 60 + [2022] * 30 + [2023] * 30
    regions = ["West", "South", "Northeast"] * 40
    rows = [(w, w, s, y, r) for w, s, y, r in zip(weapons, serious, years, regions)]
    return spark.createDataFrame(
        rows, "weapon_category string, weapon_raw string, severity_flag boolean, publication_year int, birth_region string"
    ).cache()


def test_report(cases):
    t = wpn.analyze_weapons(cases)
    totals = t["totals"].first()
    assert (totals.total_serious_crimes, totals.total_all_crimes, round(totals.serious_crime_percentage, 2)) == (100, 120, 83.33)
    counts = {r.weapon_category: (r.n, r.percentage_shown) for r in t["weapon_distribution"].collect()}
    assert counts == {"firearm": (40, 40.0), "knife": (20, 20.0), "unknown": (20, 20.0), "blunt_object": (20, 20.0)}
    ends = t["most_and_least"].first()
    assert (ends.most_common, ends.least_common) == ("firearm", "unknown")
    quality = t["data_quality"].first()
    assert (quality.unknown_weapons, quality.missing_weapon_data, quality.data_completeness_score) == (20, 0, 80.0)
    assert t["temporal_trends"].count() == 12 and t["regional_patterns"].where("n = 0").count() >= 0
    compare = {r.weapon_category: r for r in t["serious_vs_all_comparison"].collect()}
    assert set(compare) == {"firearm", "knife", "blunt_object", "none", "unknown", "other"}
    assert compare["none"].under_represented_in_serious and compare["firearm"].over_represented_in_serious
    assert (compare["other"].difference, compare["other"].over_represented_in_serious) == (0.0, False)
    assert t["summary"].first().summary == (
        "Analyzed 100 serious crimes out of 120 total records (83.3%). Most common weapon category in serious crimes: firearm. "
        "Unknown weapon information: 20.0% of serious crimes. Unknown weapon percentage decreased from 20.0% to 20.0% over time. "
        "Note: Analysis is aggregate-only and subject to reporting bias and missing data limitations."
    )


def test_no_serious_rows(cases):
    t = wpn.analyze_weapons(cases.where("not severity_flag"))
    assert t["totals"].first().error == "No serious crimes found in dataset"
    assert t["summary"].first().summary == "Weapons analysis could not be completed: No serious crimes found in dataset"
    assert t["unknown_weapon_trend"].count() == 0


def test_summary_without_a_second_year(cases):
    text = wpn.analyze_weapons(cases.where("publication_year = 2022"))["summary"].first().summary
    assert "over time" not in text and text.endswith("limitations.")


def test_unknown_and_missing_count_twice(spark):
    rows = [("unknown", None), ("unknown", ""), ("firearm", "gun"), ("unknown", "x")]
    q = wpn.weapon_quality(spark.createDataFrame(rows, "weapon_category string, weapon_raw string")).first()
    assert (q.unknown_weapons, q.missing_weapon_data, q.data_completeness_score) == (3, 2, -25.0)


def test_comparison_chart_is_a_union_of_labels(cases):
    chart = {r.weapon_category: r.serious_crimes_percentage for r in wpn.weapon_comparison_chart(cases).collect()}
    assert chart["none"] == 0.0 and set(chart) == {"firearm", "knife", "unknown", "none", "blunt_object"}
