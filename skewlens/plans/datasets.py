"""One table per chart. Input: engineered rows, or a case cube with ``weight='n'``.

:func:`chart_tables` has them all from one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import counts as C
from ..operators import persistence as P
from ..operators import representation as R
from ..operators import weapons as W
from ..operators.features import serious_only
from ..operators.joins import compare_shares
from ..session import stored


def category_distribution(df: DataFrame, weight: str | None = None) -> DataFrame:
    return C.distribution(df, "crime_family", weight, over="known")


def geographic_distribution(df: DataFrame, weight: str | None = None, top: int = 15) -> DataFrame:
    """The most frequent states."""
    return C.ranked(C.label_counts(df, "birth_state", weight), "birth_state", top)


def top_states_with_share(df: DataFrame, weight: str | None = None, top: int = 8) -> DataFrame:
    """The most frequent states with their percentage of all rows."""
    return C.ranked(C.distribution(df, "birth_state", weight), "birth_state", top)


def category_proportions(wanted: DataFrame, baseline: DataFrame, family: str = "crime_family") -> DataFrame:
    """Notice share and baseline share per notice family, 0 where the baseline has none."""
    return compare_shares(wanted.select(family, "proportion"), baseline, family).select(
        family, F.col("proportion").alias("wanted_proportion"), F.col("_other").alias("baseline_proportion")
    )


def persistence_box(df: DataFrame) -> DataFrame:
    return P.box_stats(df)


def temporal_series(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Zero-filled counts per year and family."""
    return C.two_way(df, "publication_year", "crime_family", weight)


def region_by_family(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Share of each region within its family."""
    return C.two_way(df, "birth_region", "crime_family", weight, normalize="column")


def representation_ratios(table: DataFrame, over: float = 1.2, under: float = 0.8) -> DataFrame:
    """Ratios in ascending order with the reference lines and colour label."""
    return table.select(
        "birth_state", "representation_ratio", "observed_cases", "expected_cases", R.bias_label().alias("label"),
        F.lit(1.0).alias("parity"), F.lit(over).alias("upper_threshold"), F.lit(under).alias("lower_threshold"),
    ).orderBy("representation_ratio", "birth_state")


def first_families(df: DataFrame, weight: str | None = None, top: int = 5, order: str = "count") -> DataFrame:
    """The families shown in the summary box plot: most frequent first, or in order of appearance (rows with a position)."""
    counted = (C.appearance_counts if order == "appearance" else C.label_counts)(df, "crime_family", weight)
    return C.ranked(counted, "crime_family", top, order)


def summary_persistence(df: DataFrame, top: int = 5, order: str = "count") -> DataFrame:
    """The box plot of the summary page: case ages of the :func:`first_families`."""
    shown = first_families(df, None, top, order).select("crime_family")
    return P.box_stats(df).join(shown, "crime_family", "left_semi")


def summary_dashboard(df: DataFrame, cube: DataFrame) -> dict[str, DataFrame]:
    """Four data sets of the summary page: counted days for the box plot, a cube for the rest."""
    days = P.value_counts(df, "crime_family", "case_age_days")
    shown = first_families(days, "n")
    return {
        "states": geographic_distribution(cube, "n", top=10),
        "categories": category_distribution(cube, "n"),
        "years": C.row_counts(cube, "publication_year", "n"),
        "persistence": P.box_from_counts(days, "crime_family", "case_age_days").join(shown.select("crime_family"), "crime_family", "left_semi"),
    }


def weapon_distribution(df: DataFrame, serious: bool = True, weight: str | None = None) -> DataFrame:
    return W.weapon_distribution(serious_only(df) if serious else df, weight)


def weapon_yearly(df: DataFrame, serious: bool = True, weight: str | None = None) -> DataFrame:
    return W.weapon_shares(serious_only(df) if serious else df, "publication_year", weight)


def unknown_weapons_by_year(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Percentage of serious rows of unknown weapon per year."""
    return C.label_share_by(serious_only(df), "publication_year", "weapon_category", "unknown", weight)


def weapon_by_region(df: DataFrame, weight: str | None = None) -> DataFrame:
    return W.weapon_shares(serious_only(df), "birth_region", weight)


def geographic_table(table: DataFrame) -> DataFrame:
    """The representation table with its row class."""
    return table.withColumn("highlight", R.bias_label())


_YEAR, _REGION, _FAMILY, _WEAPON = "publication_year", "birth_region", "crime_family", "weapon_category"
# Key sets of the charts below, in the order of their keys; the shorter ones are the totals.
CHART_SETS = (
    (_YEAR, _FAMILY), (_REGION, _FAMILY), (_YEAR, _WEAPON, "severity_flag"), (_REGION, _WEAPON, "severity_flag"),
    ("birth_state",), (_YEAR,), (_REGION,), (_FAMILY,), (_WEAPON, "severity_flag"), (),
)


def chart_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    """All counts that the two-way charts, one-way charts and totals need, from one aggregate, stored."""
    return stored(C.roll_up(df, CHART_SETS, weight), "chart_counts")


def chart_tables(df: DataFrame, weight: str | None = None) -> dict[str, DataFrame]:
    """The tables of this module that are counts, and the totals, all from one pass over ``df``.

    The same functions make them from the stored counts as from rows, so they are equal to
    the tables made one by one; what they read is as small as the tables.
    """
    counted = chart_counts(df, weight)

    def level(*keys):
        return counted.where(F.col("level") == C.level_name(keys)).drop("level")

    return {
        "temporal_series": temporal_series(level(_YEAR, _FAMILY), "n"),
        "region_by_family": region_by_family(level(_REGION, _FAMILY), "n"),
        "weapon_yearly": weapon_yearly(level(_YEAR, _WEAPON, "severity_flag"), True, "n"),
        "weapon_by_region": weapon_by_region(level(_REGION, _WEAPON, "severity_flag"), "n"),
        "unknown_weapons_by_year": unknown_weapons_by_year(level(_YEAR, _WEAPON, "severity_flag"), "n"),
        "category_distribution": category_distribution(level(_FAMILY), "n"),
        "weapon_distribution": weapon_distribution(level(_WEAPON, "severity_flag"), True, "n"),
        "top_states_with_share": top_states_with_share(level("birth_state"), "n"),
        "years": C.row_counts(level(_YEAR), _YEAR, "n"),
        "regions": C.row_counts(level(_REGION), _REGION, "n"),
        "families": C.row_counts(level(_FAMILY), _FAMILY, "n"),
        "total": level().select("n"),
    }
