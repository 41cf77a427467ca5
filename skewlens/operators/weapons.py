"""Weapon patterns among serious cases, aggregate only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.numbers import fixed, percent, rows, rows_where, shown
from .counts import cells, distribution, extremes, flag_missing_text, labelled, text_missing, two_way
from .features import serious_only
from .joins import align_union, labels_frame


def weapon_totals(df: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: serious rows, all rows, percentage, and an error text when none is serious."""
    serious = rows_where(F.col("severity_flag"), weight)
    return df.agg(
        serious.alias("total_serious_crimes"),
        rows(weight).alias("total_all_crimes"),
        percent(serious, rows(weight)).alias("serious_crime_percentage"),
    ).withColumn("error", F.when(F.col("total_serious_crimes") == 0, F.lit(K.ERROR_WEAPONS)))


def weapon_distribution(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Weapon, rows and percentage of all given rows, with a display copy of the percentage."""
    return distribution(df, "weapon_category", weight).withColumn("percentage_shown", shown(F.col("percentage")))


def weapon_quality(df: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: unknown and missing weapon rows with percentages and the completeness score.

    A row that is both unknown and missing lowers the score twice. Counted rows
    bring the flag ``weapon_text_missing`` in place of the text.
    """
    total = rows(weight)
    unknown = rows_where(F.col("weapon_category") == K.UNKNOWN_WEAPON, weight)
    missing = rows_where(text_missing("weapon_raw") if weight is None else F.col("weapon_text_missing"), weight)
    zero = F.lit(0.0)
    return df.agg(
        total.alias("total_records"),
        unknown.alias("unknown_weapons"),
        F.coalesce(percent(unknown, total), zero).alias("unknown_weapon_percentage"),
        missing.alias("missing_weapon_data"),
        F.coalesce(percent(missing, total), zero).alias("missing_data_percentage"),
        F.coalesce(percent(total - unknown - missing, total), zero).alias("data_completeness_score"),
    )


def subset_counts(df: DataFrame, key: str = "weapon_category", flag: str = "severity_flag", weight: str | None = None) -> DataFrame:
    """Rows per label, in all and in the flagged subset, from one pass."""
    return labelled(df, [key], weight).groupBy(key).agg(
        rows(weight).alias("n"), rows_where(F.col(flag), weight).alias("n_subset")
    )


def compare_subset(
    df: DataFrame,
    key: str = "weapon_category",
    flag: str = "severity_flag",
    domain: Sequence[str] | None = K.WEAPON_DOMAIN,
    points: float = K.SUBSET_POINTS,
    weight: str | None = None,
) -> DataFrame:
    """Share of each label in all rows and in the subset, with the difference in points.

    ``domain`` fixes the reported labels (absent ones count 0); ``None`` reports those present.
    The flags look at the unrounded difference.
    """
    counts = subset_counts(df, key, flag, weight)
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.sum("n_subset").alias("s"))).scalar()
    shares = counts.select(
        key, percent(F.col("n"), whole["n"]).alias("_all"), percent(F.col("n_subset"), whole["s"]).alias("_sub")
    )
    if domain is not None:
        shares = labels_frame(df, list(domain), key).join(shares, key, "left")
    a, s = F.coalesce("_all", F.lit(0.0)), F.coalesce("_sub", F.lit(0.0))
    return shares.select(
        key, a.alias("all_crimes_percentage"), s.alias("serious_crimes_percentage"), (s - a).alias("difference"),
        (s - a > points).alias("over_represented_in_serious"),
        (s - a < -points).alias("under_represented_in_serious"),
    ).withColumns({f"{c}_shown": shown(F.col(c)) for c in ("all_crimes_percentage", "serious_crimes_percentage", "difference")})


def weapon_comparison_chart(df: DataFrame, weight: str | None = None) -> DataFrame:
    """All against serious shares over the labels on either side; a serious row is a row, so one pass has both."""
    return compare_subset(df, domain=None, weight=weight).select(
        "weapon_category", "all_crimes_percentage", "serious_crimes_percentage")


def weapon_shares(df: DataFrame, by: str, weight: str | None = None) -> DataFrame:
    """Zero-filled counts of weapons per year or region, with the percentage within it."""
    return two_way(df, by, "weapon_category", weight, normalize="row").withColumn(
        "percentage", F.col("share") * 100.0
    ).drop("share")


def unknown_trend(df: DataFrame, by: str = "publication_year", weight: str | None = None) -> DataFrame:
    """Percentage of unknown weapons per period; empty when no row is unknown."""
    per = cells(df, by, "weapon_category", weight).groupBy(by).agg(
        F.sum("n").alias("_total"),
        F.coalesce(F.sum(F.when(F.col("weapon_category") == K.UNKNOWN_WEAPON, F.col("n"))), F.lit(0)).alias("_unknown"),
    )
    any_unknown = per.agg(F.sum("_unknown")).scalar()
    return per.where(any_unknown > 0).select(by, percent(F.col("_unknown"), F.col("_total")).alias("percentage"))


def unknown_direction(trend: DataFrame, by: str = "publication_year") -> DataFrame:
    """One row: first and last unknown percentage and whether it increased."""
    one = trend.agg(
        F.count(F.lit(1)).alias("periods"),
        F.min_by("percentage", by).alias("first_percentage"),
        F.max_by("percentage", by).alias("last_percentage"),
    )
    return one.withColumn(
        "direction",
        F.when(F.col("last_percentage") > F.col("first_percentage"), F.lit("increased")).when(
            F.col("periods") > 0, F.lit("decreased")
        ),
    )


def periods_analyzed(df: DataFrame, by: str = "publication_year") -> DataFrame:
    """Distinct periods or regions with both keys known, in order, one row each."""
    return df.where(F.col(by).isNotNull() & F.col("weapon_category").isNotNull()).select(by).distinct().orderBy(by)


def weapon_summary(totals: DataFrame, counts: DataFrame, quality: DataFrame, direction: DataFrame) -> DataFrame:
    """One row with the one-line text. Wording is a fixed value."""
    most = extremes(counts, "weapon_category").select("most_common").scalar()
    unknown = quality.select("unknown_weapon_percentage").scalar()
    d = direction.select(F.struct("periods", "direction", "first_percentage", "last_percentage")).scalar()
    parts = F.concat_ws(
        ". ",
        F.format_string(
            "Analyzed %d serious crimes out of %d total records (%s%%)",
            F.col("total_serious_crimes"), F.col("total_all_crimes"), fixed(F.col("serious_crime_percentage"), 1),
        ),
        F.concat(F.lit("Most common weapon category in serious crimes: "), most),
        F.format_string("Unknown weapon information: %s%% of serious crimes", fixed(unknown, 1)),
        F.when(
            d["periods"] >= 2,
            F.format_string(
                "Unknown weapon percentage %s from %s%% to %s%% over time",
                d["direction"], fixed(d["first_percentage"], 1), fixed(d["last_percentage"], 1),
            ),
        ),
        F.lit("Note: Analysis is aggregate-only and subject to reporting bias and missing data limitations"),
    )
    failed = F.concat(F.lit("Weapons analysis could not be completed: "), F.col("error"))
    return totals.select(F.coalesce(failed, F.concat(parts, F.lit("."))).alias("summary"))


def analyze_weapons(df: DataFrame, weight: str | None = None) -> dict[str, DataFrame]:
    """The weapon report, every table from one count of the rows (or of a case cube).

    The serious rows are told by their count, not by the flag alone: a plain
    flag test would be pushed below the count, which then could not be shared.
    """
    df = flag_missing_text(df)
    keys = ("publication_year", "birth_region", "weapon_category", "severity_flag", "weapon_text_missing")
    counted = df.groupBy(*keys).agg(rows(weight).alias("n"))
    serious = counted.where(F.when(F.col("severity_flag"), F.col("n")) > 0)
    totals = weapon_totals(counted, "n")
    counts = weapon_distribution(serious, "n")
    unknown = unknown_trend(serious, "publication_year", "n")
    quality = weapon_quality(serious, "n")
    return {
        "totals": totals,
        "weapon_distribution": counts,
        "most_and_least": extremes(counts, "weapon_category"),
        "temporal_trends": weapon_shares(serious, "publication_year", "n"),
        "unknown_weapon_trend": unknown,
        "regional_patterns": weapon_shares(serious, "birth_region", "n"),
        "data_quality": quality,
        "serious_vs_all_comparison": compare_subset(counted, weight="n"),
        "summary": weapon_summary(totals, counts, quality, unknown_direction(unknown)),
    }
