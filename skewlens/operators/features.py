"""Derived columns of a notice: place, time, category, weapon, severity, activity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.dates import bucketize, floor_days
from ..functions.text import Taxonomy, classify, contains_any, deciding_words, first_code, notice_text, shortest_words
from .joins import join_baseline, lookup


def add_geography(
    df: DataFrame,
    place: str = "place_of_birth",
    codes: Sequence[str] = K.STATE_CODES,
    populations: Mapping[str, float] = K.STATE_POPULATIONS,
    regions: Mapping[str, Sequence[str]] = K.REGIONS,
) -> DataFrame:
    """``birth_state`` (null text stays null), its population and region."""
    region_of = {state: region for region, states in regions.items() for state in states}
    return (
        df.withColumn("_place", F.upper(place))
        .withColumn("birth_state", first_code("_place", codes, K.UNKNOWN_STATE))
        .drop("_place")
        .withColumns({
            "birth_state_population": lookup(F.col("birth_state"), populations),
            "birth_region": F.coalesce(lookup(F.col("birth_state"), region_of), F.lit(K.OTHER_REGION)),
        })
    )


def add_calendar(df: DataFrame, date: str = "publication_date", age: str = "case_age_days") -> DataFrame:
    """Year, quarter and month of publication; case age in months, years and as a bucket."""
    return df.withColumns({
        "publication_year": F.year(date),
        "publication_quarter": F.quarter(date),
        "publication_month": F.month(date),
        "case_age_months": F.col(age) / K.DAYS_PER_MONTH,
        "case_age_years": F.col(age) / K.DAYS_PER_YEAR,
        "case_age_category": bucketize(F.col(age), K.CASE_AGE_BUCKETS, K.CASE_AGE_MISSING),
    })


def _implied_words(taxonomy: Taxonomy, families: Sequence[str]) -> list[str]:
    """Words that put a text into one of ``families`` whatever else it says."""
    words: list[str] = []
    for label, own in deciding_words(taxonomy):
        if label not in families:
            break
        words += own
    return words


def add_text_rules(
    df: DataFrame,
    title: str = "title",
    description: str = "description",
    families: Taxonomy = K.CRIME_FAMILIES,
    weapons: Taxonomy = K.WEAPONS,
    phrases: Sequence[str] = K.SERIOUS_PHRASES,
    serious_families: Sequence[str] = K.SERIOUS_FAMILIES,
) -> DataFrame:
    """``weapon_raw`` (the searched text), ``crime_family``, ``weapon_category``, ``severity_flag``.

    The text is folded once and all three rules read it. Severity looks only for
    phrases that the family has not already settled.
    """
    implied = _implied_words(families, serious_families)
    open_phrases = [p for p in shortest_words(phrases) if not any(w in p for w in implied)]
    text = F.col("weapon_raw")
    return (
        df.withColumn("weapon_raw", notice_text(F.col(title), F.col(description)))
        .withColumns({
            "crime_family": classify(text, families, K.OTHER_FAMILY),
            "weapon_category": classify(text, weapons, K.UNKNOWN_WEAPON),
        })
        .withColumns({
            "severity_flag": F.col("crime_family").isin(list(serious_families)) | contains_any(text, open_phrases),
            "public_notice_flag": F.lit(True),
        })
    )


def add_activity(df: DataFrame) -> DataFrame:
    """Days since the last change, recent-change flag, reward and image flags."""
    days = floor_days(F.col("ingestion_date"), F.col("modified_date"))
    return df.withColumn("days_since_modified", days).withColumns({
        "recently_updated": F.coalesce(F.col("days_since_modified") < K.RECENT_UPDATE_DAYS, F.lit(False)),
        "has_reward": F.col("reward_text").isNotNull(),
        "has_images": F.coalesce(F.size("images") > 0, F.lit(False)),
    })


def engineer_features(
    notices: DataFrame,
    baseline: DataFrame | None = None,
    crosswalk: Mapping[str, str] | None = K.BASELINE_CROSSWALK,
) -> DataFrame:
    """All derived columns; with ``baseline`` also its yearly count and rate per family."""
    engineered = (
        notices.transform(add_geography).transform(add_calendar).transform(add_text_rules).transform(add_activity)
    )
    return engineered if baseline is None else join_baseline(engineered, baseline, crosswalk)


def known_places(df: DataFrame, unit: str = "birth_state", unknown: str = K.UNKNOWN_STATE) -> DataFrame:
    """Drop rows whose unit is the unknown label; rows with a null unit stay."""
    return df.where(~F.col(unit).eqNullSafe(unknown))


def serious_only(df: DataFrame, flag: str = "severity_flag") -> DataFrame:
    return df.where(F.col(flag))


def select_years(df: DataFrame, years: Sequence[int] = (), year: str = "publication_year") -> DataFrame:
    """Rows of the given years; an empty selection keeps everything."""
    return df.where(F.col(year).isin(list(years))) if years else df


def available_years(df: DataFrame, year: str = "publication_year") -> DataFrame:
    """Distinct non-null years in order."""
    return df.where(F.col(year).isNotNull()).select(year).distinct().orderBy(year)


def sample_gate(df: DataFrame, minimum: int = K.MIN_DASHBOARD_SAMPLE, weight: str | None = None) -> DataFrame:
    """One row: sample size and whether it reaches ``minimum``."""
    from ..functions.numbers import rows

    return df.agg(rows(weight).alias("sample_size")).withColumns({
        "minimum": F.lit(minimum),
        "status": F.when(F.col("sample_size") >= minimum, F.lit("ok")).otherwise(F.lit("insufficient_data")),
    })
