"""Lookups, the baseline join and alignment of two distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import BASELINE_CROSSWALK, CRIME_FAMILIES, OTHER_FAMILY
from ..functions.literals import array_of, map_of
from ..functions.numbers import share
from ..sources.baseline import translate_families


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Value for ``key`` from a small fixed table, null if absent. No join, no shuffle."""
    return F.try_element_at(map_of(table), key)


def yearly_baseline(
    baseline: DataFrame, crosswalk: Mapping[str, str] | None = BASELINE_CROSSWALK
) -> DataFrame:
    """Baseline rolled up per family and year: total count and mean rate."""
    return (
        translate_families(baseline, crosswalk)
        .where(F.col("crime_family").isNotNull() & F.col("year").isNotNull())
        .groupBy("crime_family", "year")
        .agg(F.sum("count").alias("count"), F.avg("rate_per_100k").alias("rate_per_100k"))
    )


FAMILIES = [name for name, _ in CRIME_FAMILIES] + [OTHER_FAMILY]
YEARS = (0, 9999)


def join_yearly(notices: DataFrame, yearly: DataFrame, families: Sequence[str] | None = FAMILIES) -> DataFrame:
    """Left join of notices to a yearly baseline on family and publication year.

    The right side has one row per key, so notices are never multiplied. Only
    the ``families`` the notices can have and calendar years take part, which
    bounds the right side (some ten thousand short rows per family at most): it
    is broadcast, and the notices stay where they are. ``families=None`` takes
    every family and leaves the join to Spark.
    """
    right = yearly.withColumnsRenamed(
        {"crime_family": "_family"} | ({"count": "count_baseline"} if "count" in notices.columns else {})
    )
    if families is not None:
        right = F.broadcast(right.where(F.col("_family").isin(list(families)) & F.col("year").between(*YEARS)))
    return notices.join(
        right, (notices["crime_family"] == right["_family"]) & (notices["publication_year"] == right["year"]), "left"
    ).drop("_family")


def join_baseline(
    notices: DataFrame, baseline: DataFrame, crosswalk: Mapping[str, str] | None = BASELINE_CROSSWALK,
    families: Sequence[str] | None = FAMILIES,
) -> DataFrame:
    """:func:`join_yearly` with the roll-up of baseline records."""
    return join_yearly(notices, yearly_baseline(baseline, crosswalk), families)


def align_union(left: DataFrame, right: DataFrame, key: str, values: Mapping[str, str]) -> DataFrame:
    """Full outer alignment of two distributions on ``key``; a side without the key counts 0.

    ``values`` maps the left column to the right column.
    """
    (a, b), = values.items()
    return left.select(key, a).join(right.select(key, b), key, "full_outer").na.fill(0, [a, b])


def align_common(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of keys present on both sides."""
    return left.join(right, key, "inner")


def labels_frame(df: DataFrame, labels: list[str], column: str) -> DataFrame:
    """A fixed label domain as a DataFrame, one row per label."""
    return df.sparkSession.range(1).select(F.explode(array_of(labels)).alias(column))


def compare_shares(left: DataFrame, right: DataFrame, key: str, part: str = "proportion") -> DataFrame:
    """Left shares with the matching right share (0 if absent) and their ratio (null then)."""
    r = right.select(F.col(key), F.col(part).alias("_other"))
    joined = left.join(r, key, "left").withColumn("_other", F.coalesce("_other", F.lit(0.0)))
    return joined.withColumn("ratio", share(F.col(part), F.col("_other")))
