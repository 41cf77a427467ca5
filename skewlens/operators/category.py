"""Category shares of notices against a baseline."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.numbers import share
from ..sources.baseline import translate_families
from .counts import distribution
from .joins import align_common
from .representation import _goodness_of_fit, _with_p_value


def baseline_distribution(
    baseline: DataFrame,
    crosswalk: Mapping[str, str] | None = K.BASELINE_CROSSWALK,
    family: str = "crime_family",
    count: str = "count",
) -> DataFrame:
    """Total baseline count per family and its share of all families."""
    return distribution(translate_families(baseline, crosswalk, family), family, weight=count, over="known").drop(
        "percentage"
    )


def category_comparison(
    wanted: DataFrame,
    baseline: DataFrame,
    family: str = "crime_family",
    over: float = K.CATEGORY_OVER,
    under: float = K.CATEGORY_UNDER,
) -> DataFrame:
    """Share against share for families with a positive baseline share, from two distributions."""
    right = baseline.select(family, F.col("n").alias("baseline_cases"), F.col("proportion").alias("baseline_proportion"))
    left = wanted.select(family, F.col("n").alias("wanted_cases"), F.col("proportion").alias("wanted_proportion"))
    ratio = F.col("representation_ratio")
    return (
        align_common(left, right.where(F.col("baseline_proportion") > 0), family)
        .withColumn("representation_ratio", share(F.col("wanted_proportion"), F.col("baseline_proportion")))
        .withColumns({"over_represented": ratio > over, "under_represented": ratio < under})
    )


def category_test(
    wanted: DataFrame, baseline: DataFrame, family: str = "crime_family", confidence: float = K.CONFIDENCE
) -> DataFrame:
    """One row: chi-square of notice counts against baseline counts over shared families."""
    both = align_common(
        wanted.select(family, "n", "proportion"),
        baseline.select(family, F.col("n").alias("_base"), F.col("proportion").alias("_share")),
        family,
    )
    # The baseline brought to the size of the notices first, so that no digits are lost below.
    expected = F.col("_share") * share(F.col("n"), F.col("proportion"))
    parts = _goodness_of_fit(F.col("_base") > 0, F.col("n"), expected)
    parts["_rescaled"] = F.sum("n") != F.sum("_base")
    return _with_p_value(both.agg(*[c.alias(n) for n, c in parts.items()]), 1 - confidence)


def analyze_categories(
    df: DataFrame,
    baseline: DataFrame | None = None,
    crosswalk: Mapping[str, str] | None = K.BASELINE_CROSSWALK,
    confidence: float = K.CONFIDENCE,
    weight: str | None = None,
) -> dict[str, DataFrame]:
    """Notice distribution; with a baseline also its distribution, the comparison and the test.

    ``crosswalk=None`` keeps the baseline's own family names, which match none
    of the notice families: the comparison is then empty and the test has no statistic.
    """
    wanted = distribution(df, "crime_family", weight)
    if baseline is None:
        return {"wanted_distribution": wanted}
    base = baseline_distribution(baseline, crosswalk)
    sample = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return {
        "wanted_distribution": wanted,
        "baseline_distribution": base,
        "category_comparison": category_comparison(wanted, base),
        "test": category_test(wanted, base, confidence=confidence).withColumns({
            "confidence_level": F.lit(confidence), "sample_size": sample,
        }),
    }
