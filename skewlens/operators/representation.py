"""Observed against expected: unit representation and chi-square goodness of fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.numbers import clamped, fixed, rows, share
from ..functions.special import chi2_p_value
from .features import known_places


def _per_unit(df: DataFrame, unit: str, size: str, weight: str | None) -> DataFrame:
    """Rows and size per unit. The null unit stays: it counts in the total."""
    return (
        known_places(df, unit)
        .groupBy(unit)
        .agg(rows(weight).alias("observed_cases"), F.max(size).alias("population_millions"))
    )


def _scored(per_unit: DataFrame, unit: str, over: float, under: float, min_sample: int) -> DataFrame:
    """Every unit with its expected cases, ratio and flags, and the totals they rest on.

    Expected is the unit's part of the summed size of the units *present*, times
    all rows. The totals are one scalar subquery over the counted units.
    """
    known = F.col(unit).isNotNull()
    whole = per_unit.agg(
        F.struct(
            F.coalesce(F.sum("observed_cases"), F.lit(0)).alias("cases"),
            F.sum(F.when(known, F.col("population_millions"))).alias("size"),
        )
    ).scalar()
    ratio, cases = F.col("representation_ratio"), F.col("_whole")["cases"]
    return (
        per_unit.withColumn("_whole", whole)
        .withColumn("expected_cases", share(F.col("population_millions"), F.col("_whole")["size"]) * cases)
        .withColumn("representation_ratio", share(F.col("observed_cases"), F.col("expected_cases")))
        .withColumns({
            "over_represented": ratio > over,
            "under_represented": ratio < under,
            "_sample": cases,
            # One test on an aggregate: a plain null test would be pushed below the
            # count, which then could not share its shuffle with the totals.
            "_shown": F.coalesce(
                F.when(known & (cases >= min_sample), F.col("population_millions")) > 0, F.lit(False)
            ),
        })
        .drop("_whole")
    )


def _table(scored: DataFrame) -> DataFrame:
    return scored.where("_shown").drop("_shown", "_sample")


def representation_from_counts(
    per_unit: DataFrame,
    unit: str,
    over: float = K.STATE_OVER,
    under: float = K.STATE_UNDER,
    min_sample: int = K.MIN_GEO_SAMPLE,
) -> DataFrame:
    """Expected cases and ratio per unit, from one row per unit; empty below ``min_sample`` rows."""
    return _table(_scored(per_unit, unit, over, under, min_sample))


def representation(
    df: DataFrame,
    unit: str = "birth_state",
    size: str = "birth_state_population",
    weight: str | None = None,
    over: float = K.STATE_OVER,
    under: float = K.STATE_UNDER,
    min_sample: int = K.MIN_GEO_SAMPLE,
) -> DataFrame:
    """Representation of each unit against its size (see :func:`representation_from_counts`)."""
    return representation_from_counts(_per_unit(df, unit, size, weight), unit, over, under, min_sample)


def _goodness_of_fit(used: Column, observed: Column, expected: Column) -> dict[str, Column]:
    """Aggregates of the chi-square statistic against expected counts scaled to the observed total.

    With gaps d = o - e, O and E the totals and D = O - E, the scaled statistic
    is E/O * (sum(d*d/e) - D*D/E): one pass, no second look at the rows.
    """
    o, e = F.when(used, observed).cast("double"), F.when(used, expected).cast("double")
    gap = o - e
    drift = F.sum(gap)
    statistic = share(F.sum(e), F.sum(o)) * (F.sum(F.try_divide(gap * gap, e)) - F.try_divide(drift * drift, F.sum(e)))
    return {
        "units_tested": F.count_if(used),
        "_statistic": statistic,
        "_rescaled": F.abs(drift) > F.sum(e) * 1e-9,
    }


def _with_p_value(one: DataFrame, alpha: float) -> DataFrame:
    enough = F.col("units_tested") > 1
    return (
        one.withColumns({
            "chi_square_statistic": F.when(enough, clamped(F.col("_statistic"), low=0.0)),
            "degrees_of_freedom": F.when(enough, F.col("units_tested") - 1),
            "expected_rescaled": F.when(enough, F.col("_rescaled")),
            "status": F.when(enough, F.lit("ok")).otherwise(F.lit("too_few_units")),
        })
        .withColumn("p_value", chi2_p_value("chi_square_statistic", "degrees_of_freedom"))
        .withColumn("significant_bias", F.col("p_value") < alpha)
        .drop("_statistic", "_rescaled")
    )


def chi_square(
    table: DataFrame,
    observed: str = "observed_cases",
    expected: str = "expected_cases",
    min_expected: float = K.MIN_EXPECTED,
    alpha: float = 1 - K.CONFIDENCE,
) -> DataFrame:
    """One row: goodness of fit over rows whose expected count reaches ``min_expected``.

    Expected counts are scaled to the observed total, as the test requires;
    ``expected_rescaled`` tells whether that changed them. Fewer than two rows
    give a null statistic and status 'too_few_units'.
    """
    used = F.coalesce(F.col(expected) >= min_expected, F.lit(False))
    parts = _goodness_of_fit(used, F.col(observed), F.col(expected))
    return _with_p_value(table.agg(*[c.alias(n) for n, c in parts.items()]), alpha)


def representation_summary(table: DataFrame) -> DataFrame:
    """One row: units, over and under counts, mean and sample standard deviation of the ratios."""
    return table.agg(
        F.count(F.lit(1)).alias("states_analyzed"),
        F.count_if("over_represented").alias("over_represented_states"),
        F.count_if("under_represented").alias("under_represented_states"),
        F.avg("representation_ratio").alias("mean_representation_ratio"),
        F.stddev_samp("representation_ratio").alias("std_representation_ratio"),
    )


def _listed(flag: Column, unit: str, prefix: str, suffix: str, named: Sequence[str]) -> Column:
    """Names of flagged units among ``named``, most cases first, as one sentence; empty when there are none.

    The sentence can only grow with that list; other units are found as rows of the table.
    """
    hit = F.when(flag & F.col(unit).isin(list(named)), F.struct((-F.col("observed_cases")).alias("k"), F.col(unit).alias("u")))
    names = F.transform(F.array_sort(F.collect_list(hit)), lambda s: s["u"])
    return F.when(F.size(names) > 0, F.concat(F.lit(prefix), F.array_join(names, ", "), F.lit(suffix))).otherwise("")


def _geographic_test(scored: DataFrame, unit: str, confidence: float, min_sample: int) -> DataFrame:
    """The one-row test with its sentence. Wording is a fixed value; states are named, other units are not."""
    shown = F.col("_shown")
    used = F.coalesce(shown & (F.col("expected_cases") >= K.MIN_EXPECTED), F.lit(False))
    parts = _goodness_of_fit(used, F.col("observed_cases"), F.col("expected_cases")) | {
        "sample_size": F.coalesce(F.max("_sample"), F.lit(0)),
        "_over": _listed(shown & F.col("over_represented"), unit, "Over-represented states: ", ". ", K.STATE_CODES),
        "_under": _listed(shown & F.col("under_represented"), unit, "Under-represented states: ", ".", K.STATE_CODES),
    }
    one = _with_p_value(scored.agg(*[c.alias(n) for n, c in parts.items()]), 1 - confidence)
    p = fixed(F.col("p_value"), 4)
    found = F.concat(
        F.lit("Significant geographic bias detected (p="), p, F.lit("). "), F.col("_over"), F.col("_under")
    )
    none = F.concat(
        F.lit("No significant geographic bias detected (p="), p,
        F.lit("). Representation appears proportional to population."),
    )
    small = F.col("sample_size") < min_sample
    return one.withColumns({
        "interpretation": F.when(F.col("significant_bias"), found).when(F.col("p_value").isNotNull(), none),
        "confidence_level": F.lit(confidence),
        "status": F.when(small, F.lit("insufficient_data")).otherwise(F.col("status")),
        "error": F.when(small, F.lit(K.ERROR_GEO)),
    }).drop("_over", "_under")


def scatter(table: DataFrame, unit: str = "birth_state") -> DataFrame:
    """Representation with its colour label and the proportional line at each size."""
    whole = table.agg(
        F.struct(
            F.sum("observed_cases").alias("o"),
            F.sum("population_millions").alias("p"),
            F.max("population_millions").alias("m"),
        )
    ).scalar()
    slope = share(whole["o"], whole["p"])
    return table.select(
        unit, "population_millions", "observed_cases", "representation_ratio",
        bias_label().alias("label"),
        slope.alias("expected_slope"),
        whole["m"].alias("line_end_population"),
        (whole["m"] * slope).alias("line_end_cases"),
    )


def bias_label() -> Column:
    """Row class of a representation table: over, under or neither."""
    return (
        F.when(F.col("over_represented"), F.lit("over_represented"))
        .when(F.col("under_represented"), F.lit("under_represented"))
        .otherwise(F.lit("normal"))
    )


def analyze_geography(
    df: DataFrame,
    unit: str = "birth_state",
    size: str = "birth_state_population",
    confidence: float = K.CONFIDENCE,
    min_sample: int = K.MIN_GEO_SAMPLE,
    weight: str | None = None,
) -> dict[str, DataFrame]:
    """Representation table, its summary, and the one-row test with interpretation and status."""
    scored = _scored(_per_unit(df, unit, size, weight), unit, K.STATE_OVER, K.STATE_UNDER, min_sample)
    table = _table(scored)
    return {
        "representation": table,
        "summary": representation_summary(table),
        "test": _geographic_test(scored, unit, confidence, min_sample),
    }
