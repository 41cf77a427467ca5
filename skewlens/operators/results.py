"""Test results in one table, findings, and the rows kept as history."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from .joins import lookup

_COLUMNS = [
    "analysis_type", "test_statistic", "p_value", "significant", "interpretation", "sample_size", "confidence_level",
]


def _row(test: DataFrame, kind: str, statistic: str, p: str, significant: str, text: Column, untested: bool) -> DataFrame:
    rows = test if untested else test.where(F.col(p).isNotNull())
    return rows.select(
        F.lit(kind).alias("analysis_type"),
        F.col(statistic).alias("test_statistic"),
        F.col(p).alias("p_value"),
        F.col(significant).alias("significant"),
        text.alias("interpretation"),
        F.col("sample_size").cast("long").alias("sample_size"),
        F.col("confidence_level"),
        *([F.to_json(F.struct(*test.columns)).alias("metadata")] if untested else []),
    )


def result_table(
    geographic: DataFrame | None = None, categorical: DataFrame | None = None, persistence: DataFrame | None = None,
    untested: bool = False,
) -> DataFrame:
    """One row per test that has a p-value, from the one-row tests of the analyses.

    ``untested`` also gives those without one (too few units or rows), and each
    row the whole test as JSON in ``metadata``: what the history keeps.
    """
    parts = []
    if geographic is not None:
        parts.append(_row(geographic, "Geographic Representation", "chi_square_statistic", "p_value",
                          "significant_bias", F.col("interpretation"), untested))
    if categorical is not None:
        parts.append(_row(categorical, "Category Distribution", "chi_square_statistic", "p_value",
                          "significant_bias", F.lit(K.CATEGORY_TEXT), untested))
    if persistence is not None:
        parts.append(_row(persistence, "Case Persistence", "anova_f_statistic", "anova_p_value",
                          "significant_differences", F.col("interpretation"), untested))
    return reduce(DataFrame.unionByName, parts)


def findings(results: DataFrame, trends: DataFrame) -> DataFrame:
    """Sentences of the significant findings, in report order."""
    order = {
        "Geographic Representation": (1, K.FINDING_GEO),
        "Category Distribution": (2, K.FINDING_CATEGORY),
        "Case Persistence": (4, K.FINDING_PERSISTENCE),
    }
    kind = F.col("analysis_type")
    tests = results.where("significant").select(
        lookup(kind, {k: i for k, (i, _) in order.items()}).alias("position"),
        lookup(kind, {k: t for k, (_, t) in order.items()}).alias("finding"),
    )
    moving = trends.agg(F.count_if("significant_trend").alias("k")).where("k > 0").select(
        F.lit(3).alias("position"), F.lit(K.FINDING_TREND).alias("finding")
    )
    return tests.unionByName(moving).orderBy("position")


def stored_results(results: DataFrame, analysed_at: datetime | Column) -> DataFrame:
    """Result rows in the layout of the history table; ``metadata`` is the whole test, or else the whole row, as JSON."""
    at = analysed_at if isinstance(analysed_at, Column) else F.lit(analysed_at)
    return results.select(
        "analysis_type",
        at.cast("timestamp").alias("analysis_date"),
        "confidence_level",
        "test_statistic",
        "p_value",
        F.col("significant").alias("significant_bias"),
        "interpretation",
        F.col("metadata") if "metadata" in results.columns else F.to_json(F.struct(*_COLUMNS)).alias("metadata"),
        "sample_size",
    )
