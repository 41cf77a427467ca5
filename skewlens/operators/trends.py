"""Linear trend of category counts over periods, absent combinations counting 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.numbers import clamped
from ..functions.special import correlation_p_value
from .counts import cells, two_way


def trend_from_cells(
    counted: DataFrame,
    key: str,
    period: str,
    alpha: float = 1 - K.CONFIDENCE,
    min_periods: int = K.MIN_PERIODS,
) -> DataFrame:
    """Pearson correlation of period and count per category, from sparse two-way counts.

    The zero cells are never built. Mean, variance and covariance over the cells
    that exist are merged in closed form with the block of zero cells, so one
    small aggregate per category is enough, whatever the number of periods.
    """
    # The always-true test on n keeps the plan of the counts, so their shuffle is reused.
    periods = counted.where("n >= 0").select(period).distinct().agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("m"),
            F.min(period).alias("first"),
            F.max(period).alias("last"),
            F.avg(period).alias("mean"),
            F.var_pop(period).alias("var"),
        )
    ).scalar()
    y, n, at = F.col(period).cast("double"), F.col("n").cast("double"), F.col("_periods")
    # Plain numbers in the aggregate: a struct would turn it into a sort.
    per = counted.withColumn("_periods", periods).groupBy(key).agg(
        F.max(at["m"]).alias("_m"),
        F.max(at["mean"]).alias("_mean"),
        F.max(at["var"]).alias("_spread"),
        F.count(F.lit(1)).alias("_k"),
        F.avg(y).alias("_y"),
        F.avg(n).alias("_n"),
        F.var_pop(n).alias("_var"),
        F.covar_pop(y, n).alias("_cov"),
        F.sum("n").alias("total_cases"),
        F.coalesce(F.max(F.when(F.col(period) == at["first"], F.col("n"))), F.lit(0)).alias("first_cases"),
        F.coalesce(F.max(F.when(F.col(period) == at["last"], F.col("n"))), F.lit(0)).alias("last_cases"),
    )
    k, m = F.col("_k"), F.col("_m")
    spread = F.col("_var") * k + F.col("_n") * F.col("_n") * k * (m - k) / m
    joint = F.col("_cov") * k + (F.col("_y") - F.col("_mean")) * F.col("_n") * k
    r = F.try_divide(joint, F.sqrt(spread * F.col("_spread") * m))
    first, last = F.col("first_cases"), F.col("last_cases")
    return (
        per.where((m >= min_periods) & (F.col("total_cases") > 0))
        .withColumn("_r", clamped(r, -1.0, 1.0))
        # Rounding noise around an exact zero must not decide the direction.
        .withColumn("correlation_with_time", F.when(F.abs("_r") < 1e-12, F.lit(0.0)).otherwise(F.col("_r")))
        .withColumn("trend_p_value", correlation_p_value("correlation_with_time", "_m"))
        .select(
            key,
            "correlation_with_time",
            "trend_p_value",
            F.coalesce(F.col("trend_p_value") < alpha, F.lit(False)).alias("significant_trend"),
            F.when(F.col("correlation_with_time") > 0, F.lit("increasing")).otherwise("decreasing").alias("trend_direction"),
            F.coalesce(F.try_divide((last - first) * 100.0, first.cast("double")), F.lit(0.0)).alias("percent_change"),
            "total_cases",
            "first_cases",
            "last_cases",
        )
    )


def trend(
    df: DataFrame,
    key: str = "crime_family",
    period: str = "publication_year",
    confidence: float = K.CONFIDENCE,
    weight: str | None = None,
) -> DataFrame:
    """Trend per category over the periods present in ``df``."""
    return trend_from_cells(cells(df, period, key, weight), key, period, 1 - confidence)


def strong_trends(table: DataFrame, threshold: float = K.TREND_THRESHOLD) -> DataFrame:
    """Trends whose correlation reaches ``threshold`` in size."""
    return table.where(F.abs("correlation_with_time") >= threshold)


def significant_trend_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count_if("significant_trend").alias("significant_trends"))


def analyze_trends(
    df: DataFrame, confidence: float = K.CONFIDENCE, weight: str | None = None
) -> dict[str, DataFrame]:
    """Zero-filled yearly counts, trend table and the number of significant trends."""
    table = trend(df, confidence=confidence, weight=weight)
    return {
        "yearly_category_counts": two_way(df, "publication_year", "crime_family", weight),
        "trend": table,
        "significant_trends": significant_trend_count(table),
    }
