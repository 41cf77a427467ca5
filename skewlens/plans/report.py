"""Numbers of the written report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import fixed
from ..functions.text import title_label


def dataset_summary(one: DataFrame) -> DataFrame:
    """Records, date range, categories and states as printed, from the overview row."""
    return one.select(
        F.format_number("total_cases", 0).alias("total_records"),
        F.date_format("first_publication", "yyyy-MM-dd").alias("first_date"),
        F.date_format("last_publication", "yyyy-MM-dd").alias("last_date"),
        "crime_categories",
        "states_represented",
    )


def trending_categories(trends: DataFrame) -> DataFrame:
    """Categories with a significant trend, direction and p-value as printed."""
    return trends.where("significant_trend").select(
        "crime_family", "trend_direction", fixed(F.col("trend_p_value"), 4).alias("p_value")
    )


def weapon_lines(distribution: DataFrame) -> DataFrame:
    """Weapon distribution with display labels."""
    return distribution.select(
        title_label(F.col("weapon_category")).alias("weapon"), "n", F.col("percentage_shown").alias("percentage")
    )


def test_lines(results: DataFrame) -> DataFrame:
    """Statistic and p-value of each test as printed."""
    return results.select(
        "analysis_type",
        fixed(F.col("test_statistic"), 3).alias("test_statistic"),
        fixed(F.col("p_value"), 4).alias("p_value"),
        F.when(F.col("significant"), "Yes").otherwise("No").alias("significant"),
        "interpretation",
    )


def badges(results: DataFrame, trends: DataFrame) -> DataFrame:
    """One row: which biases were detected and how many trends are significant."""
    def detected(kind):
        hit = F.coalesce(F.bool_or((F.col("analysis_type") == kind) & F.col("significant")), F.lit(False))
        return F.when(hit, "Detected").otherwise("Not Detected")

    return results.agg(
        detected("Geographic Representation").alias("geographic_bias"),
        detected("Category Distribution").alias("category_bias"),
    ).withColumn("significant_trends", trends.agg(F.count_if("significant_trend")).scalar())
