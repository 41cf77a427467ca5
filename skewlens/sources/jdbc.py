"""Relational databases through JDBC (the driver jar is the caller's)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .tables import _MODES


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read ``table`` as parallel range scans over a numeric column."""
    return spark.read.jdbc(
        url, table, column=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, properties=dict(properties or {}),
    )


def write_jdbc(
    df: DataFrame, url: str, table: str, if_exists: str = "append", properties: Mapping[str, str] | None = None
) -> None:
    df.write.jdbc(url, table, mode=_MODES[if_exists], properties=dict(properties or {}))
