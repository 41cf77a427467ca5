"""CSV and JSON files of engineered notices, baseline counts and result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..schemas import FEATURE_CSV

_NESTED = (ArrayType, MapType, StructType)
_QUOTED_EMPTY = "\u0001"  # keeps an empty text apart from null while reading
_TIMESTAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _one_line(text: Column) -> Column:
    """Line ends and the sign that marks them written out, so that every record is one line."""
    for char, mark in (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(char), F.lit(mark))
    return text


def _lines_again(text: Column) -> Column:
    for char, mark in (("\n", "\\n"), ("\r", "\\r"), ("\\", "\\b")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; nested columns travel as JSON text. Null is empty, an empty text is quoted.

    Line ends inside a text are written out (\\n, \\r, and \\b for a backslash): a reader can then split a file.
    """
    flat = df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, _NESTED) else F.col(f.name) for f in df.schema]
    )
    texts = [f.name for f in flat.schema if isinstance(f.dataType, StringType)]
    flat.withColumns({n: _one_line(F.col(n)) for n in texts}).write.mode(mode).csv(path, header=True, escape='"', **_TIMESTAMPS)


def read_feature_csv(
    spark: SparkSession, path: str, schema: StructType = FEATURE_CSV, line_ends: bool = False
) -> DataFrame:
    """Read an export back: dates and flags typed, ``images`` a list again.

    Columns are matched to the header by name; those not declared stay text.
    ``line_ends=True`` reads files of other programs, whose quoted texts may hold
    line ends as they are; such a file is read by one task.
    """
    names = spark.read.csv(path, header=True, escape='"', multiLine=line_ends).columns
    declared = StructType([schema[n] if n in schema.names else StructField(n, StringType()) for n in names])
    rows = spark.read.schema(declared).csv(
        path, header=True, escape='"', emptyValue=_QUOTED_EMPTY, multiLine=line_ends, **_TIMESTAMPS
    )
    texts = [f.name for f in declared if isinstance(f.dataType, StringType)]
    back = {n: F.when(F.col(n) == _QUOTED_EMPTY, F.lit("")).otherwise(F.col(n) if line_ends else _lines_again(F.col(n))) for n in texts}
    rows = rows.withColumns(back)
    if "images" in names:
        rows = rows.withColumn("images", F.from_json("images", "array<string>"))
    return rows


def with_row_position(df: DataFrame) -> DataFrame:
    """Rows read from Parquet files with ``_file`` and ``_row``: where each one lies, however it is read or dealt later."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def write_json(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """One JSON-lines folder per result table."""
    for name, table in tables.items():
        table.write.mode(mode).json(f"{folder.rstrip('/')}/{name}", ignoreNullFields=False, **_TIMESTAMPS)
