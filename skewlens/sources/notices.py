"""Landed notice pages -> one flat row per notice."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import floor_days, parse_timestamp
from ..schemas import NOTICE_PAGE, SUBJECT

_TOP = ["uid", "title", "description"]
_TOP_REST = ["url", "warning_message", "reward_text", "caution", "details"]
_LISTS = ["subjects", "images", "files"]
_SUBJECT_TEXT = [f.name for f in SUBJECT.fields if f.name not in ("date_of_birth", "aliases")]


def read_notice_pages(spark: SparkSession, path, one_page_per_file: bool = True) -> DataFrame:
    """Read pages ``{"items": [...]}``, one row per item.

    Pages kept as one JSON line each (``one_page_per_file=False``) are the form
    for large volumes: such files are split over tasks.
    """
    pages = spark.read.schema(NOTICE_PAGE).json(path, multiLine=one_page_per_file)
    return explode_items(pages)


def parse_notice_pages(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The same for payloads already landed as a text column."""
    return explode_items(payloads.select(F.from_json(column, NOTICE_PAGE).alias("page")).select("page.*"))


def explode_items(pages: DataFrame, items: str = "items") -> DataFrame:
    """One row per record; a page without records gives none.

    The outer form with a test on the records: a plain ``explode`` infers a test
    on the array, which for payload text means parsing every page three times.
    """
    return pages.select(F.explode_outer(items).alias("item")).where(F.col("item").isNotNull()).select("item.*")


def _instant(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def flatten_notices(items: DataFrame, ingested_at: datetime | Column) -> DataFrame:
    """Top-level fields, fields of the first subject, parsed dates, batch stamp and case age.

    ``ingested_at`` is one instant per batch, passed in so that a re-run of a
    lost task stamps the same value.
    """
    subject = F.get("subjects", F.lit(0))
    empty = {n: F.array().cast(items.schema[n].dataType) for n in _LISTS}
    flat = items.select(
        *_TOP,
        *[F.coalesce(F.col(n), empty[n]).alias(n) for n in _LISTS],
        parse_timestamp(F.col("publication")).alias("publication_date"),
        parse_timestamp(F.col("modified")).alias("modified_date"),
        *_TOP_REST,
        *[subject[n].alias(n) for n in _SUBJECT_TEXT],
        parse_timestamp(subject["date_of_birth"]).cast("date").alias("date_of_birth"),
        F.when(subject.isNotNull(), F.coalesce(subject["aliases"], F.array().cast("array<string>"))).alias("aliases"),
        _instant(ingested_at).cast("timestamp").alias("ingestion_date"),
    )
    return flat.withColumn("case_age_days", floor_days(F.col("ingestion_date"), F.col("publication_date")))
