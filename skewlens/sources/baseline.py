"""Yearly baseline records with their offense family."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..constants import BASELINE_CROSSWALK, BASELINE_FAMILIES, OTHER_BASELINE_FAMILY
from ..functions.literals import map_of
from ..functions.text import Taxonomy, classify
from ..schemas import BASELINE_PAGE


def read_baseline(
    spark: SparkSession, path: str, years: Sequence[int] | None = None, one_page_per_file: bool = True
) -> DataFrame:
    """Read ``path/year=YYYY/*.json`` pages ``{"data": [...]}``, one row per record.

    The year comes from the folder, so a year list prunes folders instead of rows.
    """
    schema = StructType([*BASELINE_PAGE, StructField("year", IntegerType())])
    pages = spark.read.schema(schema).json(path, multiLine=one_page_per_file)
    if years is not None:
        pages = pages.where(F.col("year").isin(list(years)))
    records = pages.select("year", F.explode_outer("data").alias("r")).where(F.col("r").isNotNull())
    return standardize_baseline(
        records.select("year", "r.state", "r.offense_type", "r.count", "r.rate_per_100k")
    )


def standardize_baseline(
    records: DataFrame,
    taxonomy: Taxonomy = BASELINE_FAMILIES,
    default: str = OTHER_BASELINE_FAMILY,
    offense: str = "offense_type",
) -> DataFrame:
    """Add ``crime_family`` in the baseline's own vocabulary."""
    lowered = records.withColumn("_offense", F.lower(F.coalesce(F.col(offense), F.lit("None"))))
    return lowered.withColumn("crime_family", classify(F.col("_offense"), taxonomy, default)).drop("_offense")


def translate_families(
    baseline: DataFrame,
    crosswalk: Mapping[str, str] | None = BASELINE_CROSSWALK,
    family: str = "crime_family",
) -> DataFrame:
    """Rename baseline families to the notice vocabulary; ``None`` leaves them as they are."""
    if crosswalk is None:
        return baseline
    return baseline.withColumn(
        family, F.coalesce(F.try_element_at(map_of(crosswalk), F.col(family)), F.col(family))
    )


def combine_sources(sources: Mapping[str, DataFrame], columns: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Union several sources under common names.

    ``columns[source]`` maps a common name to that source's expression; a name
    a source lacks is null there. The source name is kept in ``source``.
    """
    parts = [
        frame.select(*[F.expr(e).alias(n) for n, e in columns[name].items()], F.lit(name).alias("source"))
        for name, frame in sources.items()
    ]
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined
