"""Notices, features and baseline records derived from the given tables.

One notice per order and one baseline record per shipping year, part type and
return flag, so that every registered query grows with ``orders``, ``customer``
and ``lineitem``. Order codes are read as the wording of a notice through the
two code books below; ``registry/oracles.py`` states the same mapping in SQL.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from skewlens.functions.dates import floor_days
from skewlens.functions.literals import array_sql, map_sql
from skewlens.operators.features import engineer_features
from skewlens.operators.joins import lookup
from skewlens.sources.baseline import standardize_baseline
from skewlens.sources.files import with_row_position

INGESTED = datetime(2001, 8, 2, 6, 0, 0)

# Order status and priority -> title.
TITLES = {
    "F1": "Armed Bank Robbery", "F2": "Aggravated Assault", "F3": "Murder Investigation",
    "F4": "Drug Trafficking", "F5": "Cyber Crime",
    "O1": "Kidnapping Case", "O2": "Money Laundering", "O3": "Vehicle Theft",
    "O4": "Identity Theft", "O5": "Puerto Rico case",
    "P1": "Shooting Incident", "P2": "Prosecuted tax case", "P3": "Terrorist cell",
    "P4": "Hacking",
}
# Customer segment -> description.
DESCRIPTIONS = {
    "AUTOMOBILE": "Suspect struck victim with baseball bat",
    "BUILDING": "Residence broken into while owners were away",
    "FURNITURE": "Suspect threatened victim with knife",
    "HOUSEHOLD": "Handgun recovered at scene",
}
# Nation key -> place of birth; the last two have none or an unknown one.
PLACES = [
    "Los Angeles, CA", "Houston, TX", "Miami, FL", "Albany, NY", "Philadelphia, PA",
    "Chicago, IL", "Columbus, OH", "Atlanta, GA", "Raleigh, NC", "Detroit, MI",
    "Seattle, WA", "Phoenix, AZ", "Boston, MA", "Nashville, TN", "Denver, CO",
    "Portland, OR", "Reno, NV", "Boise, ID", "Toronto, Canada", "Lima, Peru",
    "Juneau, AK", "Dover, DE", "Bogota", "", None,
]
# Part type -> offense.
OFFENSES = {
    "ECONOMY": "robbery", "LARGE": "larceny", "MEDIUM": "fraud",
    "PROMO": "identity_theft", "SMALL": "drug_trafficking", "STANDARD": "other_offenses",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_notices(spark: SparkSession, sf: str, position: bool = False) -> DataFrame:
    """Notices as a source would deliver them, nested subject included; ``position``: with the place of their order in its file."""
    o = table(spark, sf, "orders")
    o = with_row_position(o) if position else o
    c = table(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).selectExpr(
        "concat('N', o_orderkey) AS uid",
        f"try_element_at({map_sql(TITLES)}, concat(o_orderstatus, substring(o_orderpriority, 1, 1))) AS title",
        f"try_element_at({map_sql(DESCRIPTIONS)}, c_mktsegment) AS description",
        "c_name AS name",
        f"get({array_sql(PLACES)}, c_nationkey) AS place_of_birth",
        "array(concat('alias ', c_name)) AS aliases",
        "CAST(o_orderdate AS TIMESTAMP) AS publication_date",
        "timestamp_seconds(unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + pmod(o_orderkey * 104729, 100000000)) AS modified_date",
        "CASE WHEN o_totalprice > 250000 THEN concat('$', floor(o_totalprice / 10)) WHEN o_totalprice > 200000 THEN '' END "
        "AS reward_text",
        "CASE pmod(o_orderkey, 3) WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array(concat('img', o_orderkey)) END "
        "AS images",
        *(["_file", "_row"] if position else []),
    )


def notices(spark: SparkSession, sf: str, position: bool = False) -> DataFrame:
    """Flat notices with the batch stamp and case age."""
    return raw_notices(spark, sf, position).withColumn("ingestion_date", F.lit(INGESTED).cast("timestamp")).withColumn(
        "case_age_days", floor_days(F.col("ingestion_date"), F.col("publication_date"))
    )


def features(spark: SparkSession, sf: str, position: bool = False) -> DataFrame:
    return engineer_features(notices(spark, sf, position))


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline records: lines per shipping year, part type and return flag."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    records = (
        li.join(p, li["l_partkey"] == p["p_partkey"])
        .groupBy(F.year("l_shipdate").alias("year"), "l_returnflag", "p_type")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("l_quantity").alias("_quantity"))
        .select(
            "year", F.col("l_returnflag").alias("state"), lookup(F.col("p_type"), OFFENSES).alias("offense_type"),
            "count", (F.col("_quantity") / 1000.0).alias("rate_per_100k"),
        )
    )
    return standardize_baseline(records)


def customers_per_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Cases and size per nation: customers against suppliers."""
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    cases = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("observed_cases"))
    size = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("population_millions"))
    return (
        n.join(cases, n["n_nationkey"] == cases["c_nationkey"], "left")
        .join(size, n["n_nationkey"] == size["s_nationkey"], "left")
        .select(F.col("n_name").alias("unit"), F.coalesce("observed_cases", F.lit(0)).alias("observed_cases"),
                "population_millions")
    )
