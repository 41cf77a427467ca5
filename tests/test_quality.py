"""Validation, duplicates, anonymisation, retention: also with one key holding most rows."""

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from skewlens.operators import quality as qual


def _rows(spark):
    rows = [("hot", "t", datetime(2020, 1, 1 + i % 28), i % 28) for i in range(600)]
    rows += [(f"u{i}", None if i % 3 else "t", datetime(2021, 1, 1), -1) for i in range(300)]
    rows += [(None, "n", None, None)] * 5
    return spark.createDataFrame(rows, "uid string, title string, publication_date timestamp, case_age_days int")


def test_validation(spark):
    got = {r.rule: r.violations for r in qual.validate(_rows(spark)).collect()}
    assert got == {
        "uid not null": 5, "title not null": 200, "publication_date not null": 5, "publication_date is a date": 0,
        "uid is text": 0, "case_age_days is a whole number": 0,
        "case_age_days >= 0": 300, "uid unique": 599,
    }
    text = spark.createDataFrame([("a", "2020-01-01"), ("b", "never")], "uid string, publication_date string")
    got = {r.rule: r.violations for r in qual.validate(text.withColumn("case_age_days", F.lit(1)), types={}).collect()}
    assert got["title missing"] == 2


def test_latest_per_key_of_a_hot_key(spark):
    got = qual.latest_per_key(_rows(spark), order="publication_date")
    assert got.count() == 301 + 5
    assert got.where("uid = 'hot'").first().case_age_days == 27
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan


def test_newest_rows_equal_those_of_the_general_way(spark):
    df = _rows(spark)
    more = [("hot", "tie", datetime(2020, 1, 28), i % 3) for i in range(50)] + [("void", t, None, 1) for t in ("x", "y", "y")]
    df = df.unionByName(spark.createDataFrame(more, df.schema)).withColumn("day", F.to_date("publication_date"))
    df = df.withColumn("ntz", F.col("publication_date").cast("timestamp_ntz")).withColumn("text", F.col("publication_date").cast("string"))

    def found(rows):
        return sorted(map(tuple, rows.collect()), key=str)

    for order in ("publication_date", "day", "ntz", "case_age_days", "text"):
        want = found(qual.latest_per_key(df, order=order))
        for parts in (1, 7):
            got = qual.newest_rows(df.repartition(parts), order=order)
            assert [r[0] for r in found(got)] == [r[0] for r in want]
            best = {r.uid: r[order] for r in got.collect() if r.uid}
            assert best == {r.uid: r[order] for r in qual.latest_per_key(df, order=order).collect() if r.uid}
    one, seven = (found(qual.newest_rows(df.repartition(n), order="publication_date")) for n in (1, 7))
    assert one == seven and len([r for r in one if r[0] is None]) == 5


def test_newest_rows_fold_fixed_widths(spark):
    got = qual.newest_rows(_rows(spark), order="publication_date")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    for no in ("SortAggregate", "ObjectHashAggregate", "Window", "max_by", "Scan ExistingRDD"):
        assert no not in plan, no
    assert "partial_max(_rank" in plan
    assert qual.newest_rows(_rows(spark).limit(0), order="publication_date").collect() == []


def test_duplicates_and_completeness(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "null"), ("b", "x"), ("b", "x"), ("b", "x")], "p string, q string")
    row = qual.quality_metrics(df).first()
    assert (row.records, row.duplicates, row.completeness) == (6, 3, 10 / 12)
    assert qual.distinct_rows(df).count() == 3
    assert {r.column_name: r.completeness for r in qual.column_completeness(df).collect()} == {"p": 1.0, "q": 4 / 6}
    assert {r.p: r.n for r in qual.duplicated_keys(df, "p").collect()} == {"a": 3, "b": 3}


def test_standardize_anonymize_retain(spark):
    df = spark.createDataFrame([("  a \t\n b ", " ca ", "Ann", ["x", None], datetime(2023, 1, 1))],
                               "t string, state string, name string, aliases array<string>, publication_date timestamp")
    row = df.transform(qual.standardize_text, ["t"]).transform(qual.standardize_states).transform(qual.anonymize).first()
    assert (row.t, row.state) == ("a b", "CA")
    assert row.name == hashlib.sha256(b"Ann").hexdigest() and row.aliases == [hashlib.sha256(b"x").hexdigest(), None]
    assert qual.retained(df, datetime(2024, 1, 1)).count() == 1 and qual.retained(df, datetime(2024, 1, 2)).count() == 0


def test_unreadable_values_are_counted_not_raised(spark):
    rows = [("1", "2020-01-02", "5"), ("2", "01/31/2020", "5.5"), ("3", "no date", "five"), ("4", "March 3, 2020", None), (None, None, "-7"), ("1", "2020-13-45", "1e3")]
    df = spark.createDataFrame(rows, "uid string, publication_date string, case_age_days string")
    got = {r.rule: r.violations for r in qual.validate(df).collect()}
    assert got == {
        "uid not null": 1, "title missing": 6, "publication_date not null": 1, "uid is text": 0, "publication_date is a date": 2,
        "case_age_days is a whole number": 2, "case_age_days >= 0": 1, "uid unique": 1,
    }
    wrong = spark.createDataFrame([(1, 2, 3.5)], "uid int, publication_date int, case_age_days double")
    got = {r.rule: r.violations for r in qual.validate(wrong, required=()).collect()}
    assert [got[k] for k in ("uid is text", "publication_date is a date", "case_age_days is a whole number")] == [1, 1, 1]
    assert {r.violations for r in qual.validate(df.limit(0)).collect()} == {0}


def test_quality_reads_once(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    for df in (qual.quality_metrics(d), qual.validate(d.withColumnRenamed("text", "uid"), required=("uid",), minimum=("lang", 0))):
        assert df._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
