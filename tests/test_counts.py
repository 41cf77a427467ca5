"""Counts, shares, grids and one-row summaries."""

import pytest
from pyspark.sql import functions as F

from registry import tables as R
from skewlens.operators import counts as cnt
from skewlens.operators import joins


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", 2020), ("a", 2020), ("a", 2021), ("b", 2021), ("c", 2022), (None, 2022), ("b", None)]
    return spark.createDataFrame(rows, "label string, year int").cache()


def _map(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_nulls_are_dropped_but_count_in_the_base(small):
    assert _map(cnt.label_counts(small, "label"), "label", "n") == {"a": 3, "b": 2, "c": 1}
    assert _map(cnt.distribution(small, "label"), "label", "proportion") == {"a": 3 / 7, "b": 2 / 7, "c": 1 / 7}
    assert _map(cnt.distribution(small, "label", over="known"), "label", "proportion") == {"a": 0.5, "b": 2 / 6, "c": 1 / 6}


def test_ties_and_limits(small):
    assert [r.label for r in cnt.ranked(cnt.label_counts(small, "label"), "label", 2).collect()] == ["a", "b"]
    counts = small.sparkSession.createDataFrame([("x", 2), ("y", 2), ("z", 1), ("w", 1)], "label string, n long")
    row = cnt.extremes(counts, "label").first()
    assert (row.most_common, row.least_common) == ("x", "z")
    empty = cnt.extremes(counts.where("n > 9"), "label").first()
    assert (empty.most_common, empty.least_common) == ("unknown", "unknown")


LABELS = ["a", "b", "c", "never"]


def test_two_way_is_zero_filled_over_declared_labels(small):
    got = {(r.year, r.label): (r.n, r.share) for r in cnt.two_way(small, "year", "label", normalize="row", labels=LABELS).collect()}
    assert len(got) == 9 and got[(2020, "a")] == (2, 1.0) and got[(2020, "b")] == (0, 0.0) and got[(2021, "a")] == (1, 0.5)
    columns = {(r.year, r.label): r.share for r in cnt.two_way(small, "year", "label", normalize="column", labels=[2020, 2021, 2022]).collect()}
    assert columns[(2020, "a")] == 2 / 3 and columns[(2021, "b")] == 1.0 and columns[(2022, "b")] == 0.0
    some = {(r.year, r.label): r.n for r in cnt.two_way(small, "year", "label", labels=["b"]).collect()}
    assert some == {(2020, "a"): 2, (2021, "a"): 1, (2021, "b"): 1, (2022, "c"): 1, (2020, "b"): 0, (2022, "b"): 0}


def test_sparse_table_holds_the_same(small):
    sparse = {(r.year, r.label): r.share for r in cnt.two_way(small, "year", "label", normalize="row").collect()}
    full = {(r.year, r.label): r.share for r in cnt.two_way(small, "year", "label", normalize="row", labels=LABELS).collect() if r.n}
    assert sparse == full and len(sparse) == 4


def test_thirty_thousand_labels(spark):
    df = spark.range(60_000).selectExpr("cast(id % 2 as int) AS year", "concat('l', id % 30000) AS label")
    table = cnt.two_way(df, "year", "label", normalize="row")
    assert table.count() == 30_000 and table.where("n = 2").count() == 30_000
    assert "raise_error" not in table._jdf.queryExecution().analyzed().toString()


def test_cube_rolls_up_to_direct_counts(spark, sf):
    f = R.features(spark, sf)
    cube = cnt.case_cube(f).cache()
    for key in ("crime_family", "birth_state", "weapon_category"):
        assert _map(cnt.distribution(f, key), key, "proportion") == _map(cnt.distribution(cube, key, "n"), key, "proportion")
    direct, rolled = cnt.overview(f).first(), cnt.overview_from_cube(cube).first()
    assert direct == rolled
    assert cnt.severity_metrics(f).first() == cnt.severity_metrics(cube, weight="n").first()
    assert cnt.concentration(f).first() == cnt.concentration(cube, weight="n").first()


def test_shares_sum_to_one(spark, sf):
    f = R.features(spark, sf)
    for normalize, key in (("row", "birth_region"), ("column", "crime_family")):
        sums = cnt.two_way(f, "birth_region", "crime_family", normalize=normalize).groupBy(key).agg(F.sum("share").alias("s"))
        assert all(abs(r.s - 1) < 1e-12 for r in sums.collect())


def test_empty_input(small):
    none = small.where("year > 3000")
    assert cnt.distribution(none, "label").count() == 0
    assert cnt.two_way(none, "year", "label").count() == 0
    metrics = cnt.severity_metrics(none.selectExpr("true as severity_flag", "label as weapon_category")).first()
    assert (metrics.total_cases, metrics.serious_percentage, metrics.unknown_percentage) == (0, 0.0, 0.0)


def test_distinct_labels(small):
    exact = cnt.distinct_labels(small, ["label", "year"]).first()
    assert (exact.label, exact.year) == (3, 3)
    rough = cnt.distinct_labels(small, ["label", "year"], approximate=True).first()
    assert (rough.label, rough.year) == (3, 3)


def test_completeness_and_share_by(spark):
    df = spark.createDataFrame([(2020, "unknown"), (2020, "gun"), (2021, None), (2021, "none")], "publication_year int, weapon_category string")
    assert _map(cnt.weapon_completeness(df), "category", "n") == {"Known Weapons": 2, "Unknown Weapons": 1, "No Weapon": 1}
    by = cnt.label_share_by(df, "publication_year", "weapon_category", "unknown")
    assert _map(by, "publication_year", "percentage") == {2020: 50.0, 2021: 0.0}


def test_alignments(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, l double")
    right = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "k string, r double")
    assert {tuple(r) for r in joins.align_union(left, right, "k", {"l": "r"}).collect()} == {("a", 1.0, 0.0), ("b", 2.0, 3.0), ("c", 0.0, 4.0)}
    assert [tuple(r) for r in joins.align_common(left, right, "k").collect()] == [("b", 2.0, 3.0)]
    other = right.withColumnRenamed("r", "l")
    assert {(r.k, r._other, r.ratio) for r in joins.compare_shares(left, other, "k", "l").collect()} == {("a", 0.0, None), ("b", 3.0, 2 / 3)}


def test_roll_up_counts_every_set_in_one_shuffle(small):
    sets = (("label", "year"), ("year",), ("label",), ())
    rolled = cnt.roll_up(small, sets)
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Expand") == 1
    got = {(r.level, r.label, r.year): r.n for r in rolled.collect()}
    rows = [tuple(r) for r in small.collect()]
    want = {("", None, None): len(rows)}
    for label, year in rows:
        for key in (("label,year", label, year), ("year", None, year), ("label", label, None)):
            want[key] = sum(1 for a, b in rows if (key[0] == "year" or a == label) and (key[0] == "label" or b == year))
    assert got == want
    again = cnt.roll_up(small.groupBy("label", "year").agg(F.count("*").alias("n")), sets, "n")
    assert {(r.level, r.label, r.year): r.n for r in again.collect()} == want


def test_charts_of_one_pass_equal_those_made_one_by_one(spark, sf):
    from skewlens.plans import datasets as d

    f = R.features(spark, sf)
    tables = d.chart_tables(f)
    single = {
        "temporal_series": d.temporal_series(f), "region_by_family": d.region_by_family(f), "weapon_yearly": d.weapon_yearly(f),
        "weapon_by_region": d.weapon_by_region(f), "unknown_weapons_by_year": d.unknown_weapons_by_year(f),
        "category_distribution": d.category_distribution(f), "weapon_distribution": d.weapon_distribution(f),
        "top_states_with_share": d.top_states_with_share(f), "years": cnt.row_counts(f, "publication_year"),
    }
    for name, table in single.items():
        assert sorted(map(tuple, tables[name].collect())) == sorted(map(tuple, table.collect())), name
    assert tables["total"].collect() == [(f.count(),)]
    assert sum(r.n for r in tables["years"].collect()) == sum(r.n for r in tables["families"].collect()) == f.count()
    assert all("/chart_counts/" in p for t in tables.values() for p in t.inputFiles())


def test_sketches_merge_and_keep_their_error(spark):
    n = 60_000
    df = spark.range(n).select(
        F.concat(F.lit("c"), F.pmod(F.hash("id"), F.lit(20_000))).alias("who"), (F.col("id") % 5).alias("year"), (F.col("id") % 3).alias("kind"),
        (F.col("id") % 40).cast("double").alias("few"))
    cube = cnt.sketched_counts(df, ["year", "kind"], ["who", "few"])
    exact = {r.year: (r.n, r.who, r.few) for r in df.groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("who").alias("who"), F.countDistinct("few").alias("few")).collect()}
    for table in (cube, cnt.merged_sketches(cube, ["year", "kind"], ["who", "few"]), cube.where("kind < 2").unionByName(cube.where("kind = 2"))):
        for r in cnt.distinct_estimates(table, ["year"], ["who", "few"]).collect():
            n_rows, who, few = exact[r.year]
            assert r.n == n_rows and abs(r.who - who) <= r.distinct_error * who and r.few == few
    assert 0.04 < r.distinct_error < 0.05
    assert cnt.distinct_estimates(cube, [], ["who"]).first().who == pytest.approx(df.select("who").distinct().count(), rel=r.distinct_error)


def test_order_of_appearance_does_not_depend_on_partitions(spark, tmp_path):
    from skewlens.sources.files import with_row_position

    labels = ["z", "b", "q", "a", "m"]
    rows = [(labels[min(4, (i * i) // 5000)], i) for i in range(400)] + [(None, 400)]
    spark.createDataFrame(rows, "label string, i int").coalesce(1).sortWithinPartitions("i").write.parquet(str(tmp_path / "t"))
    df = with_row_position(spark.read.parquet(str(tmp_path / "t")))
    seen = list(dict.fromkeys(r for r, _ in rows if r))
    for parts in (1, 5):
        counted = cnt.appearance_counts(df.repartition(parts), "label")
        assert [r.label for r in cnt.ranked(counted, "label", order="appearance").collect()] == seen
        assert {r.label: r.n for r in counted.collect()} == {x: sum(1 for a, _ in rows if a == x) for x in seen}
    assert [r.label for r in cnt.ranked(counted, "label", 2, "appearance").collect()] == seen[:2]
    with pytest.raises(ValueError):
        cnt.ranked(counted, "label", order="name")


def test_sketches_hold_their_error_where_keys_fall_badly(spark, tmp_path):
    """F1: 30,000 keys whose sketch of 2^12 bytes is 5.5 % off, order keys met twice, and orders without a date: as the SQL has it."""
    from collections import Counter
    from functools import reduce

    import duckdb
    from pyspark.sql import DataFrame

    from registry.oracles import ORACLES
    from registry.queries import QUERIES

    keys = spark.range(659, 1500 * 30_000, 1500, 8).select(
        F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.array(F.lit("F"), F.lit("O"))[(F.col("id") % 2).cast("int")].alias("o_orderstatus"),
        F.lit("1-URGENT").alias("o_orderpriority"), F.lit("1996-05-05").cast("timestamp_ntz").alias("o_orderdate"))
    again = keys.where("o_orderkey < 4500000").withColumn("o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"))
    undated = keys.where("o_orderkey < 750000").withColumn("o_orderdate", F.lit(None).cast("timestamp_ntz"))
    reduce(DataFrame.unionByName, [keys, again, again, undated]).write.parquet(path := f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    want = db.execute(ORACLES["customers_from_sketches"]).fetchall()
    assert Counter(map(tuple, QUERIES["customers_from_sketches"](spark, str(tmp_path)).collect())) == Counter(want) and len(want) == 3
