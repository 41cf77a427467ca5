"""Landed pages, baseline folders, stored tables, CSV and JSON files."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from registry import tables as R
from skewlens import run_audit, shared_folder
from skewlens.operators import features as feat
from skewlens.operators import results as res
from skewlens.sources import baseline as src_baseline
from skewlens.sources import files, notices as src_notices
from skewlens.sources.commits import CommitLog
from skewlens.sources.tables import TableStore

AT = datetime(2023, 12, 1)


def test_page_files(spark, tmp_path):
    items = [
        {"uid": "a", "title": "T", "publication": "2023-01-15T00:00:00", "modified": "bad", "images": ["i"],
         "subjects": [{"name": "N", "date_of_birth": "June 20, 1985", "place_of_birth": "Houston, TX", "weight": "180"}, {"name": "second"}]},
        {"uid": "b", "publication": None, "subjects": [], "reward_text": ""},
    ]
    (tmp_path / "1.json").write_text(json.dumps({"items": items}, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"items": []}))
    (tmp_path / "3.json").write_text(json.dumps({"other": 1}))
    flat = src_notices.flatten_notices(src_notices.read_notice_pages(spark, str(tmp_path)), AT).orderBy("uid").collect()
    a, b = flat
    assert (a.name, a.weight, str(a.date_of_birth), a.aliases, a.case_age_days) == ("N", "180", "1985-06-20", [], 320)
    assert a.modified_date is None and a.images == ["i"] and a.files == []
    assert (b.name, b.aliases, b.case_age_days, b.images, b.reward_text, b.subjects) == (None, None, None, [], "", [])
    assert a.ingestion_date == AT


def test_flat_notices_engineer(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"items": [{"uid": "a", "title": "Armed Robbery", "publication": "2023-06-20"}]}))
    row = feat.engineer_features(src_notices.flatten_notices(src_notices.read_notice_pages(spark, str(tmp_path)), AT)).first()
    assert (row.crime_family, row.weapon_category, row.birth_state, row.birth_region, row.has_images) == ("Violent", "firearm", None, "Other", False)


def test_baseline_folders(spark, tmp_path):
    for year, offense in ((2021, "Computer_Fraud"), (2022, "arson"), (2023, "jaywalking")):
        folder = tmp_path / f"year={year}"
        folder.mkdir()
        (folder / "p.json").write_text(json.dumps({"data": [{"state": "CA", "offense_type": offense, "count": 3, "rate_per_100k": 1.5}]}))
    got = {r.year: r.crime_family for r in src_baseline.read_baseline(spark, str(tmp_path)).collect()}
    assert got == {2021: "white_collar", 2022: "property_crime", 2023: "other"}  # 'fraud' comes before 'computer_fraud'
    two = src_baseline.read_baseline(spark, str(tmp_path), years=[2021, 2023])
    assert {r.year for r in two.collect()} == {2021, 2023}
    assert "PartitionFilters: [year" in two._jdf.queryExecution().executedPlan().toString()


def test_store(spark, sf):
    store = TableStore(spark, shared_folder(spark))
    assert not store.exists("wanted_persons")
    store.create_tables()
    store.create_tables()
    assert store.load_wanted().count() == 0 and store.load_wanted().columns == store.SCHEMAS["wanted_persons"].names
    f = R.features(spark, sf)
    n = f.count()
    store.save_wanted(f)
    with pytest.raises(ValueError, match="stored already"):
        store.save_wanted(f)
    store.save_wanted(f.where("uid <= 'n5'"), known="skip")
    assert store.load_wanted().count() == n
    for bad in (f.limit(3).unionByName(f.limit(3)), f.limit(3).withColumn("uid", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="without a uid"):
            store.save_wanted(bad)
    store.save_wanted(f, "replace")
    loaded = store.load_wanted({"publication_year": [1996], "crime_family": "Violent"})
    assert loaded.count() == f.where("publication_year = 1996 and crime_family = 'Violent'").count() > 0
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(crime_family,Violent)" in plan and "PartitionFilters: [isnotnull(publication_year" in plan
    with pytest.raises(AnalysisException):
        store.save_wanted(f, "fail")
    store.save_baseline(R.baseline(spark, sf))
    assert store.load_baseline({"state": ["R"]}).where("id is null or source is not null").count() == 0
    store.save_baseline(R.baseline(spark, sf))
    ids = store.load_baseline().agg(F.count("id").alias("n"), F.count_distinct("id").alias("d")).first()
    assert ids.n == ids.d == 2 * R.baseline(spark, sf).count()


def _few(spark, uids, year=2020):
    rows = [(u, f"title {u}", year) for u in uids]
    return spark.createDataFrame(rows, "uid string, title string, publication_year int")


def test_competing_saves_store_a_uid_once(spark):
    root = shared_folder(spark)
    stores = [TableStore(spark, root) for _ in range(4)]
    stores[0].create_tables()

    def save(i):
        try:
            stores[i % 4].save_wanted(_few(spark, ["same", f"own{i}"]), known="skip" if i % 2 else "refuse")
            return "saved"
        except ValueError as e:
            return str(e)

    with ThreadPoolExecutor(6) as pool:
        said = list(pool.map(save, range(6)))
    uids = [r.uid for r in stores[1].load_wanted().collect()]
    assert uids.count("same") == 1 and len(uids) == len(set(uids))
    assert {"own1", "own3", "own5"} <= set(uids) and said[1::2] == ["saved"] * 3
    for i in (0, 2, 4):
        assert (said[i] == "saved") == (f"own{i}" in uids) and (said[i] == "saved" or "stored already" in said[i])


def test_a_save_between_test_and_commit_is_seen(spark, monkeypatch):
    """The writer that loses the race for a number tests what has been committed meanwhile."""
    root = shared_folder(spark)
    ours, theirs = TableStore(spark, root), TableStore(spark, root)
    ours.create_tables()
    first = CommitLog.try_commit

    def late(log, version, manifest):
        monkeypatch.setattr(CommitLog, "try_commit", first)
        theirs.save_wanted(_few(spark, ["a", "b"]))
        return first(log, version, manifest)

    monkeypatch.setattr(CommitLog, "try_commit", late)
    with pytest.raises(ValueError, match="stored already"):
        ours.save_wanted(_few(spark, ["b", "c"]))
    monkeypatch.setattr(CommitLog, "try_commit", late)
    theirs, both = TableStore(spark, root), _few(spark, ["c", "d"])
    monkeypatch.setattr(theirs, "save_wanted", lambda _: TableStore(spark, root).save_wanted(_few(spark, ["c"])))
    ours.save_wanted(both, known="skip")
    assert sorted(r.uid for r in ours.load_wanted().collect()) == ["a", "b", "c", "d"]


def test_refused_and_failed_saves_leave_the_table(spark):
    store = TableStore(spark, shared_folder(spark))
    with pytest.raises(ValueError, match="not been created"):
        store.load_wanted()
    store.save_wanted(_few(spark, ["a"]))
    for bad in (["a", "x"], ["y", "y"], [None]):
        with pytest.raises(ValueError):
            store.save_wanted(_few(spark, bad))
    broken = _few(spark, ["z"]).withColumn("title", F.raise_error(F.lit("no title")).cast("string"))
    with pytest.raises(Exception, match="no title"):
        store.save_wanted(broken)
    assert [r.uid for r in store.load_wanted().collect()] == ["a"]
    with pytest.raises(ValueError, match="if_exists"):
        store.save_wanted(_few(spark, ["q"]), "upsert")
    store.save_wanted(_few(spark, []))
    store.save_wanted(_few(spark, ["a"]), known="skip")
    store.save_wanted(_few(spark, ["b"]), "replace")
    assert [r.uid for r in store.load_wanted().collect()] == ["b"]


def test_a_save_derives_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    store, df = TableStore(spark, shared_folder(spark)), _few(spark, [f"u{i}" for i in range(40)])
    store.save_wanted(df.mapInArrow(count, df.schema))
    assert seen.value == 40
    store.save_wanted(_few(spark, ["u1", "v"]).mapInArrow(count, df.schema), known="skip")
    assert seen.value == 42 and store.load_wanted().count() == 41


def test_an_append_reads_its_own_key_buckets(spark):
    store = TableStore(spark, shared_folder(spark))
    store.save_wanted(_few(spark, [f"u{i}" for i in range(4000)]))
    batch = store._live(store._log("wanted_persons").entries())
    index, seen = store._index(store._stage(_few(spark, ["u7"]), "wanted_persons"))
    assert (seen["keys"], seen["bad"], len(seen["buckets"])) == (1, 0, 1)
    known = store._known(index, seen["buckets"], batch)
    assert [r.uid for r in known.collect()] == ["u7"]
    assert "PushedFilters: [IsNotNull(bucket), EqualTo(bucket" in known._jdf.queryExecution().executedPlan().toString()
    there = store._keys(batch)
    in_order = [r.bucket for r in there.select("bucket", F.input_file_name().alias("f")).collect()]
    assert set(in_order) == set(range(store.KEY_BUCKETS)) and sum(a > b for a, b in zip(in_order, in_order[1:])) < 8  # files are in order
    all_keys, own = there.count(), there.where(F.col("bucket").isin(seen["buckets"]))
    assert all_keys == 4000 and own.count() < 2 * 4000 / store.KEY_BUCKETS


def _rows_scanned(df):
    """Rows that the scans hand on: those of the row groups and pages that the filters could not rule out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_loads_by_key_skip_row_groups(spark, monkeypatch):
    monkeypatch.setattr(TableStore, "ROW_GROUP_BYTES", 1 << 14)
    store, n = TableStore(spark, shared_folder(spark)), 40_000
    rows = spark.range(n).select(
        F.md5(F.col("id").cast("string")).alias("uid"), F.lit(2020).alias("publication_year"),
        F.get(F.array(*map(F.lit, ["CA", "TX", "NY", "FL", "WA", "OH", "GA", "MI"])), F.pmod(F.hash("id"), F.lit(8))).alias("birth_state"),
        F.get(F.array(*map(F.lit, ["Violent", "Other"])), F.pmod(F.hash("id", F.lit(1)), F.lit(2))).alias("crime_family"),
        F.sha2(F.col("id").cast("string"), 512).alias("description"))
    store.save_wanted(rows)
    one = store.load_wanted({"uid": "d9d4f495e875a2e075a1a4a6e1b9770f"})  # md5 of 46
    assert [r.uid for r in one.collect()] == ["d9d4f495e875a2e075a1a4a6e1b9770f"]
    assert _rows_scanned(store.load_wanted()) == n and _rows_scanned(one) < 0.05 * n
    assert _rows_scanned(store.load_wanted({"uid": "no such notice"})) < 0.05 * n
    some = store.load_wanted({"birth_state": ["GA", "OH"], "crime_family": "Other"})
    assert 0 < some.count() <= _rows_scanned(some) < 1.5 * some.count() + 0.05 * n


def test_manifests_on_another_file_system(spark, tmp_path, monkeypatch):
    """The way taken where folders are not local, on Spark's own file system classes."""
    from skewlens.sources import commits

    monkeypatch.setattr(commits, "_local", lambda _: None)
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.entries() == []
    assert log.try_commit(1, {"batch": "a"}) and not log.try_commit(1, {"batch": "b"}) and log.try_commit(2, {"batch": "c"})
    assert log.entries(1) == [{"batch": "c", "version": 2}]
    assert [e["batch"] for e in CommitLog(spark, str(tmp_path / "log")).entries()] == ["a", "c"]


def test_history(spark):
    store = TableStore(spark, shared_folder(spark))
    store.create_tables()
    row = spark.createDataFrame(
        [("Case Persistence", 0.0, 1.0, False, "text", 10, 0.95)],
        "analysis_type string, test_statistic double, p_value double, significant boolean, interpretation string, sample_size long, confidence_level double",
    )
    for day in (1, 3, 2):
        store.save_results(res.stored_results(row, datetime(2024, 1, day)))
    got = store.analysis_history().collect()
    assert [r.analysis_date.day for r in got] == [3, 2, 1]
    assert got[0].test_statistic == 0.0 and json.loads(got[0].metadata)["p_value"] == 1.0 and got[0].sample_size == 10


def test_csv_keeps_lists_empties_and_line_ends(spark, tmp_path):
    rows = [("a", 'He said "x",\nthen left\r\\n \\b \\', "", [], True), ("b", None, None, ["i", "j,k"], False), ("c", "plain", "$5", None, None)]
    df = spark.createDataFrame(rows, "uid string, description string, reward_text string, images array<string>, has_images boolean")
    df = df.withColumn("publication_date", F.to_timestamp(F.lit("2023-01-15 10:11:12.123456"))).withColumn("extra", F.lit(1))
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_feature_csv(spark, str(tmp_path / "out")).orderBy("uid").collect()
    assert [tuple(r)[:5] for r in back] == rows
    assert max(len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("*.csv")) <= 1 + len(rows)
    (tmp_path / "foreign.csv").write_text('uid,description\n"a","one\ntwo \\n"\n')
    assert files.read_feature_csv(spark, str(tmp_path / "foreign.csv"), line_ends=True).first().description == "one\ntwo \\n"
    assert back[0].publication_date == datetime(2023, 1, 15, 10, 11, 12, 123456) and back[0].extra == "1"


def test_json_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    files.write_json({"t": df}, str(tmp_path))
    assert {tuple(r) for r in spark.read.schema("a long, b string").json(f"{tmp_path}/t").collect()} == {(1, None), (2, "x")}


def test_combined_sources(spark):
    a = spark.createDataFrame([(1, "x")], "id long, kind string")
    b = spark.createDataFrame([(2,)], "key long")
    got = src_baseline.combine_sources({"a": a, "b": b}, {"a": {"id": "id", "kind": "upper(kind)"}, "b": {"id": "key"}})
    assert {tuple(r) for r in got.select("id", "kind", "source").collect()} == {(1, "X", "a"), (2, None, "b")}


def test_audit_equals_the_lazy_analyses(spark, sf):
    from skewlens import analyze_features

    notices, baseline = R.notices(spark, sf), R.baseline(spark, sf)
    stored = run_audit(notices, baseline, shared_folder(spark))
    lazy = analyze_features(R.features(spark, sf), baseline)
    assert set(stored) == set(lazy)
    for name in ("geographic.test", "temporal.trend", "persistence.test", "weapons.summary", "categorical.test", "report.overview"):
        def rounded(table):
            return sorted(
                tuple(round(v, 8) if isinstance(v, float) else v for v in row) for row in table[name].collect()
            )
        assert rounded(stored) == rounded(lazy), name


def test_stored_cube_does_not_read_the_text(spark, sf, tmp_path):
    from skewlens.operators.counts import case_cube, flag_missing_text

    path = str(tmp_path / "features")
    flag_missing_text(R.features(spark, sf)).write.parquet(path)
    plan = case_cube(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "weapon_raw" not in plan and "description" not in plan


def test_shared_folder_is_never_guessed_on_a_cluster(spark, monkeypatch):
    from skewlens import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            applicationId = "app-x"
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    Session.sparkContext.master = "local[4]"
    assert session.shared_folder(Session()).rsplit("/", 1)[0] == session.shared_folder(Session()).rsplit("/", 1)[0]
    assert session.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
