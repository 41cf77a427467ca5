"""Golden rows of the text, place, date and activity rules."""

from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skewlens import constants as K
from skewlens.functions.dates import floor_days, parse_timestamp
from skewlens.functions.text import deciding_words, title_label
from skewlens.operators import features as feat

# title, description, family, weapon, severity
TEXTS = [
    ("Armed Bank Robbery", "entered bank with handgun", "Violent", "firearm", True),
    ("Aggravated Assault", "attacked with knife", "Violent", "knife", True),
    ("Murder Investigation", "gunshot wounds", "Violent", "firearm", True),
    ("Assault with Weapon", "struck with baseball bat", "Violent", "firearm", True),
    ("Kidnapping Case", "abducted at gunpoint", "Violent", "firearm", True),
    ("Drug Trafficking", "narcotics seized", "Drug Related", "unknown", False),
    ("Cyber Crime", "Computer fraud scheme", "White Collar", "unknown", False),
    ("Identity Theft", "stolen personal information", "Cyber Crime", "unknown", False),
    ("Robbery Investigation", "theft by unknown suspect", "Violent", "unknown", True),
    ("Assault Case", "injured during fight", "Violent", "unknown", True),
    ("Vandalism", "property damage", "Other", "unknown", False),
    ("Robbery", "suspect was unarmed", "Violent", "firearm", True),
    ("Robbery", "no weapon seen", "Violent", "firearm", True),
    ("Prosecuted tax case", "x", "Other", "knife", False),
    ("Puerto Rico case", "x", "Organized Crime", "unknown", False),
    ("Combat veteran sought", "x", "Other", "blunt_object", False),
    ("Hacking", "drug conspiracy", "Drug Related", "unknown", False),
    (None, None, "Other", "unknown", False),
    ("Abduction", None, "Other", "unknown", True),
    ("Fraud", "linked to terrorism", "White Collar", "unknown", True),
    ("Terrorist cell", "", "Terrorism", "unknown", True),
]

PLACES = [
    ("Los Angeles, CA", "CA", 39.5, "West"), ("Houston, TX", "TX", 29.1, "Southwest"), ("Chicago, IL", "CA", 39.5, "West"),
    ("Dallas, TX", "AL", 5.0, "Southeast"), ("Philadelphia, PA", "DE", 1.0, "Other"), ("Miami, Florida", "FL", 21.5, "Southeast"),
    ("Washington, DC", "HI", 1.4, "West"), ("Toronto, Canada", "CA", 39.5, "West"), ("Bogota", "UNKNOWN", None, "Other"),
    ("Lima, Peru", "MA", 7.0, "Northeast"), ("", "UNKNOWN", None, "Other"), (None, None, None, "Other"),
]


def test_text_rules(spark):
    df = spark.createDataFrame([(i, t, d) for i, (t, d, *_) in enumerate(TEXTS)], "i int, title string, description string")
    got = feat.add_text_rules(df).orderBy("i").collect()
    for row, (_, _, family, weapon, serious) in zip(got, TEXTS, strict=True):
        assert (row.crime_family, row.weapon_category, row.severity_flag, row.public_notice_flag) == (family, weapon, serious, True), row
    assert got[17].weapon_raw == "none none"


def test_places(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PLACES)], "i int, place_of_birth string")
    got = feat.add_geography(df).orderBy("i").collect()
    assert [(r.place_of_birth, r.birth_state, r.birth_state_population, r.birth_region) for r in got] == PLACES


def _naive(text, taxonomy, default):
    return next((label for label, words in taxonomy if any(w in text for w in words)), default)


_ALL = [w for tax in (K.CRIME_FAMILIES, K.WEAPONS) for _, ws in tax for w in ws] + K.SERIOUS_PHRASES
_PIECES = st.lists(st.one_of(st.sampled_from(_ALL), st.text("abcdefgnrstuw .-2459", max_size=5)), max_size=6).map("".join)


@settings(max_examples=500, deadline=None)
@given(_PIECES)
def test_deciding_words_label_alike(text):
    for taxonomy in (K.CRIME_FAMILIES, K.WEAPONS, K.BASELINE_FAMILIES):
        assert _naive(text, taxonomy, "-") == _naive(text, deciding_words(taxonomy), "-")


def test_severity_shortcut_equals_full_list(spark):
    words = [w for w in _ALL] + [a + " " + b for a in K.SERIOUS_PHRASES for b in ("fraud", "hacking", "x")]
    df = spark.createDataFrame([(w, "") for w in words], "title string, description string")
    for row in feat.add_text_rules(df).collect():
        text = f"{row.title} ".lower()
        full = any(p in text for p in K.SERIOUS_PHRASES) or _naive(text, K.CRIME_FAMILIES, "Other") in K.SERIOUS_FAMILIES
        assert row.severity_flag == full, row.title


def test_unreachable_labels():
    assert [label for label, _ in deciding_words(K.WEAPONS)] == ["firearm", "knife", "blunt_object"]


def test_floor_days(spark):
    pairs = [
        (datetime(2024, 1, 2, 1), datetime(2024, 1, 1, 23), 0), (datetime(2024, 1, 1, 22), datetime(2024, 1, 2, 0), -1),
        (datetime(2024, 1, 2), datetime(2024, 1, 1), 1), (datetime(2023, 12, 1), datetime(2023, 1, 15), 320), (None, datetime(2024, 1, 1), None),
    ]
    df = spark.createDataFrame(pairs, "a timestamp, b timestamp, want int")
    assert all(r.got == r.want for r in df.withColumn("got", floor_days(F.col("a"), F.col("b"))).collect())


def test_parse_timestamp(spark):
    texts = ["2023-01-15T00:00:00", "2023-01-16", "01/17/2023", "January 18, 2023", "no date", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in df.withColumn("d", parse_timestamp(F.col("t"))).orderBy("i").collect()]
    assert [d and d.day for d in got] == [15, 16, 17, 18, None, None, None]


@pytest.mark.parametrize("days,label", [
    (None, "Unknown"), (-5, "Recent (< 1 month)"), (29, "Recent (< 1 month)"), (30, "Medium (1-12 months)"),
    (364, "Medium (1-12 months)"), (365, "Long (1-5 years)"), (1824, "Long (1-5 years)"), (1825, "Very Long (> 5 years)"),
])
def test_case_age_buckets(spark, days, label):
    df = spark.createDataFrame([(datetime(2023, 5, 6), days)], "publication_date timestamp, case_age_days int")
    row = feat.add_calendar(df).first()
    assert row.case_age_category == label
    assert (row.publication_year, row.publication_quarter, row.publication_month) == (2023, 2, 5)
    assert row.case_age_months == (None if days is None else days / 30.44)


def test_activity(spark):
    at = datetime(2023, 12, 1)
    rows = [
        (1, at, datetime(2023, 11, 20), "$10,000", ["a.jpg"]), (2, at, datetime(2023, 7, 1), None, []),
        (3, at, None, "", None), (4, at, datetime(2023, 12, 5), None, ["b"]),
    ]
    df = spark.createDataFrame(rows, "i int, ingestion_date timestamp, modified_date timestamp, reward_text string, images array<string>")
    got = feat.add_activity(df).orderBy("i").collect()
    assert [r.days_since_modified for r in got] == [11, 153, None, -4]
    assert [r.recently_updated for r in got] == [True, False, False, True]
    assert [r.has_reward for r in got] == [True, False, True, False]
    assert [r.has_images for r in got] == [True, False, False, True]


def test_engineer_features_with_baseline(spark):
    notices = spark.createDataFrame(
        [("n1", "Bank Fraud", "Wire fraud scheme", "Los Angeles, CA", datetime(2023, 1, 15), datetime(2023, 1, 15), datetime(2023, 12, 1), 320, "$1", ["x"]),
         ("n2", "Armed Robbery", "Violent robbery", "Houston, TX", datetime(2020, 6, 20), datetime(2023, 7, 1), datetime(2023, 12, 1), 164, None, [])],
        "uid string, title string, description string, place_of_birth string, publication_date timestamp, modified_date timestamp, "
        "ingestion_date timestamp, case_age_days int, reward_text string, images array<string>",
    )
    baseline = spark.createDataFrame(
        [("white_collar", 2023, 10, 1.0), ("white_collar", 2023, 5, 3.0), ("violent_crime", 2023, 7, 2.0)],
        "crime_family string, year int, count long, rate_per_100k double",
    )
    crossed = {r.uid: r for r in feat.engineer_features(notices, baseline).collect()}
    assert (crossed["n1"]["count"], crossed["n1"].rate_per_100k) == (15, 2.0)
    assert crossed["n2"]["count"] is None and crossed["n2"].crime_family == "Violent"
    plain = feat.engineer_features(notices, baseline, crosswalk=None).collect()
    assert [r["count"] for r in plain] == [None, None] and len(plain) == 2


def test_filters(spark):
    df = spark.createDataFrame([("CA", 2020), ("UNKNOWN", 2021), (None, 2022)], "birth_state string, publication_year int")
    assert {r.birth_state for r in feat.known_places(df).collect()} == {"CA", None}
    assert feat.select_years(df, [2020, 2022]).count() == 2 and feat.select_years(df, []).count() == 3
    assert feat.sample_gate(df).first().status == "insufficient_data"
    assert df.select(title_label(F.lit("blunt_object")).alias("t")).first().t == "Blunt Object"
