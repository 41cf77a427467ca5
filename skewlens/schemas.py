"""Declared schemas. Sources are read with these, never by inference."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _LONG, _DOUBLE, _FLAG = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_DATE, _TIME, _TEXTS = T.DateType(), T.TimestampType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SUBJECT = _struct(
    name=_TEXT, sex=_TEXT, race=_TEXT, nationality=_TEXT, date_of_birth=_TEXT, place_of_birth=_TEXT,
    hair=_TEXT, eyes=_TEXT, height_min=_TEXT, height_max=_TEXT, weight=_TEXT, aliases=_TEXTS,
)

NOTICE_ITEM = _struct(
    uid=_TEXT, title=_TEXT, description=_TEXT, subjects=T.ArrayType(SUBJECT), publication=_TEXT, modified=_TEXT,
    url=_TEXT, warning_message=_TEXT, reward_text=_TEXT, caution=_TEXT, details=_TEXT, images=_TEXTS, files=_TEXTS,
)

NOTICE_PAGE = _struct(items=T.ArrayType(NOTICE_ITEM))

BASELINE_RECORD = _struct(state=_TEXT, offense_type=_TEXT, count=_LONG, rate_per_100k=_DOUBLE)

BASELINE_PAGE = _struct(data=T.ArrayType(BASELINE_RECORD))

WANTED_TABLE = _struct(
    uid=_TEXT, title=_TEXT, description=_TEXT, name=_TEXT, sex=_TEXT, race=_TEXT, nationality=_TEXT,
    date_of_birth=_DATE, place_of_birth=_TEXT, publication_date=_TIME, modified_date=_TIME, ingestion_date=_TIME,
    case_age_days=_INT, reward_text=_TEXT, warning_message=_TEXT, url=_TEXT,
    birth_state=_TEXT, birth_region=_TEXT, crime_family=_TEXT, case_age_category=_TEXT,
    publication_year=_INT, publication_quarter=_INT, has_reward=_FLAG, has_images=_FLAG,
)

BASELINE_TABLE = _struct(
    id=_TEXT, year=_INT, state=_TEXT, offense_type=_TEXT, crime_family=_TEXT, count=_LONG, rate_per_100k=_DOUBLE,
    source=_TEXT, ingestion_date=_TIME,
)

RESULT_TABLE = _struct(
    id=_TEXT, analysis_type=_TEXT, analysis_date=_TIME, confidence_level=_DOUBLE, test_statistic=_DOUBLE,
    p_value=_DOUBLE, significant_bias=_FLAG, interpretation=_TEXT, metadata=_TEXT, sample_size=_LONG,
)

# Engineered notices as exported to CSV: lists travel as JSON text.
FEATURE_CSV = _struct(
    uid=_TEXT, title=_TEXT, description=_TEXT, place_of_birth=_TEXT, publication_date=_TIME, modified_date=_TIME,
    ingestion_date=_TIME, reward_text=_TEXT, images=_TEXT, case_age_days=_INT, birth_state=_TEXT,
    birth_state_population=_DOUBLE, birth_region=_TEXT, publication_year=_INT, publication_quarter=_INT,
    publication_month=_INT, case_age_months=_DOUBLE, case_age_years=_DOUBLE, case_age_category=_TEXT,
    crime_family=_TEXT, weapon_raw=_TEXT, weapon_category=_TEXT, severity_flag=_FLAG, public_notice_flag=_FLAG,
    days_since_modified=_INT, recently_updated=_FLAG, has_reward=_FLAG, has_images=_FLAG,
)
