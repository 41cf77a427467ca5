"""The fixed values, pinned: results and their SQL take them from one place, so a change must be seen here."""

import hashlib

import pytest

from skewlens import constants as K


def digest(value):
    return hashlib.sha256(repr(value).encode()).hexdigest()[:16]


PINNED = {
    "BASELINE_CROSSWALK": "2d4df265c61a3002",
    "BASELINE_FAMILIES": "6aaa8083c41e8442",
    "BIG_STATES": "ca12a156237da19c",
    "CASE_AGE_BUCKETS": "78aa4faeca51c98d",
    "CASE_AGE_MISSING": "35b151599e81d88b",
    "CATEGORY_OVER": "9f29a130438b8117",
    "CATEGORY_TEXT": "1ebf3bd6024c03a7",
    "CATEGORY_UNDER": "d2cbad71ff333de6",
    "CONFIDENCE": "22fa3ce4995af8d9",
    "CRIME_FAMILIES": "bcfdbc3e7600adb8",
    "DAYS_PER_MONTH": "399207a189577258",
    "DAYS_PER_YEAR": "b35cfe8da788df32",
    "ERROR_GEO": "f8fde02af9a095d7",
    "ERROR_WEAPONS": "1f5cc06a3dcca0ed",
    "FIELD_TYPES": "09684232d522eabf",
    "FINDING_CATEGORY": "cd678d05728597c3",
    "FINDING_GEO": "b9ac209a1f4ae0f0",
    "FINDING_PERSISTENCE": "4e483465a1e058f8",
    "FINDING_TREND": "2bbf8c53214da5ba",
    "MIN_DASHBOARD_SAMPLE": "624b60c58c9d8bfb",
    "MIN_EXPECTED": "a19a1584344c1f37",
    "MIN_GEO_SAMPLE": "1a6562590ef19d10",
    "MIN_GROUP_ROWS": "e7f6c011776e8db7",
    "MIN_PERIODS": "4e07408562bedb8b",
    "NOTE_PERSISTENCE": "d28bea8704b60784",
    "NO_WEAPON": "5dc808cc885eaa96",
    "OTHER_BASELINE_FAMILY": "7356bf46db8289e1",
    "OTHER_FAMILY": "85d53b5c077d62a5",
    "OTHER_REGION": "85d53b5c077d62a5",
    "RECENT_UPDATE_DAYS": "624b60c58c9d8bfb",
    "RECENT_YEAR": "d398b29d3dbbb9bf",
    "REGIONS": "6a965a3d62958f65",
    "REQUIRED_FIELDS": "08f276ed562df2f2",
    "RETENTION_DAYS": "4e47eb5525df25f9",
    "SERIOUS_FAMILIES": "07f35d7942778ab3",
    "SERIOUS_PHRASES": "52ca3c668d23942a",
    "STATE_CODES": "ae480fd4b73d0eae",
    "STATE_OVER": "77ac319bfe1979e2",
    "STATE_POPULATIONS": "4940545ff49cf705",
    "STATE_UNDER": "1e9d7c27c8bbc8dd",
    "SUBSET_POINTS": "a19a1584344c1f37",
    "TREND_THRESHOLD": "14be4b45f18e0d8c",
    "UNKNOWN_STATE": "28846dbd4a245258",
    "UNKNOWN_WEAPON": "551b29bdf877b9cb",
    "WEAPONS": "369e9908e4caa2e8",
    "WEAPON_DOMAIN": "dcd5ab3832fe571d",
}


@pytest.mark.parametrize("name", sorted(PINNED))
def test_pinned(name):
    assert digest(getattr(K, name)) == PINNED[name]


def test_all_are_pinned():
    assert {n for n in dir(K) if n.isupper()} == set(PINNED)


def test_states_and_regions():
    assert len(K.STATE_CODES) == 50 and sorted(K.STATE_CODES) == sorted(K.STATE_POPULATIONS)
    listed = [c for codes in K.REGIONS.values() for c in codes]
    assert len(listed) == len(set(listed)) == 48 and set(K.STATE_CODES) - set(listed) == {"MD", "DE"}
    assert abs(sum(K.STATE_POPULATIONS.values()) - 331.0) < 10
