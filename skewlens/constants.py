"""Word lists, lookup tables, thresholds and wording.

These decide results, so they are stated once, as plain text, in the order in
which they are matched. Every operator takes them as default arguments.
"""

from __future__ import annotations

# --- Fixed values: states --------------------------------------------------
# Matching order is the alphabetical order of the state names.
STATE_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]

UNKNOWN_STATE = "UNKNOWN"

# Resident population per state, in millions.
STATE_POPULATIONS = {
    "CA": 39.5, "TX": 29.1, "FL": 21.5, "NY": 19.8, "PA": 13.0,
    "IL": 12.7, "OH": 11.8, "GA": 10.7, "NC": 10.4, "MI": 10.0,
    "NJ": 9.3, "VA": 8.6, "WA": 7.6, "AZ": 7.3, "MA": 7.0,
    "TN": 6.9, "IN": 6.8, "MO": 6.2, "MD": 6.2, "WI": 5.9,
    "CO": 5.8, "MN": 5.7, "SC": 5.1, "AL": 5.0, "LA": 4.7,
    "KY": 4.5, "OR": 4.2, "OK": 4.0, "CT": 3.6, "UT": 3.3,
    "IA": 3.2, "NV": 3.1, "AR": 3.0, "MS": 2.9, "KS": 2.9,
    "NM": 2.1, "NE": 1.9, "ID": 1.8, "WV": 1.8, "HI": 1.4,
    "NH": 1.4, "ME": 1.4, "MT": 1.1, "RI": 1.1, "DE": 1.0,
    "SD": 0.9, "ND": 0.8, "AK": 0.7, "VT": 0.6, "WY": 0.6,
}

# A state on no list (MD, DE) falls to OTHER_REGION.
REGIONS = {
    "Northeast": ["CT", "ME", "MA", "NH", "NJ", "NY", "PA", "RI", "VT"],
    "Southeast": ["AL", "AR", "FL", "GA", "KY", "LA", "MS", "NC", "SC", "TN", "VA", "WV"],
    "Midwest": ["IL", "IN", "IA", "KS", "MI", "MN", "MO", "NE", "ND", "OH", "SD", "WI"],
    "Southwest": ["AZ", "NM", "OK", "TX"],
    "West": ["AK", "CA", "CO", "HI", "ID", "MT", "NV", "OR", "UT", "WA", "WY"],
}
OTHER_REGION = "Other"

# --- Fixed values: keyword taxonomies, in matching order -------------------
CRIME_FAMILIES = [
    ("Violent", [
        "murder", "homicide", "assault", "robbery", "rape", "kidnapping",
        "domestic violence", "manslaughter", "shooting",
    ]),
    ("White Collar", [
        "fraud", "embezzlement", "money laundering", "tax evasion",
        "securities fraud", "wire fraud", "mail fraud", "bribery",
        "corruption", "insider trading",
    ]),
    ("Drug Related", [
        "drug trafficking", "narcotics", "cocaine", "heroin", "fentanyl",
        "methamphetamine", "drug distribution", "drug conspiracy",
    ]),
    ("Cyber Crime", [
        "computer fraud", "hacking", "identity theft", "cyber",
        "internet fraud", "phishing", "ransomware",
    ]),
    ("Organized Crime", [
        "racketeering", "rico", "organized crime", "conspiracy",
        "criminal enterprise", "gang",
    ]),
    ("Terrorism", [
        "terrorism", "terrorist", "bombing", "explosive",
        "national security", "espionage",
    ]),
]
OTHER_FAMILY = "Other"

WEAPONS = [
    ("firearm", [
        "gun", "firearm", "pistol", "rifle", "shotgun", "revolver",
        "weapon", "armed", "shooting", "shot", "bullet", "ammunition",
        "handgun", "automatic", "semi-automatic", "caliber", ".22", ".38",
        ".45", "9mm", "ak-47", "ar-15", "glock",
    ]),
    ("knife", [
        "knife", "blade", "stabbing", "stabbed", "cut", "cutting",
        "machete", "sword", "dagger", "razor", "sharp object",
    ]),
    ("blunt_object", [
        "bat", "club", "hammer", "pipe", "stick", "bludgeon",
        "blunt object", "beating", "beaten", "struck with",
    ]),
    ("none", ["unarmed", "no weapon", "without weapon"]),
]
UNKNOWN_WEAPON = "unknown"
NO_WEAPON = "none"
WEAPON_DOMAIN = ["firearm", "knife", "blunt_object", "none", "unknown", "other"]

SERIOUS_PHRASES = [
    "murder", "homicide", "manslaughter", "killing", "killed",
    "aggravated assault", "assault with deadly weapon",
    "armed robbery", "robbery", "bank robbery",
    "kidnapping", "abduction",
    "rape", "sexual assault",
    "terrorism", "terrorist attack",
    "shooting", "mass shooting",
]
SERIOUS_FAMILIES = ["Violent", "Terrorism"]

BASELINE_FAMILIES = [
    ("violent_crime", ["murder", "rape", "robbery", "aggravated_assault"]),
    ("property_crime", ["burglary", "larceny", "motor_vehicle_theft", "arson"]),
    ("white_collar", ["fraud", "embezzlement", "counterfeiting"]),
    ("cyber_crime", ["computer_fraud", "identity_theft"]),
    ("drug_crime", ["drug_possession", "drug_trafficking"]),
    ("other", ["other_offenses"]),
]
OTHER_BASELINE_FAMILY = "other"

# Baseline vocabulary -> notice vocabulary. Without it the two never match.
BASELINE_CROSSWALK = {
    "violent_crime": "Violent",
    "property_crime": "Other",
    "white_collar": "White Collar",
    "cyber_crime": "Cyber Crime",
    "drug_crime": "Drug Related",
    "other": "Other",
}

# --- Fixed values: case-age buckets (upper bound in days, label) -----------
CASE_AGE_BUCKETS = [
    (30, "Recent (< 1 month)"),
    (365, "Medium (1-12 months)"),
    (1825, "Long (1-5 years)"),
    (None, "Very Long (> 5 years)"),
]
CASE_AGE_MISSING = "Unknown"
DAYS_PER_MONTH = 30.44
DAYS_PER_YEAR = 365.25
RECENT_UPDATE_DAYS = 30

# --- Fixed values: thresholds ----------------------------------------------
CONFIDENCE = 0.95
STATE_OVER, STATE_UNDER = 1.2, 0.8
CATEGORY_OVER, CATEGORY_UNDER = 1.5, 0.5
SUBSET_POINTS = 5.0
MIN_EXPECTED = 5.0
MIN_GEO_SAMPLE = 50
MIN_DASHBOARD_SAMPLE = 30
MIN_PERIODS = 3
MIN_GROUP_ROWS = 6
BIG_STATES = ["CA", "TX", "FL"]
RECENT_YEAR = 2023
RETENTION_DAYS = 365
TREND_THRESHOLD = 0.1

# --- Fixed values: validation rules ----------------------------------------
FIELD_TYPES = {"uid": "text", "publication_date": "date", "case_age_days": "whole"}
REQUIRED_FIELDS = ["uid", "title", "publication_date"]

# --- Fixed values: wording of the findings ---------------------------------
FINDING_GEO = "Geographic bias detected in state representation"
FINDING_CATEGORY = "Category bias detected in crime type distribution"
FINDING_TREND = "Significant temporal trends identified"
FINDING_PERSISTENCE = "Differences in case persistence across categories"
NOTE_PERSISTENCE = "Insufficient data for statistical comparison"
ERROR_GEO = "Insufficient data for geographic analysis"
ERROR_WEAPONS = "No serious crimes found in dataset"
CATEGORY_TEXT = "Category distribution differs from baseline"
