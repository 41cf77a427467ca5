"""Audit over batches: a state that is small, merges, and has all that the analyses read.

The state of some notices is their case cube and their case-age counts. Both are plain
aggregates, so states merge: counts and sums add up, dates take the least and greatest. The
state of a new batch costs one pass over that batch; what was counted before is not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .counts import CUBE_KEYS, flag_missing_text

_AGE = "case_age_days"
_KEYS = (*CUBE_KEYS, "weapon_text_missing", _AGE)
_CUBE = (*CUBE_KEYS, "weapon_text_missing")
_AGES = ("crime_family", _AGE)


def audit_state(features: DataFrame) -> DataFrame:
    """One row per cell of the case cube (``part`` 'cube') and per family and case age ('ages'): one scan, one shuffle.

    Takes engineered rows; nothing but the counts leaves a task.
    """
    rows = flag_missing_text(features)
    ages = F.grouping_id() == sum(1 << (len(_KEYS) - 1 - i) for i, k in enumerate(_KEYS) if k not in _AGES)
    grouped = rows.groupingSets([[F.col(k) for k in _CUBE], [F.col(k) for k in _AGES]], *_KEYS)
    return grouped.agg(
        F.when(ages, F.lit("ages")).otherwise("cube").alias("part"),
        F.count(F.lit(1)).alias("n"),
        F.max("birth_state_population").alias("birth_state_population"),
        F.min("publication_date").alias("first_publication"),
        F.max("publication_date").alias("last_publication"),
        F.sum(_AGE).alias("case_age_sum"),
        F.count(_AGE).alias("case_age_count"),
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all the notices whose states these are; associative, in any order."""
    both = reduce(DataFrame.unionByName, states)
    return both.groupBy("part", *_KEYS).agg(
        F.sum("n").alias("n"),
        F.max("birth_state_population").alias("birth_state_population"),
        F.min("first_publication").alias("first_publication"),
        F.max("last_publication").alias("last_publication"),
        F.sum("case_age_sum").alias("case_age_sum"),
        F.sum("case_age_count").alias("case_age_count"),
    )


def cube_of(state: DataFrame) -> DataFrame:
    """The case cube, as :func:`skewlens.operators.counts.case_cube` makes it."""
    return state.where("part = 'cube'").drop("part", _AGE)


def ages_of(state: DataFrame) -> DataFrame:
    """Rows per family and case age."""
    return state.where((F.col("part") == "ages") & F.col("crime_family").isNotNull()).select(*_AGES, "n")
