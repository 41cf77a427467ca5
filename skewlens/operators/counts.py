"""Counts, shares, two-way tables and one-row summaries.

Every operator takes raw rows, or already counted rows through ``weight``, so
one :func:`case_cube` can feed them all. Totals are scalar subqueries over the
counted rows: they reuse the same shuffle and move one number, not the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as K
from ..functions.numbers import percent, rows, rows_where, share, shown

CUBE_KEYS = ("publication_year", "birth_region", "birth_state", "crime_family", "weapon_category", "severity_flag")


def case_cube(df: DataFrame, keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """One row per combination of the analysis dimensions: one scan, one shuffle.

    Holds all that the counting analyses need: rows, a flag for rows without
    weapon text, the size of the unit, the date range and the sum of case ages.
    Rows that bring the flag already (:func:`flag_missing_text`) are counted
    without reading their text.
    """
    measures = {
        "n": F.count(F.lit(1)),
        "birth_state_population": F.max("birth_state_population"),
        "first_publication": F.min("publication_date"),
        "last_publication": F.max("publication_date"),
        "case_age_sum": F.sum("case_age_days"),
        "case_age_count": F.count("case_age_days"),
    }
    grouped = flag_missing_text(df).groupBy(*keys, "weapon_text_missing")
    return grouped.agg(*[c.alias(name) for name, c in measures.items()])


def roll_up(df: DataFrame, sets: Sequence[Sequence[str]], weight: str | None = None) -> DataFrame:
    """Counts for several sets of keys at once, the empty set for the total: one scan, one Expand, one shuffle.

    ``level`` names the keys of a row's set, joined by commas; its other keys are null. A null
    in a key of the set is a label of its own, which the operators on counted rows leave out.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    level = F.lit(None).cast("string")
    for s in sets:  # the grouping id has a bit for each key that is rolled up, the first key's highest
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        level = F.when(F.grouping_id() == bits, F.lit(level_name(s))).otherwise(level)
    grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    return grouped.agg(rows(weight).alias("n"), level.alias("level"))


def level_name(keys: Sequence[str]) -> str:
    return ",".join(keys)


def text_missing(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def flag_missing_text(df: DataFrame) -> DataFrame:
    """Add ``weapon_text_missing`` unless the rows have it."""
    if "weapon_text_missing" in df.columns:
        return df
    return df.withColumn("weapon_text_missing", text_missing("weapon_raw"))


def labelled(df: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows whose keys are all known.

    On counted rows the test involves the count: a plain null test would be
    pushed below that count, which then could not share its shuffle with others.
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return df.where(known if weight is None else F.when(known, F.coalesce(F.col(weight), F.lit(0))) >= 0)


def label_counts(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Rows per non-null label."""
    return labelled(df, [key], weight).groupBy(key).agg(rows(weight).alias("n"))


def appearance_counts(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Rows per non-null label and ``first``, where the label first appears: the file and the row in it.

    ``df`` has the columns of :func:`skewlens.sources.files.with_row_position`, which belong to a row
    wherever it is processed. The least row is taken per file first, on fixed-width values.
    """
    per_file = labelled(df, [key], weight).groupBy(key, "_file").agg(rows(weight).alias("n"), F.min("_row").alias("_row"))
    return per_file.groupBy(key).agg(F.sum("n").alias("n"), F.min(F.struct("_file", "_row")).alias("first"))


def ranked(counts: DataFrame, key: str, limit: int | None = None, order: str = "count") -> DataFrame:
    """Most frequent first, ties by label; ``limit`` makes it a top-k report.

    ``order='appearance'`` takes the order in which the labels first appear, from :func:`appearance_counts`.
    """
    if order not in ("count", "appearance"):
        raise ValueError(f"order must be count or appearance, not {order}")
    ordered = counts.orderBy("first") if order == "appearance" else counts.orderBy(F.desc("n"), key)
    return ordered if limit is None else ordered.limit(limit)


def distribution(df: DataFrame, key: str, weight: str | None = None, over: str = "all") -> DataFrame:
    """Label, rows, share and percentage.

    ``over='all'`` divides by every row, ``over='known'`` by rows with a label.
    """
    counts = df.groupBy(key).agg(rows(weight).alias("n"))
    known = labelled(counts, [key], "n")
    total = (counts if over == "all" else known).agg(F.sum("n")).scalar()
    return known.withColumn("proportion", share(F.col("n"), total)).withColumn(
        "percentage", F.col("proportion") * 100.0
    )


def cells(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Two-way counts of the combinations that occur; rows with a null key are left out."""
    return labelled(df, [a, b], weight).groupBy(a, b).agg(rows(weight).alias("n"))


# Labels of the columns whose values are declared: tables over them show the absent ones as zero.
DECLARED = {
    "crime_family": [name for name, _ in K.CRIME_FAMILIES] + [K.OTHER_FAMILY],
    "weapon_category": K.WEAPON_DOMAIN,
    "birth_region": [*K.REGIONS, K.OTHER_REGION],
}


def zero_filled(counted: DataFrame, a: str, b: str, labels: Sequence[str]) -> DataFrame:
    """``counted`` with a row of n = 0 for every value of ``a`` and every absent one of the declared ``labels`` of ``b``.

    Declared labels that occur nowhere are left out, others that occur are kept.
    Each value of ``a`` is unfolded once per declared label: no row, task or
    array ever holds more than those, however many values and labels occur.
    """
    # The test involves n, so the plan of ``counted`` stays as it is and its shuffle is reused.
    known = F.when(F.col(b).isin(list(labels)), F.col("n")) >= 0
    occurring = counted.where(known).agg(F.collect_set(b).alias("labels")).scalar()
    values = counted.groupBy(a).agg(F.sum("n").alias("_total")).where("_total >= 0")
    absent = values.select(a, F.explode(occurring).alias(b), F.lit(0).cast("long").alias("n"))
    return counted.select(a, b, "n").unionByName(absent).groupBy(a, b).agg(F.sum("n").alias("n"))


def within(counted: DataFrame, key: str, name: str = "share") -> DataFrame:
    """Share of each cell in the total of its ``key``, on sparse counts of any size."""
    totals = counted.groupBy(key).agg(F.sum("n").alias("_total"))
    return counted.join(totals, key).withColumn(name, share(F.col("n"), F.col("_total"))).drop("_total")


def two_way(
    df: DataFrame, a: str, b: str, weight: str | None = None, normalize: str | None = None,
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Two-way table; ``normalize`` 'row' or 'column' adds the share within it.

    Sparse: the cells that occur. Zero rows are added for the declared ``labels``
    of ``b`` (of ``a`` for 'column'), by default those of :data:`DECLARED`.
    """
    whole, other = (b, a) if normalize == "column" else (a, b)
    counted = cells(df, a, b, weight)
    if labels is None:
        labels = DECLARED.get(other, ())
    table = zero_filled(counted, whole, other, labels) if labels else counted
    if normalize:
        table = within(table, whole)
    return table.select(a, b, "n", *(["share"] if normalize else []))


def yearly_shares(df: DataFrame, key: str, year: str = "publication_year", weight: str | None = None) -> DataFrame:
    """Percentage of each label within its year, zero-filled where the labels are declared."""
    table = two_way(df, year, key, weight, normalize="row")
    return table.withColumn("percentage", F.col("share") * 100.0).drop("share")


def row_counts(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Rows per key, in key order."""
    return label_counts(df, key, weight).orderBy(key)


def label_share_by(
    df: DataFrame, by: str, key: str, label: str, weight: str | None = None
) -> DataFrame:
    """Percentage of rows with ``label`` in each ``by``; rows without a label count in the base."""
    return (
        labelled(df, [by], weight)
        .groupBy(by)
        .agg(percent(rows_where(F.col(key) == label, weight), rows(weight)).alias("percentage"))
        .withColumn("percentage_shown", shown(F.col("percentage")))
    )


def first_and_last(counted: DataFrame, key: str, period: str, value: str = "n") -> DataFrame:
    """First and last period of each key with their values."""
    return counted.groupBy(key).agg(
        F.min(period).alias("first_period"),
        F.min_by(value, period).alias("first_value"),
        F.max(period).alias("last_period"),
        F.max_by(value, period).alias("last_value"),
    )


def extremes(counts: DataFrame, key: str) -> DataFrame:
    """One row: most and least common label; ties go to the earlier, respectively later, label."""
    best = F.min_by(key, F.struct(-F.col("n"), F.col(key)))
    worst = F.max_by(key, F.struct(-F.col("n"), F.col(key)))
    unknown = F.lit(K.UNKNOWN_WEAPON)
    return counts.agg(
        F.coalesce(best, unknown).alias("most_common"), F.coalesce(worst, unknown).alias("least_common")
    )


def distinct_labels(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row: distinct non-null labels per column.

    Exact counts unfold each row into one (column, label) pair per column, which
    fold per task before the shuffle: the rows are derived once, and no task
    holds the labels of a column. ``approximate`` is a single pass with sketches.
    """
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("label")) for i, c in enumerate(columns)])
    labels = df.select(F.inline(pairs)).where("label is not null").distinct()
    return labels.agg(*[F.count_if(F.col("c") == i).alias(c) for i, c in enumerate(columns)])


SKETCH_BITS = 14
SKETCH_SURE = 6  # standard errors that a stated error holds


def sketched_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """Rows and a sketch of the distinct values of each column (``…_sketch``, 2^bits bytes at most) per combination of keys.

    Unlike counts of distinct values, the sketches merge: any roll-up of the keys has its estimates,
    also of columns whose values are not kept.
    """
    def value(c):
        kind = df.schema[c].dataType
        return F.col(c) if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else F.col(c).cast("string")

    sketches = [F.hll_sketch_agg(value(c), bits).alias(f"{c}_sketch") for c in columns]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sketches)


def merged_sketches(cube: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A :func:`sketched_counts` table (or several of the same columns, as rows) rolled up to fewer keys."""
    return cube.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.hll_union_agg(f"{c}_sketch").alias(f"{c}_sketch") for c in columns])


def distinct_estimates(cube: DataFrame, keys: Sequence[str], columns: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """Rows and the estimated distinct values of each column per roll-up, with ``distinct_error``.

    The relative error of an estimate stays within ``distinct_error``, six standard errors of 1.04 / sqrt(2^bits),
    but for some two in 10^9 estimates: so do all estimates of a table, however many. Up to some hundred values it is exact.
    """
    rolled = merged_sketches(cube, keys, columns)
    return rolled.select(
        *keys, "n", *[F.hll_sketch_estimate(f"{c}_sketch").alias(c) for c in columns],
        F.lit(SKETCH_SURE * 1.04 / 2 ** (bits / 2)).alias("distinct_error"),
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: cases, distinct families and states, date range, mean case age."""
    return overview_from_cube(
        df.groupBy("crime_family", "birth_state").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("publication_date").alias("first_publication"),
            F.max("publication_date").alias("last_publication"),
            F.sum("case_age_days").alias("case_age_sum"),
            F.count("case_age_days").alias("case_age_count"),
        )
    )


def overview_from_cube(cube: DataFrame) -> DataFrame:
    """The same from counted rows; distinct labels come out of the small table, not the data."""
    return cube.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_cases"),
        F.countDistinct("crime_family").alias("crime_categories"),
        F.countDistinct("birth_state").alias("states_represented"),
        F.min("first_publication").alias("first_publication"),
        F.max("last_publication").alias("last_publication"),
        share(F.sum("case_age_sum"), F.sum("case_age_count")).alias("mean_case_age_days"),
    )


def concentration(
    df: DataFrame,
    states: Sequence[str] = K.BIG_STATES,
    since: int = K.RECENT_YEAR,
    weight: str | None = None,
) -> DataFrame:
    """One row: rows and share of the named states, and of years from ``since`` on."""
    total = rows(weight)
    big = rows_where(F.col("birth_state").isin(list(states)), weight)
    recent = rows_where(F.col("publication_year") >= since, weight)
    return df.agg(
        big.alias("big_state_cases"), percent(big, total).alias("big_state_percentage"),
        recent.alias("recent_cases"), percent(recent, total).alias("recent_percentage"),
    )


def severity_metrics(df: DataFrame, serious_only: bool = True, weight: str | None = None) -> DataFrame:
    """One row: serious rows and share; rows of unknown weapon and their share in the analysed rows."""
    serious = rows_where(F.col("severity_flag"), weight)
    analysed = F.col("severity_flag") if serious_only else F.lit(True)
    unknown = rows_where(analysed & (F.col("weapon_category") == K.UNKNOWN_WEAPON), weight)
    base = serious if serious_only else rows(weight)
    return df.agg(
        rows(weight).alias("total_cases"),
        serious.alias("serious_cases"), F.coalesce(percent(serious, rows(weight)), F.lit(0.0)).alias("serious_percentage"),
        unknown.alias("unknown_weapons"), F.coalesce(percent(unknown, base), F.lit(0.0)).alias("unknown_percentage"),
    )


def weapon_completeness(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows with a known weapon, an unknown one and none; a null weapon counts as known."""
    weapon = F.col("weapon_category")
    unknown, none = weapon.eqNullSafe(K.UNKNOWN_WEAPON), weapon.eqNullSafe(K.NO_WEAPON)
    one = df.agg(
        rows_where(~(unknown | none), weight).alias("known"),
        rows_where(unknown, weight).alias("unknown"),
        rows_where(none, weight).alias("none"),
    )
    return one.select(F.expr(
        "stack(3, 'Known Weapons', known, 'Unknown Weapons', unknown, 'No Weapon', none) AS (category, n)"
    ))


def example_rows(
    df: DataFrame, columns: Sequence[str] = ("title", "description"), order: str = "uid", limit: int = 3, width: int = 60
) -> DataFrame:
    """The first ``limit`` rows by ``order``, text cut to ``width`` for display."""
    return df.orderBy(order).limit(limit).select(
        order, columns[0], *[F.substring(c, 1, width).alias(c) for c in columns[1:]]
    )


