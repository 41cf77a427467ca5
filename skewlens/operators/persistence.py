"""How long cases stay open per category: summary statistics, quantiles, one-way ANOVA."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from ..functions.literals import array_of
from ..functions.numbers import clamped, fixed, shown
from ..functions.special import f_p_value
from ..session import stored

BOX = (0.0, 0.25, 0.5, 0.75, 1.0)


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows per category and value: the shared base of every statistic here.

    Whole days repeat heavily, so this folds any number of rows of a hot
    category into at most one row per day, before and after the shuffle.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def moments(counted: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, values, mean, sum of squared deviations, min and max per category.

    Deviations are taken from the mean of all values before they are squared, so
    that large values lose no digits; one pass, no join.
    """
    n = F.when(F.col(value).isNotNull(), F.col("n"))
    v = F.col(value).cast("double")
    centre = counted.agg(F.try_divide(F.sum(v * n), F.sum(n))).scalar()
    gap = v - F.col("_centre")
    return (
        counted.withColumn("_centre", centre)
        .groupBy(key)
        .agg(
            F.max("_centre").alias("_centre"),
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(n), F.lit(0)).alias("count"),
            F.sum(gap * n).alias("_d1"),
            F.sum(gap * gap * n).alias("_d2"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
        .select(
            key, "rows", "count",
            (F.col("_centre") + F.try_divide(F.col("_d1"), F.col("count").cast("double"))).alias("mean"),
            clamped(
                F.col("_d2") - F.try_divide(F.col("_d1") * F.col("_d1"), F.col("count").cast("double")), low=0.0
            ).alias("squares"),
            "min", "max",
        )
    )


def raw_moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """The table of :func:`moments` from rows of any values, one small row per category and task.

    Spark's variance merges partial results without cancellation.
    """
    v = F.col(value).cast("double")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("count"), F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("squares"), F.min(value).alias("min"), F.max(value).alias("max"),
    )


def day_quantiles(counted: DataFrame, key: str, value: str, probabilities: Sequence[float] = BOX) -> DataFrame:
    """Exact linear-interpolated quantiles per category from counted whole days: one array ``quantiles``.

    A category has a bounded number of distinct values (fewer than 40,000 days
    in a century), which fit one task.
    """
    wanted = array_of(map(float, probabilities))
    return counted.groupBy(key).agg(F.percentile(value, wanted, F.col("n")).alias("quantiles"))


OCTAVE = 1024   # first cells per factor of two
CELLS = 4096    # cells that a later round cuts a cell into, at least
MOST_CELLS = 16 * CELLS
SMALL = 5_000   # rows of a cell that are put in order in one go
SALTS = 64


def _magnitude(v):
    """Cells in the order of the values: ``OCTAVE`` to a factor of two, zero alone, then the infinities and NaN."""
    size = F.floor(F.log2(F.abs(v)) * OCTAVE) + (1075 * OCTAVE)
    far = 4096 * OCTAVE
    cell = F.when(F.isnan(v), far + 1).when(F.abs(v) == float("inf"), far).when(v == 0, 0).otherwise(size)
    return F.when(v < 0, -cell).otherwise(cell).cast("long")


def _chosen(cells: DataFrame, by: Sequence[str], ranks) -> DataFrame:
    """The cells that hold the wanted ranks: ``_i``, ``_at`` (the rank within the cell), bounds and rows of the cell.

    ``cells`` has one row per cell, so the window runs over cells, never over rows.
    """
    in_order = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = cells.withColumn("_to", F.sum("n").over(in_order)).withColumn("_total", F.sum("n").over(Window.partitionBy(*by)))
    start = F.col("_to") - F.col("n")
    inside = F.filter(ranks(placed), lambda r: (r["_rank"] >= start) & (r["_rank"] < F.col("_to")))
    found = F.transform(inside, lambda r: F.struct(r["_i"].alias("_i"), (r["_rank"] - start).alias("_at")))
    keys = [k for k in by if k not in ("_i", "_at")]
    return placed.select(*keys, "_total", "_lo", "_hi", "n", F.inline(found))


def _counted(rows: DataFrame, by: Sequence[str], n) -> DataFrame:
    return rows.groupBy(*by, "_cell").agg(n.alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def quantiles(
    df: DataFrame, key: str, value: str, probabilities: Sequence[float] = BOX, small: int = SMALL
) -> DataFrame:
    """Exact linear-interpolated quantiles per category of any values: one array ``quantiles``.

    Repeated rank selection. The first round counts rows per cell of magnitude, one
    pass with one small row per cell and task; each wanted rank lies in one
    cell, whose least and greatest value are known. Rows inside those cells are kept,
    folded by value, and counted again in ``CELLS`` equal steps between these
    values, until a cell holds one value only or at most ``small`` rows, which are
    put in order. Each round narrows a cell by the factor ``CELLS`` at least, so five end any
    case, and cuts large cells finer (up to ``MOST_CELLS``), so that rows spread evenly
    need no other round for a few above ``small``; the driver sees one number per round. No task orders more than ``small`` rows.

    The first rounds run when this is called. NaN counts as greater than any number.
    """
    v = F.col(value).cast("double") + F.lit(0.0)
    raw = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), v.alias("_v")).where("_v is not null")
    places = [float(p) for p in probabilities]

    def wanted(cells):
        place = [F.lit(p) * (F.col("_total") - 1) for p in places]
        return F.array(*[
            F.struct(F.lit(2 * i + j).alias("_i"), step(x).cast("long").alias("_rank"))
            for i, x in enumerate(place) for j, step in enumerate((F.floor, F.ceil))
        ])

    first = _counted(raw.withColumn("_cell", _magnitude(F.col("_v"))), ["_k"], F.count(F.lit(1)))
    open_ = stored(_chosen(first, ["_k"], wanted), "cells")
    totals = open_.select("_k", "_total").distinct()
    several = F.col("_lo") < F.col("_hi")
    known = open_.where(~several).select("_k", "_i", F.col("_lo").alias("_value"))
    most = open_.where(several).agg(F.max("n")).first()[0]
    if most is None:
        return _interpolated(known, open_, places, key)

    # Rows meet their category's cells by category and salt, so that a hot category is spread over many tasks.
    bounds = F.sort_array(F.collect_list(F.struct("_i", "_at", "_lo", "_hi"))).alias("_b")
    brackets = open_.where(several).groupBy("_k").agg(bounds).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = raw.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    around = F.filter("_b", lambda b: (F.col("_v") >= b["_lo"]) & (F.col("_v") <= b["_hi"]))
    held = salted.join(brackets, ["_k", "_salt"]).select("_k", "_v", F.inline(around)).groupBy(
        "_k", "_i", "_at", "_lo", "_hi", "_v").agg(F.count(F.lit(1)).alias("n"))
    while most > small:
        held = stored(held, "held")
        parts = min(MOST_CELLS, max(CELLS, 4 * most // small))
        step = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts)
        cells = _counted(held.withColumn("_cell", step), ["_k", "_i", "_at"], F.sum("n"))
        inner = stored(_chosen(cells, ["_k", "_i", "_at"], lambda c: F.array(F.struct(F.col("_i"), F.col("_at").alias("_rank")))).drop(
            "_total"), "cells")
        known = known.unionByName(inner.where(~several).select("_k", "_i", F.col("_lo").alias("_value")))
        most = inner.where(several).agg(F.max("n")).first()[0]
        if most is None:
            return _interpolated(known, open_, places, key)
        narrow = inner.where(several).select("_k", "_i", "_at", "_lo", "_hi")
        held = held.select("_k", "_i", "_v", "n").join(narrow, ["_k", "_i"]).where("_v >= _lo and _v <= _hi")
    in_order = F.array_sort(F.collect_list(F.struct("_v", "n")))
    passed = F.struct(F.lit(0).cast("long").alias("to"), F.lit(None).cast("double").alias("v"))
    walk = F.aggregate(in_order, passed, lambda a, x: F.struct(
        (a["to"] + x["n"]).alias("to"),
        F.when((a["to"] <= F.col("_at")) & (a["to"] + x["n"] > F.col("_at")), x["_v"]).otherwise(a["v"]).alias("v"),
    ))
    last = held.groupBy("_k", "_i", "_at").agg(walk["v"].alias("_value")).select("_k", "_i", "_value")
    return _interpolated(known.unionByName(last), open_, places, key)


def _interpolated(values: DataFrame, cells: DataFrame, places: Sequence[float], key: str) -> DataFrame:
    """One array per category from the two values around each place; the rows of a category come with its cells."""
    both = values.select("_k", "_i", "_value", F.lit(None).cast("long").alias("_total")).unionByName(
        cells.select("_k", F.lit(-1).alias("_i"), F.lit(None).cast("double").alias("_value"), "_total"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("_i") >= 0, F.struct("_i", "_value"))))
    grouped = both.groupBy("_k").agg(F.max("_total").alias("_total"), pairs.alias("_p"))
    out = []
    for i, p in enumerate(places):
        low, high = (F.get("_p", F.lit(2 * i + j))["_value"] for j in (0, 1))
        place = F.lit(p) * (F.col("_total") - 1)
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))))
    return grouped.select(F.col("_k").alias(key), F.array(*out).alias("quantiles"))


#: Columns known to hold whole days.
WHOLE_DAYS = ("case_age_days",)


def _days(value: str, whole_days: bool | None) -> bool:
    return value in WHOLE_DAYS if whole_days is None else whole_days


def persistence(
    df: DataFrame, key: str = "crime_family", value: str = "case_age_days", whole_days: bool | None = None
) -> DataFrame:
    """Count, mean, median, sample standard deviation, min and max per category.

    ``whole_days=True`` says that ``value`` is a number of days, which takes a
    shorter way; by default only the columns of :data:`WHOLE_DAYS` do.
    """
    if _days(value, whole_days):
        return persistence_from_counts(value_counts(df, key, value), key, value)
    return _statistics(raw_moments(df, key, value), quantiles(df, key, value, (0.5,)), key)


def persistence_from_counts(counted: DataFrame, key: str, value: str) -> DataFrame:
    """:func:`persistence` from counted whole days."""
    return _statistics(moments(counted, key, value), day_quantiles(counted, key, value, (0.5,)), key)


def _statistics(table: DataFrame, middle: DataFrame, key: str) -> DataFrame:
    return table.join(middle.select(key, F.get("quantiles", F.lit(0)).alias("median")), key, "left").select(
        key, "count", "mean", "median",
        F.sqrt(F.when(F.col("count") > 1, F.col("squares") / (F.col("count") - 1))).alias("std"),
        "min", "max",
    ).withColumns({f"{c}_shown": shown(F.col(c)) for c in ("mean", "median", "std")})


def box_stats(
    df: DataFrame, key: str = "crime_family", value: str = "case_age_days", whole_days: bool | None = None
) -> DataFrame:
    """Five-number summary per category (box plot); ``whole_days`` as in :func:`persistence`."""
    if _days(value, whole_days):
        return box_from_counts(value_counts(df, key, value), key, value)
    return _box(quantiles(df, key, value), key)


def box_from_counts(counted: DataFrame, key: str, value: str) -> DataFrame:
    """:func:`box_stats` from counted whole days."""
    return _box(day_quantiles(counted, key, value), key)


def _box(table: DataFrame, key: str) -> DataFrame:
    names = ("min", "q1", "median", "q3", "max")
    return table.select(key, *[F.get("quantiles", F.lit(i)).alias(name) for i, name in enumerate(names)])


def approximate_box_stats(
    df: DataFrame, key: str = "crime_family", value: str = "case_age_days", accuracy: int = 10_000
) -> DataFrame:
    """The same in one pass with bounded memory; ranks are off by at most rows / accuracy."""
    q = F.percentile_approx(value, list(BOX), accuracy)
    names = ("min", "q1", "median", "q3", "max")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(q.alias("q")).select(
        key, *[F.col("q")[i].cast("double").alias(n) for i, n in enumerate(names)]
    )


def anova_from_moments(
    table: DataFrame, key: str, confidence: float = K.CONFIDENCE, min_rows: int = K.MIN_GROUP_ROWS
) -> DataFrame:
    """One row: F test over categories with at least ``min_rows`` rows, and its sentence.

    Null values count towards ``min_rows``. Wording is a fixed value; it names the
    categories of the longest and shortest mean among all categories.
    """
    used = F.col("rows") >= min_rows
    # All columns are named so that the subquery shares the shuffle of ``table``.
    grand = table.where(used).agg(F.struct(
        F.try_divide(F.sum(F.col("mean") * F.col("count")), F.sum("count")).alias("mean"),
        *[F.max(c).alias(f"_{c}") for c in table.columns if c not in (key, "mean", "count")],
    )).scalar()
    gap = F.col("mean") - F.col("_grand")
    mean = shown(F.col("mean"))
    named = F.when(mean.isNotNull(), F.struct(F.col(key).alias("k"), mean.alias("m")))
    one = table.withColumn("_grand", grand["mean"]).agg(
        F.count_if(used).alias("groups"),
        F.coalesce(F.sum(F.when(used, F.col("count"))), F.lit(0)).alias("sample_size"),
        F.min(F.when(used, F.col("count"))).alias("_least"),
        F.sum(F.when(used, gap * gap * F.col("count"))).alias("_between"),
        F.sum(F.when(used, F.col("squares"))).alias("_within"),
        F.min_by(named, F.when(mean.isNotNull(), F.struct(-mean, F.col(key)))).alias("_longest"),
        F.min_by(named, F.when(mean.isNotNull(), F.struct(mean, F.col(key)))).alias("_shortest"),
    )
    between = F.try_divide(F.col("_between"), (F.col("groups") - 1).cast("double"))
    within = F.try_divide(F.col("_within"), (F.col("sample_size") - F.col("groups")).cast("double"))
    constant = (F.col("_within") == 0) & (F.col("_between") > 0)
    enough = F.col("groups") > 1
    tested = enough & (F.col("_least") > 0)
    p = fixed(F.col("anova_p_value"), 4)
    found = F.concat(
        F.lit("Significant differences in case persistence detected (p="), p,
        F.lit("). '"), F.col("_longest")["k"],
        F.lit("' cases persist longest (avg: "), fixed(F.col("_longest")["m"], 0),
        F.lit(" days), while '"), F.col("_shortest")["k"],
        F.lit("' cases are resolved fastest (avg: "), fixed(F.col("_shortest")["m"], 0),
        F.lit(" days)."),
    )
    none = F.concat(F.lit("No significant differences in case persistence across categories (p="), p, F.lit(")."))
    significant = F.col("significant_differences")
    return (
        one.withColumns({
            "anova_f_statistic": F.when(
                tested, F.when(constant, F.lit(float("inf"))).otherwise(F.try_divide(between, within))
            ),
            "df_between": F.when(enough, F.col("groups") - 1),
            "df_within": F.when(enough, F.col("sample_size") - F.col("groups")),
        })
        .withColumn("anova_p_value", f_p_value("anova_f_statistic", "df_between", "df_within"))
        .withColumns({
            "significant_differences": F.when(enough, F.coalesce(F.col("anova_p_value") < 1 - confidence, F.lit(False))),
            "status": F.when(~enough, F.lit("too_few_groups")).when(~tested, F.lit("empty_group")).otherwise("ok"),
            "note": F.when(~enough, F.lit(K.NOTE_PERSISTENCE)),
            "confidence_level": F.lit(confidence),
        })
        .withColumn("interpretation", F.when(significant, found).when(F.col("anova_p_value").isNotNull(), none))
        .drop("_least", "_between", "_within", "_longest", "_shortest")
    )


def anova(
    df: DataFrame, key: str = "crime_family", value: str = "case_age_days", confidence: float = K.CONFIDENCE
) -> DataFrame:
    """One-way ANOVA of ``value`` over categories, in one pass."""
    return anova_from_moments(raw_moments(df, key, value).drop("min", "max"), key, confidence)


def analyze_persistence(
    df: DataFrame, key: str = "crime_family", value: str = "case_age_days", confidence: float = K.CONFIDENCE,
    whole_days: bool | None = None,
) -> dict[str, DataFrame]:
    """Statistics per category and the one-row test; whole days from the same value counts, other values as they are."""
    if _days(value, whole_days):
        counted = value_counts(df, key, value)
        table, middle = moments(counted, key, value), day_quantiles(counted, key, value, (0.5,))
    else:
        table, middle = raw_moments(df, key, value), quantiles(df, key, value, (0.5,))
    return {
        "persistence_by_category": _statistics(table, middle, key),
        "test": anova_from_moments(table.drop("min", "max"), key, confidence),
    }
