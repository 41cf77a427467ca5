"""Validation, completeness, duplicates, text normalisation, anonymisation, retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, IntegralType, NumericType, StringType, TimestampNTZType, TimestampType

from .. import constants as K
from ..functions.dates import floor_days, parse_timestamp
from ..session import stored


def _stacked(one: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias(label), F.col(f"`{n}`").alias(value)) for n in names])
    return one.select(F.inline(pairs))


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of a row's values, null-safe and unambiguous.

    Equal rows are counted by grouping 32-byte digests rather than whole texts.
    """
    return F.unhex(F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256))


def duplicated_keys(df: DataFrame, key: str = "uid") -> DataFrame:
    """Non-null keys that occur more than once, with their count."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _breaks_type(df: DataFrame, column: str, kind: str) -> Column:
    """Whether a value that is there is not of its declared ``kind``: text, date or whole."""
    name, value = df.schema[column].dataType, F.col(column)
    text = isinstance(name, StringType)
    if kind == "text":
        bad = F.lit(not text)
    elif kind == "date":
        bad = parse_timestamp(value).isNull() if text else F.lit(not isinstance(name, (DateType, TimestampType, TimestampNTZType)))
    elif kind == "whole":
        number = value.try_cast("double") if text else value
        bad = F.lit(False) if isinstance(name, IntegralType) else (
            F.coalesce(number != F.floor(number), F.lit(True)) if text or isinstance(name, NumericType) else F.lit(True))
    else:
        raise ValueError(f"unknown kind of value: {kind}")
    return value.isNotNull() & bad


KINDS = {"text": "is text", "date": "is a date", "whole": "is a whole number"}


def validate(
    df: DataFrame,
    required: Sequence[str] = K.REQUIRED_FIELDS,
    unique: str = "uid",
    minimum: tuple[str, float] = ("case_age_days", 0),
    types: Mapping[str, str] = K.FIELD_TYPES,
) -> DataFrame:
    """One row per rule with the number of violating rows (values beyond the first, for uniqueness).

    Every value is tested without an error: text that is no date is counted.
    One scan: violations are summed per key, the keys of a task fold before the
    shuffle, and the repeats follow from the rows per key.
    """
    rules = {f"{c} not null" if c in df.columns else f"{c} missing": F.col(c).isNull() if c in df.columns else F.lit(True) for c in required}
    rules |= {f"{c} {KINDS[k]}": _breaks_type(df, c, k) for c, k in types.items() if c in df.columns}
    column, low = minimum
    rules[f"{column} >= {low}"] = F.col(column).try_cast("double") < low
    per_key = df.groupBy(F.col(unique).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(v).alias(k) for k, v in rules.items()])
    extra = F.coalesce(F.sum(F.when(F.col("_key").isNotNull(), F.col("_n") - 1)), F.lit(0))
    totals = [F.coalesce(F.sum(f"`{k}`"), F.lit(0)).alias(k) for k in rules]
    return _stacked(per_key.agg(*totals, extra.alias(f"{unique} unique")), [*rules, f"{unique} unique"], "rule", "violations")


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row: rows, mean completeness over all cells, rows that repeat an earlier row.

    One scan: equal rows have equally many filled cells, so both follow from the count of each digest.
    """
    filled = sum((F.col(c).isNotNull().cast("long") for c in df.columns), F.lit(0))
    groups = df.select(row_digest(df).alias("_d"), filled.alias("_f")).groupBy("_d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_f").alias("f"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.try_divide(F.sum("f").cast("double"), (F.sum("n") * len(df.columns)).cast("double")).alias("completeness"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def column_completeness(df: DataFrame) -> DataFrame:
    """Filled share per column."""
    one = df.agg(*[F.try_divide(F.count(c).cast("double"), F.count(F.lit(1)).cast("double")).alias(c) for c in df.columns])
    return _stacked(one, df.columns, "column_name", "completeness")


def latest_per_key(df: DataFrame, key: str = "uid", order: str = "modified_date") -> DataFrame:
    """One row per key, the most recently modified; ties by hash. Rows without a key stay.

    An aggregate, not a window: every task folds its copies to one per key
    before the shuffle, so a key that holds most rows costs no more than others.
    """
    whole = F.struct(*df.columns)
    rank = F.struct(F.col(order), F.xxhash64(*df.columns))
    best = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, rank).alias("_row"))
    return best.select("_row.*").unionByName(df.where(F.col(key).isNull()))


_TIE = (1 << 62) - 1


def _fixed_width(df: DataFrame, order: str) -> Column | None:
    """``order`` as a whole number of 64 bits that sorts alike (null first), or None where its type has none."""
    kind, value = df.schema[order].dataType, F.col(order)
    if isinstance(kind, TimestampNTZType):
        number = F.unix_micros(F.to_timestamp_ltz(value))
    elif isinstance(kind, TimestampType):
        number = F.unix_micros(value)
    elif isinstance(kind, DateType):
        number = F.unix_date(value)
    elif isinstance(kind, IntegralType):
        number = value
    else:
        return None
    return F.coalesce(number.cast("long"), F.lit(-(1 << 63)))


def newest_rows(df: DataFrame, key: str = "uid", order: str = "modified_date") -> DataFrame:
    """The rows of :func:`latest_per_key`, at the size where rows are long and most keys have one.

    ``df`` is derived and stored once, with a row number. The newest row of a key is then
    found on fixed-width columns alone: one decimal holds the order value and 62 bits
    of the row's digest, so each task folds its copies in a hash aggregate of 16 bytes a
    key, and copies equal in every column are settled by the least row number. The
    row numbers found pick the rows, and those without a key, in a last scan. ``order`` is a
    timestamp, a date or a whole number; other types go the way of :func:`latest_per_key`.
    """
    number = _fixed_width(df, order)
    if number is None:
        return latest_per_key(df, key, order)
    tie = F.xxhash64(*df.columns).bitwiseAND(F.lit(_TIE))
    rank = number.cast("decimal(19,0)") * F.lit(_TIE + 1).cast("decimal(19,0)") + tie.cast("decimal(19,0)")
    kept = stored(df.select("*", rank.alias("_rank"), F.monotonically_increasing_id().alias("_row")), "rows")
    keyed = kept.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "_rank", "_row")
    best = keyed.groupBy("_key").agg(F.max("_rank").alias("_rank"))
    picked = keyed.join(best, ["_key", "_rank"]).groupBy("_key").agg(F.min("_row").alias("_row"))
    first = picked.select("_row", F.lit(True).alias("_first"))
    return kept.join(first, "_row", "left").where(F.col("_first") | F.col(key).isNull()).select(*df.columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates removed: copies fold per task before the shuffle."""
    return df.distinct()


def standardize_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trim and fold runs of blanks, tabs and line ends."""
    return df.withColumns({c: F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")) for c in columns})


def standardize_states(df: DataFrame, column: str = "state") -> DataFrame:
    """Trimmed upper-case codes."""
    return df.withColumn(column, F.upper(F.trim(column)))


def anonymize(df: DataFrame, names: Sequence[str] = ("name",), lists: Sequence[str] = ("aliases",)) -> DataFrame:
    """Replace names and each listed alias by its SHA-256; null stays null."""
    return df.withColumns(
        {c: F.sha2(F.col(c), 256) for c in names}
        | {c: F.transform(c, lambda x: F.sha2(x, 256)) for c in lists}
    )


def retained(
    df: DataFrame, now: datetime | Column, date: str = "publication_date", days: int = K.RETENTION_DAYS
) -> DataFrame:
    """Rows at most ``days`` old at ``now``."""
    at = now if isinstance(now, Column) else F.lit(now)
    return df.where(floor_days(at, F.col(date)) <= days)
