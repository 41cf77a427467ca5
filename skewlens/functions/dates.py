"""Date helpers. Session time zone is expected to be UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000
DATE_FORMATS = ("MM/dd/yyyy", "MMMM d, yyyy")


def parse_timestamp(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Parse each value on its own: ISO first, then ``formats``; bad text is null."""
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour spans from ``earlier`` to ``later``, rounded down.

    Two hours early is -1; crossing midnight alone is 0 (unlike ``datediff``).
    """
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    day = F.lit(MICROS_PER_DAY)
    return ((micros - F.pmod(micros, day)) / day).cast("int")


def bucketize(value: Column, buckets: Sequence[tuple[float | None, str]], missing: str) -> Column:
    """Label of the first bucket whose upper bound exceeds ``value``."""
    hits = [F.lit(label) if bound is None else F.when(value < bound, F.lit(label)) for bound, label in buckets]
    return F.when(value.isNull(), F.lit(missing)).otherwise(F.coalesce(*hits))
