"""Small numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; null when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return share(part, whole) * 100.0


def clamped(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """``value`` held within the bounds; null stays null (``least`` and ``greatest`` would skip it)."""
    held = value if high is None else F.least(value, F.lit(high))
    held = held if low is None else F.greatest(held, F.lit(low))
    return F.when(value.isNotNull(), held)


def shown(value: Column, digits: int = 2) -> Column:
    """Rounded copy for display, decimal ties to even: noise in the last digits of a double decides no tie.

    Results keep the unrounded value.
    """
    return F.bround(F.round(value, digits + 6), digits)


def fixed(value: Column, digits: int) -> Column:
    """``value`` as text with ``digits`` decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def rows(weight: str | None = None) -> Column:
    """Row count, or the sum of ``weight`` when the input is already counted."""
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))


def rows_where(condition: Column, weight: str | None = None) -> Column:
    """Rows for which ``condition`` is true."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))
