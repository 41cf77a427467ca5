"""Small fixed tables as one SQL literal each (one call to the JVM instead of one per entry)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def array_sql(values: Iterable) -> str:
    return f"array({', '.join(map(sql_literal, values))})"


def map_sql(table: Mapping) -> str:
    return f"map({', '.join(sql_literal(x) for entry in table.items() for x in entry)})"


def array_of(values: Iterable) -> Column:
    return F.expr(array_sql(values))


def map_of(table: Mapping) -> Column:
    return F.expr(map_sql(table))
