"""Fields, literals and filters as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit import identifiers as ids

# How configured types are cast.
CASTS = {"string": "string", "integer": "bigint", "double": "double", "decimal": "decimal(38,18)", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}


def column_at(path: ids.Path) -> Column:
    """A field outside collections; names are never parsed."""
    first, *rest = path
    return reduce(lambda c, s: c.getField(s.name), rest, F.col(ids.quote(first.name or "")))


def literal(value: Any, value_type: str | None = None) -> Column:
    return F.lit(value).cast(CASTS[value_type]) if value_type else F.lit(value)


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
}


def condition(item: Mapping[str, Any]) -> Column:
    """One filter. Comparisons are SQL's: a null field passes none of them, ``ne`` and ``not_in`` included."""
    c, op, value, value_type = column_at(ids.reference(item["column"])), item["operator"], item.get("value"), item.get("value_type")
    if op in _COMPARE:
        return _COMPARE[op](c, literal(value, value_type))
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op == "like":
        return c.like(value)
    if op == "between":
        low, high = value
        return c.between(literal(low, value_type), literal(high, value_type))
    if op in ("in", "not_in"):
        inside = c.isin(*[literal(v, value_type) for v in value])
        return inside if op == "in" else ~inside
    raise ValueError(f"unknown operator {op!r}")


def filtered(df: DataFrame, filters: Iterable[Mapping[str, Any]]) -> DataFrame:
    """All filters together; there is no OR."""
    return reduce(lambda d, item: d.where(condition(item)), filters, df)


def projected(df: DataFrame, columns: Iterable[str] | None) -> DataFrame:
    return df if columns is None else df.select(*[F.col(ids.quote(c)) for c in columns])
