"""Small helpers for Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, places: int = 6) -> Column:
    """Rounded half up, and never a negative zero."""
    return F.round(col(x), places) + F.lit(0.0)


def ratio(a: Column, b: Column, empty: Column | float | None = None) -> Column:
    """a / b, or ``empty`` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def total(items: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, items)
