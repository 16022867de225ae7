"""Roundings and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.round(x).cast("long")


def half_even(x: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(x).cast("long")


def total(x: Column) -> Column:
    """A sum that is 0 where nothing was summed."""
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def per(ms: Column, unit: int) -> Column:
    """Milliseconds in whole units, halves up, by decimal arithmetic."""
    return half_up(ms.cast("decimal(20,4)") / unit)


def div(a: Column, b: int | Column) -> Column:
    """Integer division."""
    return F.floor(a / b).cast("long") if not isinstance(b, int) else F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def share(a: Column, b: Column) -> Column:
    """A fraction with four places as a double; null where b is 0."""
    return F.round(a.cast("decimal(20,0)") / F.nullif(b.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")), 4).cast("double")


def bucket(x: Column, width: int) -> Column:
    """The lower end of the bucket that a whole number is in."""
    return div(x, width) * width
