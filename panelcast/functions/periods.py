"""Period arithmetic as native column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def period_index(col: Column | str, grain: str = "month") -> Column:
    """Integer index of a period: year*12+month for months, days since epoch for days."""
    c = F.col(col) if isinstance(col, str) else col
    if grain == "month":
        return F.year(c) * 12 + F.month(c)
    if grain == "day":
        return F.unix_date(c)
    raise ValueError(f"unknown grain {grain!r}")


def to_period(col: Column | str, grain: str = "month") -> Column:
    """Truncate a date or timestamp to the first day of its period."""
    c = F.col(col) if isinstance(col, str) else col
    if grain == "month":
        return F.trunc(F.to_date(c), "month")
    if grain == "day":
        return F.to_date(c)
    raise ValueError(f"unknown grain {grain!r}")


def add_periods(col: Column | str, n: int | Column, grain: str = "month") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if grain == "month":
        return F.add_months(c, n)
    if grain == "day":
        return F.date_add(c, n)
    raise ValueError(f"unknown grain {grain!r}")


def nan_to_null(col: Column | str) -> Column:
    """NaN means unknown: never let a floating NaN into an aggregate."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nanvl(c, F.lit(None).cast("double"))
