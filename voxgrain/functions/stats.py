"""Exact shares and null-safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxgrain.functions.text import as_column


def percent(part: Column | str, whole: Column | str, digits: int = 4) -> Column:
    """100 * part / whole rounded; 0 for an empty whole."""
    part, whole = as_column(part), as_column(whole)
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, digits))


def percent_tenths(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole to one decimal, half up, in whole-number arithmetic."""
    part, whole = as_column(part).cast("long"), as_column(whole).cast("long")
    tenths = F.floor((part * 2000 + whole) / (whole * 2))
    return F.when(whole == 0, F.lit(0.0)).otherwise(tenths / F.lit(10.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
