"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 6) -> Column:
    """Round half up; adding 0.0 turns -0.0 into 0.0."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def half_even(value: Column, digits: int) -> Column:
    """Round half to even, the rule NumPy uses for reported metrics."""
    return F.bround(value.cast("double"), digits) + F.lit(0.0)


def divide(top: Column, bottom: Column) -> Column:
    """top / bottom as double; NULL when bottom is 0 (also in ANSI mode)."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """top / bottom, and ``empty`` when bottom is 0."""
    return F.when(bottom == 0, F.lit(float(empty))).otherwise(divide(top, bottom))


def clip(value: Column, low=None, high=None) -> Column:
    """Clip to [low, high]; NULL stays NULL (greatest/least would drop it)."""
    out = value
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def any_null(*columns: Column) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out
