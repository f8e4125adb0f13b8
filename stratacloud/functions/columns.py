"""Small column helpers shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantise(c: Column | str, digits: int = 4) -> Column:
    """Cut a double to fixed digits at a query boundary, with a threshold off the decimal grid so that the order of
    a sum cannot flip the result."""
    scale = 10.0**digits
    return F.floor(col(c) * F.lit(scale) + F.lit(0.4871)) / F.lit(scale)


def cell(c: Column | str, size: float, origin: float | Column = 0.0) -> Column:
    """Index of the half-open grid cell a coordinate lies in."""
    shifted = col(c) if isinstance(origin, (int, float)) and origin == 0 else col(c) - origin
    return F.floor(shifted / F.lit(float(size))).cast("long")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def avg_if(condition: Column, value: Column | str) -> Column:
    return F.avg(F.when(condition, col(value)))


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def rms_if(condition: Column, squared: Column) -> Column:
    return F.sqrt(F.avg(F.when(condition, squared)))


def not_nan(c: Column | str) -> Column:
    """NaN and infinities become null, so that aggregates leave them out."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(math.inf)), None).otherwise(c)


def clip_unit(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def norm(*parts: Column) -> Column:
    return F.sqrt(total([p * p for p in parts]))


def one_row(df: DataFrame) -> DataFrame:
    """Mark a global aggregate (one row by construction) as fit for broadcasting."""
    return F.broadcast(df)
