"""Casts, scales and scores of numbers as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def safe_int(c: Column) -> Column:
    """'3' and '3.0' as 3; null for what is no number."""
    return c.try_cast("double").try_cast("int")


def safe_float(c: Column) -> Column:
    """A number, null for text that is none and for NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def safe_bool(c: Column) -> Column:
    """true, 1, yes and y as true; other text as false; null stays null."""
    return F.when(c.isNotNull(), F.lower(F.trim(c)).isin("true", "1", "yes", "y", "t"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0, digits: int = 4) -> Column:
    """The number held between low and high, rounded."""
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), c)), digits)


def sigmoid(c: Column, most: float = 30.0) -> Column:
    """The logistic function of the number held within +-most."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), c))))


def average_rank(order: Column, *by: Column) -> Column:
    """Ranks from 1 in ascending order; equal values share the mean of their ranks."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(order.asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*by, order)) - 1) / F.lit(2.0)


def percentile_score(value: Column, *by: Column) -> Column:
    """(average rank - 1) / (n - 1); 0.5 where all values are equal."""
    w = Window.partitionBy(*by)
    n = F.count(value).over(w)
    flat = F.min(value).over(w) == F.max(value).over(w)
    return F.when(flat, F.lit(0.5)).otherwise((average_rank(value, *by) - 1) / F.nullif(n - 1, F.lit(0)))


def min_max(value: Column, *by: Column, flat: float = 0.0) -> Column:
    """(value - least) / (most - least) within the group."""
    w = Window.partitionBy(*by)
    span = F.max(value).over(w) - F.min(value).over(w)
    return F.when(span == 0, F.lit(flat)).otherwise((value - F.min(value).over(w)) / span)


def row_mean(*columns: Column) -> Column:
    """Mean over columns, nulls left out."""
    held = F.array_compact(F.array(*(c.cast("double") for c in columns)))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda t, x: t + x) / F.size(held))


def row_std(*columns: Column, ddof: int = 0) -> Column:
    """Standard deviation over columns."""
    n = len(columns)
    mean = reduce(lambda a, b: a + b, columns) / F.lit(float(n))
    return F.sqrt(reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in columns]) / F.lit(float(n - ddof)))


def violations(*flags: Column) -> Column:
    """How many of the flags hold; null does not."""
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def blend(parts: dict[str, float]) -> Column:
    """Weighted sum of columns."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in parts.items()])
