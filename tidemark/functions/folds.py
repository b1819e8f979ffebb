"""Indicators as folds over arrays: each restarts from a mean seed inside its window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(values: Column, start: int, n: int) -> Column:
    """Mean of n elements from ``start`` (counted from 1), added from left to right."""
    return F.aggregate(F.slice(values, start, n), F.lit(0.0), lambda a, x: a + x) / n


def ema(values: Column, period: int) -> Column:
    """Exponential mean of an array, seeded by the mean of its first ``period`` elements; null if it has fewer."""
    rate = 2.0 / (period + 1)
    rest = F.slice(values, F.lit(period + 1), F.greatest(F.size(values) - period, F.lit(0)))
    return F.when(F.size(values) >= period, F.aggregate(rest, mean_of(values, 1, period), lambda a, x: (x - a) * rate + a))


def wilder(values: Column, period: int) -> Column:
    """Wilder's smoothed mean of an array whose first element is no change and never counts; null up to ``period``."""
    rest = F.slice(values, F.lit(period + 2), F.greatest(F.size(values) - period - 1, F.lit(0)))
    return F.when(F.size(values) > period, F.aggregate(rest, mean_of(values, 2, period), lambda a, x: (a * (period - 1) + x) / period))


def strength(gain: Column, loss: Column) -> Column:
    """Relative strength index of smoothed gains and losses; 100 without losses."""
    return F.when(loss == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + gain / loss))


def running_ema(values: Column, period: int) -> Column:
    """The exponential mean at every element of an array, null before the seed: one pass from a fixed first element."""
    rate = 2.0 / (period + 1)
    seed = F.array_append(F.array_repeat(F.lit(None).cast("double"), period - 1), mean_of(values, 1, period))
    rest = F.slice(values, F.lit(period + 1), F.greatest(F.size(values) - period, F.lit(0)))
    step = lambda a, x: F.array_append(a, (x - F.element_at(a, -1)) * rate + F.element_at(a, -1))
    return F.when(F.size(values) >= period, F.aggregate(rest, seed, step)).otherwise(F.transform(values, lambda x: F.lit(None).cast("double")))
