"""Scalar functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reflect(x: Column, low: float, high: float) -> Column:
    """``x`` folded back into [low, high] at its ends, as often as needed."""
    width = high - low
    along = F.pmod(x - low, F.lit(2 * width))
    return F.lit(low) + F.least(along, 2 * width - along)


def binomial(n: Column, k: int) -> Column:
    """n over k; null where n < k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return F.when(n >= k, out)


def first_at_least(sorted_values: Column, x: Column) -> Column:
    """Place (from 0) of the first value of a sorted array that is at least ``x``; its size if there is none."""
    return F.size(F.filter(sorted_values, lambda v: v < x))


def last_at_most(sorted_values: Column, x: Column) -> Column:
    """Place of the last value that is at most ``x``; -1 if there is none."""
    return F.size(F.filter(sorted_values, lambda v: v <= x)) - 1
