"""Aggregate expressions that stay defined on constant and empty input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sum_of_squares_ratio(
    n: Column, mean: Column, var: Column, grand: Column, low: Column, high: Column
) -> Column:
    """η² from per-group count, mean, population variance, min and max.

    Aggregates ``Σ n(m-M)²`` against that plus the within-group squares; no
    difference of large sums is taken. 0 when no rows exist or all values are
    equal (means of equal values may differ by rounding, so the range decides).
    """
    between = F.sum(n * F.pow(mean - grand, F.lit(2.0)))
    within = F.sum(n * var)
    ratio = F.try_divide(between, between + within)
    return F.when(F.max(high) > F.min(low), F.coalesce(ratio, F.lit(0.0))).otherwise(0.0)
