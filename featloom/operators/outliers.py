"""Clip or remove values far from the mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featloom import constants as K
from featloom.functions.columns import as_double, stat_values

Bounds = dict[str, tuple[float | None, float | None]]


def outlier_bounds(df: DataFrame, columns: list[str], threshold: float = K.OUTLIER_STDS) -> Bounds:
    """mean ± threshold · sample std for all columns in one pass."""
    stats = {c: {"mean": F.avg(as_double(c)), "std": F.stddev_samp(as_double(c))} for c in columns}
    bounds = {}
    for c, r in stat_values(df, stats, 5).items():
        known = r["mean"] is not None and r["std"] is not None
        gap = threshold * r["std"] if known else None
        bounds[c] = (r["mean"] - gap, r["mean"] + gap) if known else (None, None)
    return bounds


def _clipped(c: str, low: float | None, high: float | None) -> Column:
    x = as_double(c)
    if low is None:
        return x
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def clip_outliers(df: DataFrame, columns: list[str], threshold: float = K.OUTLIER_STDS) -> DataFrame:
    """Pull values to the bounds; missing stays missing."""
    if not columns:
        return df
    bounds = outlier_bounds(df, columns, threshold)
    return df.withColumns({c: _clipped(c, *bounds[c]) for c in columns})


def _within(c: str, low: float | None, high: float | None) -> Column:
    # An undefined spread keeps nothing: every comparison with it is not true.
    return F.lit(False) if low is None else as_double(c).between(low, high)


def remove_outliers(
    df: DataFrame, columns: list[str], threshold: float = K.OUTLIER_STDS, sequential: bool = True
) -> DataFrame:
    """Keep rows inside the bounds; rows missing a checked value go.

    Sequential (default): each column's bounds come from the rows the columns
    before it left, so the column order matters. The bounds found so far are
    literals in one filter on the source, so no pass builds on an earlier
    pass's plan. ``sequential=False`` takes all bounds from the original rows
    in one pass.
    """
    if not columns:
        return df
    if not sequential:
        bounds = outlier_bounds(df, columns, threshold)
        steps = list(bounds.items())
    else:
        steps = []
        for c in columns:
            kept = df
            for done, (low, high) in steps:
                kept = kept.where(_within(done, low, high))
            steps.append((c, outlier_bounds(kept, [c], threshold)[c]))
    for c, (low, high) in steps:
        df = df.where(_within(c, low, high))
    return df


def handle_outliers(df: DataFrame, columns: list[str], method: str = "clip", threshold: float = K.OUTLIER_STDS) -> DataFrame:
    if method == "none" or not columns:
        return df
    if method == "clip":
        return clip_outliers(df, columns, threshold)
    if method == "remove":
        return remove_outliers(df, columns, threshold)
    raise ValueError(f"unknown outlier method: {method}")
