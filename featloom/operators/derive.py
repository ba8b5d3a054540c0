"""Derived features: products of pairs and powers. Map-only projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.functions.columns import as_double, numeric_columns


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Add ``a_x_b`` for pairs of numeric columns that exist; others are skipped."""
    numeric = set(numeric_columns(df))
    new = {f"{a}_x_{b}": as_double(a) * as_double(b) for a, b in pairs if {a, b} <= numeric}
    return df.withColumns(new) if new else df


def polynomials(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """Add ``c^d`` for d = 2 … degree, without cross terms."""
    numeric = set(numeric_columns(df))
    new = {
        f"{c}^{d}": F.pow(as_double(c), F.lit(float(d)))
        for c in columns
        if c in numeric
        for d in range(2, degree + 1)
    }
    return df.withColumns(new) if new else df
