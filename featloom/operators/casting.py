"""Schema validation and all-or-nothing casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.functions.columns import col, stat_rows


def validate_schema(
    df: DataFrame, required_columns: list[str] = (), required_types: dict[str, str] | None = None
) -> DataFrame:
    """One row per asked column: expected and actual type, rows that would not
    convert, and the error text (NULL when fine)."""
    required_types = required_types or {}
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    asked = list(dict.fromkeys([*required_columns, *required_types]))
    stats, facts = {}, {}
    for name in asked:
        expected = required_types.get(name)
        differs = name in actual and expected is not None and expected != actual[name]
        bad = F.count_if(col(name).isNotNull() & col(name).try_cast(expected).isNull()) if differs else F.count(F.lit(None))
        error = None
        if name not in actual and name in required_columns:
            error = f"Missing column: {name}"
        elif differs:
            error = f"Column {name} has type {actual[name]}, expected {expected}"
        stats[name] = {"unconvertible": bad}
        facts[name] = {"expected": expected, "actual": actual.get(name), "error": error}
    return stat_rows(df, stats, 1, facts).drop("ordinal").withColumnRenamed("feature", "column")


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; one whose values do not all convert is left as it was.

    A single counting pass decides for all columns. Columns not present are
    ignored, missing values stay missing.
    """
    present = {c: t for c, t in types.items() if c in df.columns}
    if not present:
        return df
    row = df.agg(
        *[
            F.count_if(col(c).isNotNull() & col(c).try_cast(t).isNull()).alias(f"f{i}")
            for i, (c, t) in enumerate(present.items())
        ]
    ).first()
    clean = {c: t for i, (c, t) in enumerate(present.items()) if row[f"f{i}"] == 0}
    return df.withColumns({c: col(c).try_cast(t) for c, t in clean.items()}) if clean else df
