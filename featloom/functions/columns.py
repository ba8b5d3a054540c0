"""Column classes, safe column references, NaN handling and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC, CATEGORICAL, OTHER = "numeric", "categorical", "other"


def col(name: str) -> Column:
    """Reference a column whatever characters its name holds (dots, ``^``)."""
    return F.col("`" + name.replace("`", "``") + "`")


def class_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return CATEGORICAL
    return OTHER


def columns_of(df: DataFrame, kind: str, target: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if class_of(f.dataType) == kind and f.name != target]


def numeric_columns(df: DataFrame, target: str | None = None) -> list[str]:
    return columns_of(df, NUMERIC, target)


def categorical_columns(df: DataFrame, target: str | None = None) -> list[str]:
    return columns_of(df, CATEGORICAL, target)


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in float columns becomes NULL."""
    fixed = {
        f.name: F.nanvl(col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def as_double(name: str) -> Column:
    """The column as a double; NaN counts as missing."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def unpivot(df: DataFrame, columns: list[str], cast: str, ids: list[str] = ()) -> DataFrame:
    """Long form ``ids…, feature, value``; a narrow step, no shuffle."""

    def typed(c):
        floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        # -0.0 counts as 0.0 and NaN as missing
        return (as_double(c) + 0.0 if floating else col(c)).cast(cast).alias(c)

    wide = df.select(*[col(i) for i in ids], *[typed(c) for c in columns])
    return wide.unpivot([col(i) for i in ids], [col(c) for c in columns], "feature", "value")


LONG_TEXT = 64  # characters


def level_key(text: Column) -> Column:
    """Stand-in for a text where only equality matters.

    Long texts are replaced by their SHA-256, so that counting distinct
    documents moves 64 characters per text instead of the text.
    """
    return F.when(F.length(text) > LONG_TEXT, F.sha2(text, 256)).otherwise(text)


# Aggregate buffers one generated method can hold and still be compiled by the JVM.
BUFFERS_PER_SCAN = 48


def batches(features: list[str], buffers_each: int) -> list[list[str]]:
    """Split features into groups whose aggregates fit one compiled method.

    Each group is a scan of its own columns only, so a columnar source reads
    every column once however many groups there are.
    """
    size = max(1, BUFFERS_PER_SCAN // max(buffers_each, 1))
    return [features[i : i + size] for i in range(0, len(features), size)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def stat_rows(
    df: DataFrame, stats: dict[str, dict[str, Column]], buffers_each: int = 4, facts: dict[str, dict] | None = None
) -> DataFrame:
    """Aggregates of many features, returned as one row per feature.

    ``stats`` maps a feature to its named aggregates; every feature must carry
    the same names. ``facts`` adds known values to a feature's row.
    ``buffers_each`` is the number of running values a feature's aggregates keep
    (a variance counts three).
    """
    position = {feature: i for i, feature in enumerate(stats)}
    names = list(next(iter(stats.values())))
    parts = []
    for group in batches(list(stats), buffers_each):
        row = df.agg(
            *[stats[f][name].alias(f"s{position[f]}_{name}") for f in group for name in names]
        )
        structs = [
            F.struct(
                F.lit(position[f]).alias("ordinal"),
                F.lit(f).alias("feature"),
                *[F.col(f"s{position[f]}_{name}").alias(name) for name in names],
                *[F.lit(v).cast("string").alias(k) for k, v in (facts or {}).get(f, {}).items()],
            )
            for f in group
        ]
        parts.append(row.select(F.inline(F.array(*structs))))
    return union_all(parts)


def stat_values(df: DataFrame, stats: dict[str, dict[str, Column]], buffers_each: int = 4) -> dict[str, dict]:
    """``stat_rows`` fetched: a few numbers per column."""
    if not stats:
        return {}
    return {r["feature"]: r.asDict() for r in stat_rows(df, stats, buffers_each).collect()}
