"""Schema profile, missing values, cardinality, target type and training gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featloom import constants as K
from featloom.functions.columns import CATEGORICAL, NUMERIC, class_of, col, level_key, nan_to_null, stat_rows, unpivot


def column_types(df: DataFrame) -> DataFrame:
    """Class of each column with its count of present values."""
    df = nan_to_null(df)
    kinds = {f.name: class_of(f.dataType) for f in df.schema.fields}
    return stat_rows(
        df,
        {name: {"present": F.count(col(name))} for name in kinds},
        buffers_each=1,
        facts={name: {"column_class": kind} for name, kind in kinds.items()},
    ).withColumnRenamed("feature", "column")


def missing_pct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Percent missing per column; one pass for all columns."""
    df = nan_to_null(df)
    stats = {
        c: {"n_rows": F.count(F.lit(1)), "present": F.count(col(c))} for c in (columns or df.columns)
    }
    share = F.try_divide(100.0 * (F.col("n_rows") - F.col("present")), F.col("n_rows"))
    return stat_rows(df, stats, 1).select("ordinal", F.col("feature").alias("column"), "n_rows",
                                       share.alias("missing_pct"))


def n_distinct(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct present values per column.

    Exact counting goes through (column, value) pairs, made distinct before the
    shuffle, rather than many ``count_distinct`` in one aggregate: those would
    repeat every wide row once per column. ``approximate`` uses sketches only.
    """
    if approximate:
        return stat_rows(nan_to_null(df), {c: {"n_unique": F.approx_count_distinct(col(c))} for c in columns}).select(
            F.col("feature").alias("column"), "n_unique"
        )
    pairs = unpivot(df, columns, "string").select("feature", level_key(F.col("value")).alias("value")).distinct()
    return pairs.groupBy(F.col("feature").alias("column")).agg(F.count("value").alias("n_unique"))


def schema_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: class, missing percent and, for text, cardinality."""
    kinds = {f.name: class_of(f.dataType) for f in df.schema.fields}
    text = [c for c, k in kinds.items() if k == CATEGORICAL]
    kind = F.element_at(F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair]), F.col("column"))
    base = missing_pct(df).withColumn("column_class", kind)
    if text:
        base = base.join(n_distinct(df, text, approximate), "column", "left")
    else:
        base = base.withColumn("n_unique", F.lit(None).cast("bigint"))
    pct = F.col("missing_pct")
    return base.select(
        "ordinal", "column", "column_class",
        F.when(pct > 0, F.round(pct, 1)).alias("missing_pct"),
        F.col("n_unique").cast("bigint").alias("n_unique"),
        F.coalesce(F.col("n_unique") > K.HIGH_CARDINALITY, F.lit(False)).alias("high_cardinality"),
    )


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return nan_to_null(df).where(col(target).isNotNull())


def null_target_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows kept and dropped by the missing-target filter."""
    df = nan_to_null(df)
    return df.agg(
        F.count(col(target)).alias("kept"),
        F.count_if(col(target).isNull()).alias("dropped"),
    )


def few_values(df: DataFrame, column: str, limit: int | None) -> list | None:
    """Sorted present values of a column, or None if there are more than ``limit`` (None: no limit).

    A sketch settles the clear cases in one scan without a shuffle (its error is
    far below the factor two left here); only a plausibly small set is listed.
    """
    df = nan_to_null(df)
    if limit is None:
        return sorted(r["v"] for r in df.where(col(column).isNotNull()).select(col(column).alias("v")).distinct().collect())
    rough = df.agg(F.approx_count_distinct(col(column)).alias("n")).first()["n"]
    if rough > 2 * limit + 10:
        return None
    values = df.where(col(column).isNotNull()).select(col(column).alias("v")).distinct().limit(limit + 1).collect()
    return None if len(values) > limit else sorted(r["v"] for r in values)


def target_type(df: DataFrame, target: str) -> DataFrame:
    """One row: kind of target, task, class count, usable models, validity."""
    df = nan_to_null(df)
    data_type = df.schema[target].dataType
    value = col(target)
    fractional = isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType))
    known = class_of(data_type) in (NUMERIC, CATEGORICAL) or isinstance(data_type, T.BooleanType)
    has_fraction = F.max(value % 1 != 0) if fractional else F.lit(False)
    facts = df.agg(
        F.count(value).alias("present"),
        F.count_distinct(value).alias("n_unique"),
        has_fraction.alias("has_fraction"),
    )
    kind = (
        F.when((F.col("present") == 0) | F.lit(not known), "unknown")
        .when(F.col("has_fraction"), "continuous")
        .when(F.col("n_unique") <= 2, "binary")
        .otherwise("multiclass")
    )
    task = (
        F.when(kind.isin("binary", "multiclass"), "classification")
        .when(kind == "continuous", "regression")
        .otherwise("unknown")
    )
    models = F.when(task == "classification", F.array(*[F.lit(m) for m in K.MODELS])).otherwise(
        F.array().cast("array<string>")
    )
    return facts.select(
        kind.alias("target_kind"),
        task.alias("task_type"),
        "n_unique",
        models.alias("compatible_models"),
        ((task == "classification") & (F.col("n_unique") >= 2)).alias("is_valid_for_training"),
        # An integer id column passes as a multiclass target; say so.
        ((task == "classification") & (F.col("n_unique") > K.HIGH_CARDINALITY)).alias("many_classes"),
    )


def training_gate(target_info: DataFrame, models: list[str]) -> DataFrame:
    """May each model train on this target? One row per model, with the reason."""
    asked = target_info.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return asked.select("model", *_gate(F.col("model")))


def _gate(model: Column) -> list[Column]:
    n = F.col("n_unique").cast("string")
    message = (
        F.when(
            F.col("task_type") == "regression",
            F.concat(F.lit("Skipped: Target is continuous ("), n, F.lit(" unique values). '"), model,
                     F.lit("' needs discrete class labels.")),
        )
        .when(
            F.col("n_unique") < 2,
            F.concat(F.lit("Skipped: Target has only "), n,
                     F.lit(" unique value(s). Cannot train on constant data.")),
        )
        .when(
            ~F.array_contains(F.col("compatible_models"), model),
            F.concat(F.lit("Skipped: '"), model, F.lit("' is not compatible with this target type.")),
        )
    )
    return [message.isNull().alias("is_compatible"), message.alias("message")]
