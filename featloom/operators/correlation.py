"""Correlation matrix, collinear pairs, ranking against the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom import constants as K
from featloom.functions.columns import NUMERIC, as_double, class_of, col, numeric_columns
from featloom.operators.encode import attach_codes, fit_levels
from featloom.operators.moments import pair_correlations


def corr_pairs_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """r of every pair i ≤ j, long form: half the matrix, one scan."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    names = F.array(*[F.lit(c) for c in columns])
    return pair_correlations(df, columns, pairs).select(
        "i", "j",
        F.element_at(names, F.col("i") + 1).alias("feature_a"),
        F.element_at(names, F.col("j") + 1).alias("feature_b"),
        "corr",
    )


def corr_matrix(df: DataFrame, target: str | None = None) -> DataFrame | None:
    """Full symmetric matrix as rows; None without numeric columns."""
    columns = numeric_columns(df, target)
    if not columns:
        return None
    half = corr_pairs_all(df, columns)
    both = F.when(
        F.col("i") == F.col("j"), F.array(F.struct("feature_a", "feature_b"))
    ).otherwise(
        F.array(
            F.struct("feature_a", "feature_b"),
            F.struct(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b")),
        )
    )
    return half.select(F.inline(both), "corr")


def collinear_pairs(df: DataFrame, target: str | None = None, threshold: float = K.PAIR_THRESHOLD) -> DataFrame:
    """Pairs with |r| at or above the threshold, in column order.

    ``corr`` is the absolute value, ``signed_corr`` keeps the sign.
    """
    columns = numeric_columns(df, target)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame(
            [], "i int, j int, feature_a string, feature_b string, pair string, corr double, signed_corr double"
        )
    return (
        corr_pairs_all(df, columns)
        .where((F.col("i") < F.col("j")) & (F.abs("corr") >= threshold))
        .select("i", "j", "feature_a", "feature_b",
                F.concat_ws(" ↔ ", "feature_a", "feature_b").alias("pair"),
                F.abs("corr").alias("corr"), F.col("corr").alias("signed_corr"))
    )


def corr_to_target(df: DataFrame, target: str) -> DataFrame:
    """|r| of numeric features with the target, largest first, undefined left out.

    A text target is replaced by the rank of its class among those present (missing -> −1).
    """
    features = numeric_columns(df, target)
    if not features:
        return df.sparkSession.createDataFrame([], "ordinal int, feature string, corr double")
    if class_of(df.schema[target].dataType) == NUMERIC:
        coded = df.withColumn("__y", as_double(target))
    else:
        levels = fit_levels(df.where(col(target).isNotNull()), [target])[target]  # present classes only
        coded = attach_codes(df, target, levels, "__y", missing=None, on_unseen="null")
        coded = coded.withColumn("__y", F.coalesce(F.col("__y"), F.lit(-1)).cast("double"))
    ordered = [*features, "__y"]
    found = pair_correlations(coded, ordered, [(i, len(features)) for i in range(len(features))])
    names = F.array(*[F.lit(c) for c in features])
    return (
        found.where(F.col("corr").isNotNull())
        .select(F.col("i").alias("ordinal"), F.element_at(names, F.col("i") + 1).alias("feature"),
                F.abs("corr").alias("corr"))
        .orderBy(F.desc("corr"), "ordinal")
    )
