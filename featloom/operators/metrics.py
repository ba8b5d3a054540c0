"""Accuracy and weighted F1 from confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featloom.functions.columns import col


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: ``accuracy, f1_score`` (F1 per class, weighted by support).

    The rows are counted once into class pairs; the rest works on those.
    """
    cells = confusion(df, label, prediction)
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(none)
    # Each cell adds to the support of its label and to the calls of its prediction.
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), none.alias("called"), hit.alias("tp")),
                F.struct(F.col("prediction").alias("class"), none.alias("support"), F.col("n").alias("called"), none.alias("tp")),
            )
        )
    )
    by_class = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "tp")])
    f1 = F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("called"))
    return by_class.agg(
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(F.col("support") * f1), F.sum("support")).alias("f1_score"),
    )
