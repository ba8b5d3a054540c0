"""Position of each level in sorted order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from featloom.session import cut_lineage


def rank_levels(levels: DataFrame, partitions: int, level: str = "level") -> DataFrame:
    """Add ``code`` = 0-based rank of distinct, non-null ``level`` values.

    The levels are range-partitioned, so each partition holds one stretch of
    the order; the rank is the rank inside the partition plus the sizes of the
    partitions before it. The partitioned table is checkpointed first: both the
    sizes and the ranks must see the very same stretches, even if an executor
    is lost in between.
    """
    spread = levels.repartitionByRange(partitions, level)
    stretch = cut_lineage(spread.withColumn("__p", F.spark_partition_id()))
    sizes = stretch.groupBy("__p").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(
        "__p",
        F.coalesce(
            F.sum("size").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(level))
    return (
        stretch.withColumn("__r", inside)
        .join(F.broadcast(before), "__p")  # one row per partition
        .withColumn("code", (F.col("before") + F.col("__r") - 1).cast("bigint"))
        .drop("__p", "__r", "before")
    )
