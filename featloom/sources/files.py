"""Parquet and CSV input with typed columns and load facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featloom import constants as K
from featloom.functions.columns import col, nan_to_null
from featloom.operators.sampling import sample_random

# --- fixed values: texts read as a number / as a truth value ----------------------
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
BOOLEAN_TEXTS = ["True", "TRUE", "true", "False", "FALSE", "false"]


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV with header; missing-value texts become NULL, types come from the data.

    Everything is read as text first, because one ``NA`` would otherwise turn a
    numeric column into text. One counting pass over all columns then decides:
    integer, double, boolean or text. ``multiline`` allows quoted line breaks;
    such files cannot be split, so pass False for large files without them.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        .option("inferSchema", False).csv(path)
    )
    text = raw.select(
        *[F.when(~col(c).isin(K.CSV_MISSING), col(c)).alias(c) for c in raw.columns]
    )
    tests = {
        "present": lambda c: F.count(c),
        "integer": lambda c: F.count_if(c.rlike(INTEGER_PATTERN) & c.try_cast("bigint").isNotNull()),
        "number": lambda c: F.count_if(c.rlike(NUMBER_PATTERN)),
        "boolean": lambda c: F.count_if(c.isin(BOOLEAN_TEXTS)),
    }
    row = text.agg(
        *[test(col(c)).alias(f"{name}{i}") for i, c in enumerate(text.columns) for name, test in tests.items()]
    ).first()
    typed = []
    for i, c in enumerate(text.columns):
        present = row[f"present{i}"]
        kind = next(
            (t for name, t in (("integer", "bigint"), ("number", "double"), ("boolean", "boolean"))
             if present and row[f"{name}{i}"] == present),
            "double" if not present else "string",
        )
        typed.append(col(c).try_cast(kind).alias(c) if kind != "string" else col(c))
    return text.select(*typed)


def file_size_mb(spark: SparkSession, path: str) -> float:
    """Total size of the files below ``path``, from their listing; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return (files.agg(F.sum("length").alias("b")).first()["b"] or 0) / (1024.0 * 1024.0)


def row_count(df: DataFrame) -> DataFrame:
    """Number of records (not of text lines); Parquet answers from its footers."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def cap_rows(df: DataFrame, max_rows: int | None, keys: list[str] | None = None) -> DataFrame:
    """Optional cap on the rows loaded: a reproducible sample, off by default.

    Partitions have no file order to take the "first" rows from, so the rows
    with the smallest key hashes are taken instead.
    """
    return df if max_rows is None else sample_random(df, max_rows, keys or df.columns)


def load_metadata(source: DataFrame, loaded: DataFrame, size_mb: float | None = None) -> DataFrame:
    """One row: total and loaded rows, columns, size, whether it is a sample."""
    total = source.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("one", F.lit(1))
    got = loaded.agg(F.count(F.lit(1)).alias("loaded_rows")).withColumn("one", F.lit(1))
    return total.join(got, "one").select(  # two one-row tables
        "total_rows", "loaded_rows",
        F.lit(len(loaded.columns)).alias("columns"),
        F.lit(size_mb).cast("double").alias("file_size_mb"),
        (F.col("loaded_rows") < F.col("total_rows")).alias("is_sampled"),
    )


def load_with_metadata(
    spark: SparkSession, path: str, max_rows: int | None = None, keys: list[str] | None = None, multiline: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(table, metadata row). Reader errors are raised, not hidden."""
    source = read_csv(spark, path, multiline)
    loaded = cap_rows(source, max_rows, keys)
    return loaded, load_metadata(source, loaded, file_size_mb(spark, path))


def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """First rows by key; each task keeps only ``rows`` of them."""
    return df.orderBy(col(key)).limit(rows)
