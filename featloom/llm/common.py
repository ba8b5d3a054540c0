"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it: space, tab, \n, \v, \f, \r.
WHITE = "[\\x20\\x09-\\x0D]"
#: A key is hot from this share of all rows on, so at most 1,000 keys are ever hot.
HOT_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` does the same where all is ASCII, and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Equi-join of rows with one row per group, even where a group holds a third of the rows.

    Groups of more than ``HOT_SHARE`` of all grouped rows (``size`` sums to their number, so
    there are at most 1,000) are broadcast; their rows never shuffle. The two halves are
    separate frames, so no group larger than that share meets in one task.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > max(1000.0, total * HOT_SHARE))
    marked = rows.join(F.broadcast(hot.select(*keys).withColumn("__hot", F.lit(True))), keys, "left")
    rest = marked.where(F.col("__hot").isNull()).drop("__hot")
    return reduce(DataFrame.unionByName, [
        rest.join(groups, keys, how),
        marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot), keys, "inner"),
    ])


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, wherever its file system is."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def give_back() -> None:
    """Memory that earlier tasks of this worker have freed goes back to the system.

    Workers are used again by stage after stage; what one stage held for a while would else stay
    with them and count beside what the next one needs.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes, equal bytes of neighbouring values side by side."""
    raw = np.ascontiguousarray(values)
    return pa.compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes(), codec="zstd", asbytes=True) if len(raw) else b""


def unsqueeze(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()
