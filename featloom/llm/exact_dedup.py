"""Exact duplicates by two-pass Bloom filtering.

Texts are equal when identical after deleting ASCII white space. The first pass over the
fingerprints tells which may be repeated (see ``bloom``). Only those rows shuffle; the
others pass straight through as groups of one.

Null text counts as empty, so null, empty and blank texts are one group. Of equal texts the
one with the most code points stays, then the smallest doc_id (null last), then any one of
fully equal rows. An empty table gives an empty result; other columns are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm import bloom
from featloom.llm.common import WHITE, join_groups, sha256, text_of
from featloom.session import cut_lineage


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_of(text_col), f"{WHITE}+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: id, digest of the normalised text, length, fingerprint."""
    return (docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"),
                        F.length(text_of(text_col)).alias("points"))
            .select("id", "points", F.unhex(sha256(F.col("norm"))).alias("digest"), F.xxhash64("norm").alias("print")))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    bits_per_row: int = 16, max_filter_bytes: int = 1 << 26) -> DataFrame:
    """Per document: ``id_col``, keep_id, group_size, kept, digest (binary).

    ``max_filter_bytes`` bounds the broadcast filter. Texts never shuffle, only digests of
    rows that may be repeated.
    """
    spark = docs.sparkSession
    rows = cut_lineage(digests(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    seen = bloom.repeated_bits(rows.select("print"), rows.count(), bits_per_row, max_filter_bytes)
    tested = rows.withColumn("maybe", bloom.may_repeat(F.col("print"), seen, spark)).drop("print")
    maybe = tested.where("maybe").drop("maybe")
    groups = cut_lineage(
        maybe.groupBy("digest")
        .agg(F.min(F.struct((-F.col("points")).alias("p"), F.isnull("id").alias("n"), F.col("id").alias("i"),
                            F.col("row").alias("r"))).alias("first"), F.count("*").alias("group_size"))
        .select("digest", F.col("first.i").alias("keep_id"), F.col("first.r").alias("keep_row"), "group_size"))
    grouped = join_groups(maybe, groups, ["digest"], "group_size").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
    alone = tested.where(~F.col("maybe")).select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "digest")
    return alone.unionByName(grouped)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    bits_per_row: int = 16, max_filter_bytes: int = 1 << 26) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows whose fingerprint occurs once never leave their task; of the others only the chosen
    row of each group gets through the semi-join, keyed by digest, length and id, so copies
    of one text spread over all tasks.
    """
    spark = docs.sparkSession
    rows = cut_lineage(digests(docs, id_col, text_col))
    seen = bloom.repeated_bits(rows.select("print"), rows.count(), bits_per_row, max_filter_bytes)
    first = (rows.where(bloom.may_repeat(F.col("print"), seen, spark))
             .groupBy(F.col("digest").alias("__d"))
             .agg(F.min(F.struct((-F.col("points")).alias("p"), F.isnull("id").alias("n"), F.col("id").alias("i"))).alias("first"))
             .select("__d", F.col("first.p").alias("__p"), F.col("first.i").alias("__i")))
    norm = docs.withColumn("__n", normalised(text_col))
    tested = norm.withColumn("__maybe", bloom.may_repeat(F.xxhash64("__n"), seen, spark))
    maybe = (tested.where("__maybe")
             .withColumn("__digest", F.unhex(sha256(F.col("__n")))).withColumn("__points", -F.length(text_of(text_col))))
    chosen = maybe.join(first, (F.col("__digest") == F.col("__d")) & (F.col("__points") == F.col("__p"))
                        & F.col(id_col).eqNullSafe(F.col("__i")), "left_semi").dropDuplicates(["__digest"])
    return tested.where(~F.col("__maybe")).select(*docs.columns).unionByName(chosen.select(*docs.columns))
