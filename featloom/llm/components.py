"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b); the label is the least node of its component.

    Alternating large-star and small-star steps: every node points its larger, then its
    smaller neighbours to the least one, until all edges lead to a component's least node.
    Edges never leave the cluster; a node's neighbours are never gathered in one row.
    """
    edges = cut_lineage(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where(F.col("a") != F.col("b")).distinct()  # a > b now
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut_lineage(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
