"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; only its
128-bit hash travels. The keys of a batch of documents, with their number of documents and
largest doc_id, become a sorted run: a table bucketed and sorted by the hash. A new batch is
first merge-anti-joined with the runs, so keys that are settled there (frequent enough, with a
doc_id at least as large) are not stored again; the rest is added as a run of level 0.
``fanout`` runs of one level are compacted into one of the next, so every entry is rewritten
once per level. Runs never shuffle for the join: bucket meets bucket.

Keys shorter than ``least_chars`` code points or found in fewer than ``min_docs`` documents
stay. Of the others all lines go, except in the largest doc_id that holds the key. Null and
empty texts are one empty line. Rows that share a doc_id are one document; a null doc_id is
smaller than any other. An empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.common import ascii_lower, join_groups, remove_path, text_of
from featloom.session import cut_lineage, scratch_path

MIN_DOCS = 3
LEAST_CHARS = 20


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


class LineRuns:
    """Levels of sorted runs (h1, h2, docs, top) in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_path(self.spark, f"{self.folder}/{name}")

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def merged(self, names: list[str]) -> DataFrame:
        """The runs' entries, added up key by key.

        Merged by join, bucket against bucket. A union of bucketed tables keeps their
        partitioning in the plan of Spark 4.1.2 but not in what it reads, and loses sums.
        """
        first, *others = names
        out = self.spark.table(first)
        for name in others:
            run = self.spark.table(name).withColumnsRenamed({"docs": "_d", "top": "_t"})
            out = out.join(run, ["h1", "h2"], "full_outer").select(
                "h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("_d", F.lit(0))).alias("docs"), F.greatest("top", "_t").alias("top"))
        return out

    def add(self, batch: DataFrame) -> None:
        """Adds the keys (h1, h2, docs, top) of one batch of documents; no document may be in two batches."""
        for name in self.tables():
            run = self.spark.table(name).where(F.col("docs") >= self.min_docs).withColumnsRenamed({"docs": "_d", "top": "_t"})
            settled = F.col("top").isNull() | (F.col("_t") >= F.col("top"))
            batch = batch.join(run, (batch.h1 == run.h1) & (batch.h2 == run.h2) & F.coalesce(settled, F.lit(False)), "left_anti")
        self.levels[0].append(self._write(batch))
        self.compact()

    def compact(self) -> None:
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fanout:
                old, self.levels[depth] = self.levels[depth], []
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._write(self.merged(old)))
                for name in old:
                    self._drop(name)

    def frequent(self) -> DataFrame:
        """Keys of at least ``min_docs`` documents, out of all runs."""
        return self.merged(self.tables()).where(F.col("docs") >= self.min_docs)

    def close(self) -> None:
        for name in self.tables():
            self._drop(name)
        self.levels = [[]]
        remove_path(self.spark, self.folder)


def line_keys(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(id, mark, pos, h1, h2) of each line long enough; ``mark`` tells texts of one id apart."""
    text = text_of(text_col)
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.posexplode(split_lines(text)).alias("pos", "line"))
    keyed = lines.select("id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keyed.select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                least_chars: int = LEAST_CHARS, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped`` (columns of these names are replaced).

    Documents come in ``batches`` by a hash of their id, as arriving deliveries would.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "line-keys")
    batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
    line_keys(docs, id_col, text_col, least_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
    keys = spark.read.schema("id " + docs.schema[id_col].dataType.simpleString() + ", mark long, pos int, h1 long, h2 long, batch int").parquet(folder)
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        one = keys.where(F.col("batch") == b).select("h1", "h2", "id").distinct().groupBy("h1", "h2")
        runs.add(one.agg(F.count("*").alias("docs"), F.max("id").alias("top")))
    frequent = cut_lineage(runs.frequent())
    runs.close()
    lost = join_groups(keys.drop("batch"), frequent, ["h1", "h2"], "docs").where(~F.col("id").eqNullSafe(F.col("top")))
    drops = cut_lineage(lost.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list("pos").alias("__drop")))
    remove_path(spark, folder)
    marked = docs.withColumn("__text", text_of(text_col)).withColumn("__own", F.xxhash64("__text"))
    joined = marked.join(drops, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left")
    lines = split_lines(F.col("__text"))
    places = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("__drop"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("__lines"), i)), "\n")
    # The lines are cut once, in a projection of their own: inside the loop they would be cut per line.
    sized = joined.withColumn("__lines", F.when(F.col("__drop").isNotNull(), lines)).withColumn(
        "n_lines", F.coalesce(F.size(F.col("__lines")), F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1).cast("long"))
    return sized.select(
        *[F.col(c) for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")], F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(kept).alias("kept_text"),
        "n_lines", F.coalesce(F.size(F.array_distinct("__drop")), F.lit(0)).cast("long").alias("n_dropped"))
