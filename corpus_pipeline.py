"""From raw documents to training tokens: five stages over whole tables.

Toxic documents go, then exact copies, near copies and documents covered by benchmark
passages; what is left is encoded. Every stage is written as Parquet in the shared folder and
read again by the next one, so a lost executor costs at most a stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import bpe, decontaminate, exact_dedup, jaccard, queries, toxicity
from featloom.llm.common import remove_path, sha256, table
from featloom.plans.registry import query
from featloom.session import scratch_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones, gives less than even odds of being toxic."""
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.fit(docs, labels, queries.TOXIC_CATEGORIES)
    scored = toxicity.predict(docs, chain, prefix="__p_", carry=docs.columns)
    return scored.where(F.col("__p_toxic") < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the contamination rule go; the others keep their text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Token ids per document, with digests of the ids and of the decoded text."""
    words = bpe.Vocabulary(public_tokenizers.path(vocabulary))
    ids = bpe.encode(docs, words, carry=["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                      sha256(bpe.decode(F.col("ids"), words, spark)).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard", drop_near_copies),
    ("decontaminate", drop_benchmarks),
    ("bpe", encode),
]
#: The classifier, the tokenizer and classes of links have no SQL; tests compare with brute force.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL, tested_by="tests/llm/test_pipeline.py::test_pipeline_against_brute_force")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)  # its rows are in the next stage's table
        before = path
    return docs
