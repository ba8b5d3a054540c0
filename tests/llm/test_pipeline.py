"""The pipeline on the given documents, stage by stage against brute force."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from test_dedup_ops import brute_classes
from test_text_ops import brute_hits
from tokenizers import Tokenizer

import corpus_pipeline
from featloom.llm import queries, toxicity


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.fit(docs, labels, queries.TOXIC_CATEGORIES)
    kept = {r.doc_id: r.text for r in toxicity.predict(docs, chain).where("p_toxic < 0.5").collect()}
    assert 0 < len(kept) < docs.count()

    groups = {}
    for i, text in sorted(kept.items()):
        groups.setdefault(text.translate({c: None for c in (32, *range(9, 14))}), []).append((-len(text), i))
    kept = {i: kept[i] for _, i in (min(g) for g in groups.values())}
    kept = {i: kept[i] for i, _, least in brute_classes(sorted(kept.items())) if i == least}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {}
    for i, text in kept.items():
        n, hit, _ = brute_hits(text, items)
        if not (hit and 20 * hit >= n):
            clean[i] = text
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for i, text in clean.items():
        ids = library.encode(text, add_special_tokens=False).ids
        expected[i] = (ids, hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == expected


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).withColumn("p_toxic", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
