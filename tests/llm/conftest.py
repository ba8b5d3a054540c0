import os

import pytest
from pyspark.sql import functions as F

CLASH = ["id", "text_", "items", "spans", "n", "sig", "known", "h1", "kept", "p_toxic", "token", "end"]


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows, clash=True):
        frame = spark.createDataFrame(list(rows), "doc_id long, text string")
        return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]) if clash else frame

    return make


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
