"""Apply a preparation fitted on a batch table to a stream.

``FittedPrep.apply`` is a projection with broadcast look-ups of fixed level
tables, so it needs no state and no watermark: each micro-batch is prepared on
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from featloom.operators.preprocess import FittedPrep


def prepare_stream(stream: DataFrame, prep: FittedPrep) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame; use FittedPrep.apply")
    large = [c for c, t in prep.encoder.tables.items() if t.table is not None]
    if large:
        # A large table would be shuffled against every micro-batch.
        raise ValueError(f"level tables too large to broadcast into a stream: {large}")
    return prep.apply(stream)
