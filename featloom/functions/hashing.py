"""Reproducible pseudo-random numbers from row keys.

``rand(seed)`` depends on how rows are spread over partitions; a hash of the
row key does not, so a split stays the same after any repartitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from featloom.constants import SEED
from featloom.functions.columns import col

HASH_BITS = 52  # 13 hex digits: exact in a double
HEX_DIGITS = 13


def key_hash(keys: list[str], seed: int | str = SEED) -> Column:
    """52-bit integer from md5 of ``seed:key|key…``."""
    text = F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *[col(k).cast("string") for k in keys]))
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("bigint")


def key_uniform(keys: list[str], seed: int | str = SEED) -> Column:
    """Uniform number in [0, 1) from the row key."""
    return key_hash(keys, seed).cast("double") / F.lit(float(2**HASH_BITS))
