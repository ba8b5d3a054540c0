"""Random Fourier features: a linear model on them approximates an RBF kernel.

Rahimi and Recht (2007). The map is a fixed small matrix, so each row is
projected on its own; nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from featloom.constants import SEED

DIMENSIONS = 128


@dataclass(frozen=True)
class FourierMap:
    weights: np.ndarray  # features x dimensions
    offsets: np.ndarray

    def apply(self, df: DataFrame) -> DataFrame:
        """Replace the ``features`` vector by its projection."""
        weights, offsets = self.weights, self.offsets
        size = math.sqrt(2.0 / len(offsets))

        @F.arrow_udf("array<double>")
        def project(x: pa.Array) -> pa.Array:
            # Whole batches as one block of numbers: no row becomes a Python object.
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(weights))
            made = size * np.cos(rows @ weights + offsets)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(offsets)), pa.array(made.ravel()))

        return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


def fit_fourier_map(data: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> FourierMap:
    """Kernel width 1 / (number of features x variance of all feature values)."""
    x = data.select(vector_to_array("features").alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    facts = x.agg(F.max(F.size("x")).alias("d"), F.avg(total / F.size("x")).alias("mean")).first()
    width, mean = facts["d"], facts["mean"]
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    variance = x.agg(F.avg(squares / F.size("x")).alias("v")).first()["v"]
    gamma = 1.0 / (width * variance) if variance else 1.0
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, math.sqrt(2.0 * gamma), (width, dimensions))
    return FourierMap(weights, rng.uniform(0.0, 2.0 * math.pi, dimensions))
