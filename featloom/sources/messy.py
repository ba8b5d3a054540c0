"""A generated table with missing values, reproducible on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from featloom.constants import SEED
from featloom.functions.hashing import key_uniform

# --- fixed values: distribution of the generated columns ---------------------------
AGE_MEAN, AGE_STD = 35.0, 10.0
INCOME_MEAN, INCOME_STD = 50_000.0, 15_000.0
CREDIT_LOW, CREDIT_HIGH = 300, 850
YEARS_MEAN = 5.0
EDUCATION = ["High School", "Bachelors", "Masters", "PhD"]
EDUCATION_SHARES = [0.3, 0.4, 0.2, 0.1]
CITIES = ["New York", "London", "Paris", "Tokyo", "Mumbai"]
GENDERS = ["Male", "Female", "Non-Binary"]
NOISE_STD = 0.1
INCOME_MISSING, EDUCATION_MISSING = 0.1, 0.05


def _uniform(salt: str) -> Column:
    return key_uniform(["id"], f"{SEED}:{salt}")


def _normal(salt: str) -> Column:
    """Box–Muller from two uniforms of the row."""
    radius = F.sqrt(-2.0 * F.ln(1.0 - _uniform(salt + "r")))
    return radius * F.cos(2.0 * math.pi * _uniform(salt + "a"))


def _choice(salt: str, values: list[str], shares: list[float] | None = None) -> Column:
    shares = shares or [1.0 / len(values)] * len(values)
    upto, pick, u = 0.0, None, _uniform(salt)
    for value, share in zip(values[:-1], shares):
        upto += share
        pick = F.when(u < upto, value) if pick is None else pick.when(u < upto, value)
    return pick.otherwise(values[-1])


def messy_table(ids: DataFrame) -> DataFrame:
    """Messy feature table with one row per ``id`` of ``ids``.

    ``Purchased`` is 1 above the mean of a score over all rows, then 10 % of
    ``Income`` and 5 % of ``Education`` are blanked. Every value depends on the
    id alone, so the table is the same however it is partitioned.
    """
    age_real = F.lit(AGE_MEAN) + F.lit(AGE_STD) * _normal("age")
    full = ids.select("id").withColumns(
        {
            "Age": F.when(age_real < 0, F.ceil(age_real)).otherwise(F.floor(age_real)).cast("bigint"),
            "Income": F.lit(INCOME_MEAN) + F.lit(INCOME_STD) * _normal("income"),
            "CreditScore": (F.floor(_uniform("credit") * (CREDIT_HIGH - CREDIT_LOW)) + CREDIT_LOW).cast("bigint"),
            "YearsEmployed": -YEARS_MEAN * F.ln(1.0 - _uniform("years")),
            "Education": _choice("education", EDUCATION, EDUCATION_SHARES),
            "City": _choice("city", CITIES),
            "Gender": _choice("gender", GENDERS),
        }
    )
    score = F.col("Income") / 100_000.0 + F.col("Age") / 100.0 + F.lit(NOISE_STD) * _normal("noise")
    mean = full.agg(F.avg(score).alias("m")).first()["m"] or 0.0
    return full.withColumn("Purchased", (score > F.lit(mean)).cast("int")).withColumns(
        {
            "Income": F.when(_uniform("gap_income") >= INCOME_MISSING, F.col("Income")),
            "Education": F.when(_uniform("gap_education") >= EDUCATION_MISSING, F.col("Education")),
        }
    )


def generate_messy(spark: SparkSession, n_rows: int = 500, partitions: int | None = None) -> DataFrame:
    """Messy table of ``n_rows`` rows without an id column."""
    ids = spark.range(0, n_rows, 1, partitions) if partitions else spark.range(n_rows)
    return messy_table(ids).drop("id")
