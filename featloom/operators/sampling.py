"""Exact-size samples and stable splits from row-key hashes.

No row is ordered against the whole table. One small histogram of hash values
per class tells where the wanted number of rows ends; everything below that
hash bucket is taken by a plain filter, and only the rows of the one bucket on
the edge are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from featloom import constants as K
from featloom.functions.columns import col, nan_to_null
from featloom.functions.hashing import HASH_BITS, key_hash, key_uniform
from featloom.session import cut_lineage

BUCKET_BITS = 16


def sample_random(df: DataFrame, max_rows: int, keys: list[str], seed: int = K.SEED) -> DataFrame:
    """Exactly ``max_rows`` rows with the smallest key hashes; all if fewer exist.

    ``keys`` should identify a row; rows sharing a key share a hash and are
    taken in any order once the sample is nearly full. Without keys the whole
    row is the key.
    """
    return _take(df, max_rows, keys, seed, None)


def sample_stratified(
    df: DataFrame, max_rows: int, target: str, keys: list[str], seed: int = K.SEED
) -> DataFrame:
    """Proportional sample of ``max_rows`` rows over the target's classes.

    Falls back to a plain sample unless the target is complete, has 2 to 20
    classes, no class with a single row, and room for every class on both sides. Class shares are rounded by largest
    remainder, so the total is exact. ``stratified_sample`` says which of the two it was.
    """
    return stratified_sample(df, max_rows, target, keys, seed)[0]


def stratified_sample(
    df: DataFrame, max_rows: int, target: str, keys: list[str], seed: int = K.SEED, on_impossible: str = "plain"
) -> tuple[DataFrame, DataFrame]:
    """The sample, and one row that says how it was drawn: ``strategy, reason, rows, classes``.

    ``strategy`` is ``all`` (no more rows than asked for), ``stratified`` or ``plain``; ``reason`` tells
    why not stratified. ``on_impossible="error"`` refuses with ``ValueError`` instead of a plain sample.
    ``classes`` counts the target's levels, missing among them; null where they are too many to be listed.
    """
    if on_impossible not in ("plain", "error"):
        raise ValueError(f"unknown on_impossible: {on_impossible}")
    clean = nan_to_null(df.select(col(target).alias("t")))
    facts = clean.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("t").alias("rough")).first()
    sizes = None
    # A sketch above twice the limit settles it; otherwise the exact sizes decide.
    if facts["rough"] <= 2 * K.STRATIFY_MAX_CLASSES + 10:
        sizes = {r["t"]: r["count"] for r in clean.groupBy("t").count().collect()}  # about twice the limit at most
    reason = None if facts["rows"] <= max_rows else stratify_refusal(sizes, max_rows)
    if reason and on_impossible == "error":
        raise ValueError(f"no stratified sample over {target}: {reason}")
    strategy = "all" if facts["rows"] <= max_rows else "plain" if reason else "stratified"
    outcome = df.sparkSession.createDataFrame(
        [(strategy, reason, min(facts["rows"], max(max_rows, 0)), None if sizes is None else len(sizes))],
        "strategy string, reason string, rows bigint, classes int")
    return _take(df, max_rows, keys, seed, None if reason else target if sizes is not None else None), outcome


def stratify_refusal(sizes: dict | None, max_rows: int) -> str | None:
    """Why the classes of these sizes allow no stratified sample; None if they do."""
    if sizes is None or len(sizes) > K.STRATIFY_MAX_CLASSES:
        return f"more than {K.STRATIFY_MAX_CLASSES} classes"
    if None in sizes:
        return "missing values in the target"
    if len(sizes) < K.STRATIFY_MIN_CLASSES:
        return f"fewer than {K.STRATIFY_MIN_CLASSES} classes"
    if min(sizes.values()) <= 1:
        return "a class of one row"
    if len(sizes) > min(max_rows, sum(sizes.values()) - max_rows):
        return "no room for every class on both sides"
    return None


def _take(df, max_rows, keys, seed, target):
    if max_rows <= 0:
        return df.limit(0)
    keys = keys or df.columns
    one = F.lit(0)
    marked = df.withColumns({"__g": col(target) if target else one, "__h": key_hash(keys, seed)}).withColumn(
        "__b", F.shiftright("__h", HASH_BITS - BUCKET_BITS)
    )
    # A few classes x 65,536 buckets, added up before the shuffle; one scan.
    counted = nan_to_null(marked.select("__g", "__b")).groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("n"))
    histogram = cut_lineage(counted)
    sizes = {r["__g"]: r["size"] for r in histogram.groupBy("__g").agg(F.sum("n").alias("size")).collect()}
    total = sum(sizes.values())
    if total <= max_rows:
        return df
    if target and stratify_refusal(sizes, max_rows):
        marked, sizes = marked.withColumn("__g", one), {0: total}
        histogram = histogram.groupBy(one.alias("__g"), "__b").agg(F.sum("n").alias("n"))
    edges = _edges(histogram, _quotas(sizes, max_rows))
    # The sample plus one bucket per class, read from the source once.
    by_class = [F.when(F.col("__g").eqNullSafe(F.lit(e["g"])), F.lit(e["edge"])) for e in edges]
    candidates = cut_lineage(
        marked.withColumn("__edge", F.coalesce(*by_class)).where(F.col("__b") <= F.col("__edge"))
    )
    whole = candidates.where(F.col("__b") < F.col("__edge"))
    rest = _edge_rows(candidates.where(F.col("__b") == F.col("__edge")), edges, keys)
    return whole.unionByName(rest).select(*[col(c) for c in df.columns])


def _quotas(sizes: dict, max_rows: int) -> dict:
    """Rows to take per class: proportional, largest remainders first."""
    total = sum(sizes.values())
    quotas = {g: max_rows * n // total for g, n in sizes.items()}
    by_remainder = sorted(sizes, key=lambda g: (-(max_rows * sizes[g] % total), g))
    for g in by_remainder[: max_rows - sum(quotas.values())]:
        quotas[g] += 1
    return quotas


def _edges(histogram: DataFrame, quotas: dict) -> list[dict]:
    """Per class: the bucket in which its quota ends, and the rows to take from it."""
    quota = F.coalesce(*[F.when(F.col("__g").eqNullSafe(F.lit(g)), F.lit(q)) for g, q in quotas.items()])
    upto = F.sum("n").over(
        Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)  # 65,536 rows
    )
    found = (
        histogram.withColumns({"upto": upto, "quota": quota})
        .where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select(F.col("__g").alias("g"), F.col("__b").alias("edge"), F.col("n").alias("rows"),
                (F.col("quota") - F.col("upto") + F.col("n")).alias("rest"))
    )
    return [r.asDict() for r in found.collect()]


def _edge_rows(edge: DataFrame, edges: list[dict], keys: list[str]) -> DataFrame:
    """The ``rest`` smallest rows of each class's edge bucket, in two rounds.

    Normally the bucket holds 1/65,536 of a class. Should many copies of one
    key fall into it, the salt spreads them, and each salt passes on no more
    than ``rest`` rows.
    """

    def of_class(value):
        return F.coalesce(*[F.when(F.col("__g").eqNullSafe(F.lit(e["g"])), F.lit(value(e))) for e in edges])

    salts = of_class(lambda e: max(1.0, math.sqrt(e["rows"] / e["rest"])))
    edge = edge.withColumns({"__rest": of_class(lambda e: e["rest"]), "__s": F.floor(F.rand(K.SEED) * salts)})
    order = ["__h", *[col(k) for k in keys]]
    first = edge.withColumn("__r", F.row_number().over(Window.partitionBy("__g", "__s").orderBy(*order)))
    last = first.where(F.col("__r") <= F.col("__rest")).withColumn(
        "__r", F.row_number().over(Window.partitionBy("__g").orderBy(*order))
    )
    return last.where(F.col("__r") <= F.col("__rest")).drop("__r", "__s", "__rest")


def plot_sample(df: DataFrame, target: str, keys: list[str], rows: int = K.PLOT_SAMPLE_ROWS) -> DataFrame:
    return sample_stratified(df, rows, target, keys)


def training_sample(df: DataFrame, target: str, keys: list[str], rows: int = K.TRAIN_SAMPLE_ROWS) -> DataFrame:
    return sample_stratified(df, rows, target, keys)


def mark_test(
    df: DataFrame, keys: list[str], test_share: float = K.TEST_SHARE, seed: int = K.SEED, flag: str = "is_test"
) -> DataFrame:
    """Flag about ``test_share`` of the rows as test; map-only and stable.

    Without keys the whole row is the key, so equal rows fall on the same side.
    """
    return df.withColumn(flag, key_uniform(keys or df.columns, seed) < F.lit(float(test_share)))


def split(
    df: DataFrame, keys: list[str], test_share: float = K.TEST_SHARE, seed: int = K.SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) DataFrames; features and target stay together in each."""
    marked = mark_test(df, keys, test_share, seed, "__test")
    return marked.where(~F.col("__test")).drop("__test"), marked.where(F.col("__test")).drop("__test")
