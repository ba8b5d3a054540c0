"""Do predictions rest on sensible features? Ablation, sweeps, comparison."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.errors import IllegalArgumentException
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window, functions as F

from featloom import constants as K
from featloom.functions import rules
from featloom.functions.columns import as_double, col, nan_to_null, numeric_columns, stat_values
from featloom.operators.models import Experiment, Slot, TrainedModel, evaluate, fit_model, prepare_experiment
from featloom.operators.preprocess import PrepConfig, indicator_quantile
from featloom.operators.quantiles import exact_quantiles

PARALLEL_FITS = 3
FIT_ERRORS = (ValueError, IllegalArgumentException)  # what a fit refuses; lost executors and failed jobs go up
ABLATION_SCHEMA = "feature string, baseline_accuracy double, accuracy double, drop double, error string"


def resolve_feature(name: str, columns: list[str]) -> str | None:
    """The column itself, else the first prepared column containing the name."""
    return name if name in columns else next((c for c in columns if name in c), None)


def ablation(
    df: DataFrame, target: str, model: str, config: PrepConfig = PrepConfig(), keys: list[str] = (),
    features: list[str] | None = None, max_features: int | None = None, **params,
) -> DataFrame:
    """Accuracy lost when one prepared column is left out, largest drop first.

    Tests ``features``, else all columns or the first ``max_features``. The prepared data
    is read once into memory/disk and a few fits run side by side. A fit that
    fails keeps its row, with the error text instead of a made-up drop.
    """
    setup = prepare_experiment(df, target, config, list(keys))
    try:
        return _ablate(df.sparkSession, setup, model, features, max_features, params)
    finally:
        setup.release()


def _ablate(spark, setup: Experiment, model, features, max_features, params) -> DataFrame:
    def accuracy(columns):
        fitted = fit_model(setup.train, model, setup.target, setup.classes, columns, **params)
        return evaluate(fitted, setup.test).first()["accuracy"]

    tested = list(features) if features else setup.features[:max_features]
    baseline = accuracy(setup.features)

    def without(feature):
        try:
            rest = accuracy([c for c in setup.features if c != feature])
            return feature, baseline, rest, baseline - rest, None
        except FIT_ERRORS as problem:  # reported in the row
            return feature, baseline, None, None, str(problem)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        rows = list(pool.map(without, tested))
    ranked = Window.orderBy(F.desc_nulls_last("drop"), "position")  # one row per tested column
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ABLATION_SCHEMA + ", position int")
    return table.withColumn("rank", F.row_number().over(ranked)).select(
        "rank", "feature", "baseline_accuracy", "accuracy", "drop",
        rules.ablation_effect(F.col("drop")).alias("effect"), "error",
    )


def verification_summary(ablated: DataFrame, sweep: DataFrame | None = None) -> DataFrame:
    """One sentence on the features that matter most."""
    top = ablated.where(F.col("drop") > K.SUMMARY_DROP).orderBy("rank").limit(K.SUMMARY_TOP)
    facts = top.agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "drop"))).alias("t"))  # 3 rows
    names = F.array_join(F.transform("t", lambda s: s["feature"]), ", ")
    drops = F.array_join(F.transform("t", lambda s: F.format_string("%+.1f%%", s["drop"] * 100)), ", ")
    text = F.when(F.size("t") == 0, "No single feature dominates accuracy.").otherwise(
        F.concat(F.lit("Key features: "), names, F.lit(" ("), drops, F.lit(")"))
    )
    facts = facts.select(text.alias("summary"), (F.size("t") > 0).alias("found"), F.lit(1).alias("one"))
    if sweep is None:
        return facts.select("summary")
    flat = sweep.where(F.col("response_type") == "flat").agg(F.min("feature").alias("flat"))
    note = F.when(F.col("found") & F.col("flat").isNotNull(), F.concat(F.lit(" | "), "flat", F.lit(" has flat response")))
    return facts.join(flat.withColumn("one", F.lit(1)), "one").select(
        F.concat("summary", F.coalesce(note, F.lit(""))).alias("summary")
    )


def median_row(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of every column."""
    return {c: q[0] for (_, c), q in exact_quantiles(df, columns, [0.5]).items()}


def grid_bounds(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """min, max and two exact quantiles per column."""
    found = exact_quantiles(df, columns, [low, high])
    rows = [(c, *found[None, c]) for c in columns]
    inner = df.sparkSession.createDataFrame(rows, "feature string, low double, high double")
    return value_ranges(df, columns).join(inner, "feature").select("feature", "min", "low", "high", "max")


def value_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """min and max per column, one plain aggregate."""
    found = stat_values(df, {c: {"min": F.min(as_double(c)), "max": F.max(as_double(c))} for c in columns}, 2)
    rows = [(c, found[c]["min"], found[c]["max"]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, min double, max double")


def sweep_grid(bounds: DataFrame, low: str, high: str, points: int = K.SWEEP_POINTS) -> DataFrame:
    """Evenly spaced values between two bounds: ``feature, step, value``."""
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    width = F.col(high) - F.col(low)
    value = F.when(F.col("step") == points - 1, F.col(high)).otherwise(
        F.col(low) + width / float(max(points - 1, 1)) * F.col("step")
    )
    return bounds.withColumn("step", step).select("feature", "step", value.alias("value"))


def response_summary(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Range, step noise and response type of each curve (``step, prediction``)."""
    moved = curve.withColumn(
        "move", F.col("prediction") - F.lag("prediction").over(Window.partitionBy(*keys).orderBy("step"))
    )
    facts = moved.groupBy(*keys).agg(
        (F.max("prediction") - F.min("prediction")).alias("value_range"),
        F.stddev_pop("move").alias("step_std"),
    )
    return facts.withColumns(
        {
            "response_type": rules.response_type(F.col("value_range"), F.col("step_std")),
            "response_strength": rules.response_strength(F.col("value_range")),
        }
    )


@dataclass(frozen=True)
class Typical:
    """The median row of a prepared table, and bounds for the slots that are swept."""

    base: dict[int, float]  # assembled vector, zeros left out
    bounds: DataFrame  # feature, low, high

    @staticmethod
    def of(trained: TrainedModel, prepared: DataFrame, counts: dict[str, np.ndarray], rows: int, asked: list[Slot], low: float, high: float) -> Typical:
        """Bounds are the quantiles ``low`` and ``high``; 0 and 1 are the extremes.

        Plain columns are ranked exactly in ``prepared``. One-hot slots hold zeros and ones, so
        their medians and bounds follow from the rows per slot (``counts``).
        """
        spark, starts = prepared.sparkSession, trained.starts()
        plain = [c for c in trained.features if trained.scale_of(c) is None]
        base = {starts[c]: float(v) for c, v in median_row(prepared, plain).items()} if plain else {}
        edges = []
        for column, scale in trained.prep.slot_scales.items() if trained.prep else ():
            if column not in starts:
                continue
            ones = counts[column]
            middle = scale.stored(scale.shown(indicator_quantile(ones, rows, 0.5), np.arange(len(ones))), np.arange(len(ones)))
            base |= {starts[column] + int(i): float(middle[i]) for i in np.flatnonzero(middle)}
            own = [s for s in asked if s.column == column]
            at = np.array([s.place for s in own], int)
            ends = [scale.shown(indicator_quantile(ones[at], rows, p), at) for p in (low, high)]
            edges += [(s.name, float(a), float(b)) for s, a, b in zip(own, *ends)]
        bounds = spark.createDataFrame(edges, "feature string, low double, high double")
        columns = list(dict.fromkeys(s.column for s in asked if s.place is None))
        if columns and (low, high) == (0, 1):
            bounds = bounds.unionByName(value_ranges(prepared, columns).toDF("feature", "low", "high"))
        elif columns:
            bounds = bounds.unionByName(grid_bounds(prepared, columns, low, high).select("feature", "low", "high"))
        return Typical(base, bounds)


def _curve(trained: TrainedModel, typical: Typical, asked: list[Slot], points: int) -> DataFrame:
    """The median row with one slot replaced by grid values, through a model.

    Vectors stay sparse: a row is the median row's few entries and the slot at hand.
    """
    grid, base, width = sweep_grid(typical.bounds, "low", "high", points), typical.base, trained.width
    spark = grid.sparkSession
    offset = {s: float(scale.shift[s.place] / scale.width[s.place]) if (scale := trained.scale_of(s.column)) else 0.0 for s in asked}
    places = spark.createDataFrame([(s.name, s.index, offset[s]) for s in asked], "feature string, slot int, offset double")

    @F.udf(VectorUDT())
    def row(slot, value):
        entries = {**base, slot: value}
        return Vectors.sparse(width, sorted(entries), [entries[i] for i in sorted(entries)])

    rows = grid.join(F.broadcast(places), "feature").select("feature", "step", "value", row("slot", F.col("value") + F.col("offset")).alias("features"))
    scored = trained.score_vectors(rows, ["feature", "step", "value"])
    return scored.select("feature", "step", "value", F.col("score").cast("double").alias("prediction"))


def sensitivity(
    df: DataFrame, trained: TrainedModel, features: list[str], points: int = K.SWEEP_POINTS
) -> tuple[DataFrame, DataFrame]:
    """Predictions while one feature runs from its minimum to its maximum.

    The model's own fitted preparation is applied to ``df``; medians and bounds
    come from the prepared columns, so the sweep lives in the space the model
    was trained in. A feature encoded into several slots or columns gives a curve
    for each. All share one grid and one scoring pass.
    Returns the curves and their summary.
    """
    rows = nan_to_null(df).where(col(trained.target).isNotNull())
    found = {n: trained.find_slots(n) for n in features}
    unknown = [n for n, f in found.items() if not f]
    if unknown or not found:
        raise ValueError(f"not among the prepared features: {unknown or 'none asked'}")
    asked = list(dict.fromkeys(s for f in found.values() for s in f))
    counts, n = trained.prep.slot_counts(rows) if trained.prep.slot_scales else ({}, 0)
    prepared = trained.prep.apply(rows).persist()  # the look-ups are done once, for medians and ranges
    try:
        typical = Typical.of(trained, prepared, counts, n, asked, 0, 1)
    finally:
        prepared.unpersist()
    curve = _curve(trained, typical, asked, points)
    return curve, response_summary(curve, ["feature"])


def model_response(
    df: DataFrame, target: str, feature: str, config: PrepConfig = PrepConfig(), keys: list[str] = (),
    models: list[str] = (K.LOGISTIC, K.KNN, K.TREE), points: int = K.COMPARE_POINTS,
) -> DataFrame:
    """Response of several models to one feature between its 5th and 95th percentile.

    A feature of several slots or columns has a curve for each. A model that cannot be fitted
    has one row with the error; the others go on.
    """
    setup = prepare_experiment(df, target, config, list(keys))
    try:
        shape = TrainedModel("", target, setup.classes, setup.features, None, setup.prep)
        asked = shape.find_slots(feature)
        if not asked:
            raise ValueError(f"{feature} is not a prepared feature")
        typical = Typical.of(shape, setup.train, *setup.slot_counts(), asked, 0.05, 0.95)
        rows = []  # points x models x slots
        for model in models:
            try:
                fitted = fit_model(setup.train, model, target, setup.classes, setup.features, setup.prep)
                curve = _curve(fitted, typical, asked, points).collect()
                rows += [(model, r["feature"], r["step"], r["value"], r["prediction"], None) for r in curve]
            except FIT_ERRORS as problem:  # reported in the model's only row
                rows.append((model, feature, None, None, None, str(problem)))
    finally:
        setup.release()
    return df.sparkSession.createDataFrame(
        rows, "model string, feature string, step int, value double, prediction double, error string"
    )


def slot_ranges(setup: Experiment, feature: str) -> DataFrame:
    """``feature, low, high`` of every column or slot of a feature on the training side, as sweeps use them."""
    shape = TrainedModel("", setup.target, setup.classes, setup.features, None, setup.prep)
    return Typical.of(shape, setup.train, *setup.slot_counts(), shape.find_slots(feature), 0, 1).bounds


def scaling_impact(
    df: DataFrame, target: str, models: list[str], scalings: list[str], keys: list[str] = (),
    imputation: str = "Mean", encoding: str = "Label Encoding",
) -> DataFrame:
    """Accuracy and F1 per model and scaling: ``model, experiment, accuracy, f1_score``."""
    rows = []
    for scaling in scalings:
        setup = prepare_experiment(df, target, PrepConfig(imputation, encoding, scaling), list(keys))
        try:
            for model in models:
                fitted = fit_model(setup.train, model, target, setup.classes, setup.features, setup.prep)
                row = evaluate(fitted, setup.test).first()
                rows.append((model, scaling, row["accuracy"], row["f1_score"]))
        finally:
            setup.release()
    return df.sparkSession.createDataFrame(
        rows, "model string, experiment string, accuracy double, f1_score double"
    )


def sweepable(df: DataFrame, features: list[str], target: str) -> list[str]:
    """Features that are numeric columns, or whose name is part of one."""
    numeric = numeric_columns(df, target)
    return [f for f in features if any(f in c for c in numeric)]
