"""Fit on one table, apply to any other: impute, encode, scale.

Fitting runs a fixed number of aggregation jobs and returns a few numbers per
column (or a level table). Applying is a lazy projection plus look-ups, so it
also works on a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F, types as T

from featloom import constants as K
from featloom.functions.columns import (
    as_double, categorical_columns, col, nan_to_null, numeric_columns, stat_values, unpivot,
)
from featloom.operators.encode import LevelTable, OneHotSlots, fit_levels, frequency_encode, label_encode, one_hot_encode, one_hot_slots, one_hot_vector
from featloom.operators.quantiles import exact_quantiles


def _check(option: str, allowed: list[str], what: str) -> None:
    if option not in allowed:
        raise ValueError(f"unknown {what}: {option!r}; use one of {allowed}")


# --- imputation ----------------------------------------------------------------


@dataclass(frozen=True)
class Imputer:
    """``fill`` is None for Drop Rows; a None value leaves its column missing."""

    strategy: str
    columns: tuple[str, ...]
    fill: dict | None

    @property
    def unfilled(self) -> list[str]:
        """Columns that were wholly missing in fit and therefore stay missing."""
        return [c for c, v in (self.fill or {}).items() if v is None]

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        if self.fill is None:
            df = nan_to_null(df)
            present = F.lit(True)
            for c in self.columns:
                present = present & col(c).isNotNull()
            return df.where(present)
        return df.withColumns(
            {
                c: as_double(c) if v is None else F.coalesce(as_double(c), F.lit(float(v)))
                for c, v in self.fill.items()
            }
        )


def fit_imputer(df: DataFrame, strategy: str, columns: list[str], constant: float = 0) -> Imputer:
    _check(strategy, K.IMPUTATIONS, "imputation")
    fill: dict | None = None
    if not columns or strategy == "Drop Rows":
        return Imputer(strategy, tuple(columns), None)
    if strategy == "Constant":
        fill = {c: constant for c in columns}
    elif strategy == "Mean":
        found = stat_values(df, {c: {"mean": F.avg(as_double(c))} for c in columns}, 2)
        fill = {c: found[c]["mean"] for c in columns}
    elif strategy == "Median":
        found = exact_quantiles(df, columns, [0.5])
        fill = {c: found[None, c][0] for c in columns}
    else:
        fill = modes(df, columns)
    return Imputer(strategy, tuple(columns), fill)


def modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent value per column, the smallest on ties.

    Counts per (column, value) are added up before and in the shuffle; the
    winner is a running maximum, so no group's values are ever held together
    (the built-in ``mode`` keeps a map of all values).
    """
    counts = unpivot(df, columns, "double").where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    best = counts.groupBy("feature").agg(
        F.max(F.struct(F.col("n"), (-F.col("value")).alias("neg"))).alias("best")
    )
    found = {r["feature"]: -r["best"]["neg"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in columns}


# --- scaling -------------------------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    """``(x - shift) / width`` per column; None shift leaves an empty column."""

    strategy: str
    params: dict

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.params:
            return df
        return df.withColumns(
            {
                c: (as_double(c) - F.lit(float(shift))) / F.lit(float(width))
                for c, (shift, width) in self.params.items()
                if shift is not None
            }
        )


def fit_scaler(df: DataFrame, strategy: str, columns: list[str]) -> Scaler:
    """Population std, min–max to [0, 1], or median and IQR; a zero width counts as 1."""
    _check(strategy, K.SCALINGS, "scaling")
    if not columns or strategy == "No Scaling":
        return Scaler(strategy, {})
    if strategy == "RobustScaler":
        found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        raw = {}
        for c in columns:
            low, mid, high = found[None, c]
            raw[c] = (mid, None if mid is None else high - low)
    else:
        stats = {}
        for c in columns:
            x = as_double(c)
            if strategy == "StandardScaler":
                stats[c] = {"shift": F.avg(x), "width": F.stddev_pop(x)}
            else:
                stats[c] = {"shift": F.min(x), "width": F.max(x) - F.min(x)}
        found = stat_values(df, stats, 5)
        raw = {c: (found[c]["shift"], found[c]["width"]) for c in columns}
    return Scaler(strategy, {c: (a, b or 1.0) for c, (a, b) in raw.items()})


def indicator_quantile(ones: np.ndarray, rows: int, p: float) -> np.ndarray:
    """Interpolated quantile of columns of ``rows`` zeros and ones, from the number of ones."""
    position = max(rows - 1, 0) * p
    low = int(position)
    at = lambda rank: (rank >= rows - ones).astype(float)
    return at(low) + (position - low) * (at(min(low + 1, rows - 1)) - at(low))


@dataclass(frozen=True)
class SlotScale:
    """``(x - shift) / width`` for every slot of a one-hot vector.

    Slots hold zeros and ones, so the level counts of the fit give both exactly, without a scan.
    Vectors are divided by the width only and stay sparse. The shift moves all rows alike:
    linear models take it up in their intercept, trees in their thresholds, and distances don't see it.
    """

    slots: OneHotSlots
    shift: np.ndarray
    width: np.ndarray

    def apply(self, df: DataFrame) -> DataFrame:
        if (self.width == 1).all():
            return df
        vector = self.slots.vector
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(1 / self.width), inputCol=vector, outputCol="__scaled")
        kept = df.schema[vector].metadata
        made = scaled.transform(df)
        return made.select(*[F.col("__scaled").alias(c, metadata=kept) if c == vector else col(c) for c in df.columns])

    def shown(self, value: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The scaled value that stands for an indicator's value."""
        return (value - self.shift[slots]) / self.width[slots]

    def stored(self, shown: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """What the vector holds for a scaled value."""
        return shown + self.shift[slots] / self.width[slots]


def fit_slot_scale(strategy: str, slots: OneHotSlots) -> SlotScale:
    _check(strategy, K.SCALINGS, "scaling")
    ones, rows = slots.counts, slots.rows
    shift, width = np.zeros(slots.size), np.ones(slots.size)
    if strategy == "StandardScaler":
        shift = ones / max(rows, 1)
        width = np.sqrt(shift * (1 - shift))
    elif strategy == "MinMaxScaler":
        shift = (ones == rows).astype(float)
        width = (ones > 0) - shift
    elif strategy == "RobustScaler":
        low, shift, high = (indicator_quantile(ones, rows, p) for p in (0.25, 0.5, 0.75))
        width = high - low
    return SlotScale(slots, shift, np.where(width == 0, 1.0, width))


# --- encoding ------------------------------------------------------------------


@dataclass(frozen=True)
class Encoder:
    strategy: str
    tables: dict[str, LevelTable]
    on_unseen: str = "error"
    slots: tuple[OneHotSlots, ...] = ()  # of one-hot vectors

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.tables:
            return df
        for slots in self.slots:
            df = one_hot_vector(df, slots)
        if self.slots:
            return df
        if self.strategy == "Label Encoding":
            return label_encode(df, self.tables, self.on_unseen)
        if self.strategy == "One-Hot Encoding":
            return one_hot_encode(df, self.tables)
        return frequency_encode(df, self.tables)


def fit_encoder(df: DataFrame, strategy: str, columns: list[str], on_unseen: str = "error", one_hot: str = "columns") -> Encoder:
    _check(strategy, K.ENCODINGS, "encoding")
    encoder = Encoder(strategy, fit_levels(df, columns) if columns else {}, on_unseen)
    if strategy != "One-Hot Encoding" or one_hot == "columns":
        return encoder
    return replace(encoder, slots=tuple(one_hot_slots(t) for t in encoder.tables.values()))


# --- the three together ----------------------------------------------------------


@dataclass(frozen=True)
class PrepConfig:
    imputation: str = "Drop Rows"
    encoding: str = "Label Encoding"
    scaling: str = "No Scaling"
    constant: float = 0
    on_unseen: str = "error"
    one_hot: str = "columns"  # or "vector", one sparse vector per feature

    def __post_init__(self):
        _check(self.one_hot, ["columns", "vector"], "one-hot form")
        _check(self.imputation, K.IMPUTATIONS, "imputation")
        _check(self.encoding, K.ENCODINGS, "encoding")
        _check(self.scaling, K.SCALINGS, "scaling")


@dataclass(frozen=True)
class FittedPrep:
    config: PrepConfig
    target: str | None
    imputer: Imputer
    encoder: Encoder
    scaler: Scaler
    features: list[str] = field(default_factory=list)
    slot_scales: dict[str, SlotScale] = field(default_factory=dict)  # by vector column

    def apply(self, df: DataFrame) -> DataFrame:
        """Same columns as in fit; extra columns (target, keys) pass through."""
        df = self.scaler.apply(self.encoder.apply(self.imputer.apply(_ready(df, self.target))))
        for scale in self.slot_scales.values():
            df = scale.apply(df)
        return df

    def slot_counts(self, df: DataFrame) -> tuple[dict[str, np.ndarray], int]:
        """Rows of ``df`` per slot of each one-hot vector, and all rows left after imputation."""
        rows = self.imputer.apply(_ready(df, self.target))
        names = {s.slots.column: f"s{i}" for i, s in enumerate(self.slot_scales.values())}
        for scale in self.slot_scales.values():
            rows = scale.slots.attach(rows, names[scale.slots.column])
        found = {v: np.zeros(s.slots.size, np.int64) for v, s in self.slot_scales.items()}
        if not names:
            return found, rows.count()
        # One number per slot, as many as a model on these slots has.
        counted = rows.select(*names.values()).unpivot([], list(names.values()), "name", "slot").groupBy("name", "slot").agg(F.count("*").alias("n"))
        vectors, total = dict(zip(names.values(), self.slot_scales)), 0
        for r in counted.collect():
            total += r["n"]
            if r["slot"] is not None:
                found[vectors[r["name"]]][r["slot"]] = r["n"]
        return found, total // len(names)


def _ready(df: DataFrame, target: str | None) -> DataFrame:
    """NaN to NULL; bool features to 0/1."""
    df = nan_to_null(df)
    bools = {
        f.name: col(f.name).cast("int")
        for f in df.schema.fields
        if isinstance(f.dataType, T.BooleanType) and f.name != target
    }
    return df.withColumns(bools) if bools else df


def fit_prep(
    train: DataFrame, target: str | None, config: PrepConfig = PrepConfig(), features: list[str] | None = None
) -> FittedPrep:
    """Impute, then encode, then scale every numeric column that results.

    Fitted on ``train`` only. Date, time and nested columns are not features;
    cast them first. ``features`` limits the columns used.
    """
    ready = _ready(train, target)
    keep = [c for c in (features or ready.columns) if c != target]
    numeric = [c for c in numeric_columns(ready, target) if c in keep]
    text = [c for c in categorical_columns(ready, target) if c in keep]
    used = ready.select(*[col(c) for c in ready.columns if c in numeric or c in text])
    imputer = fit_imputer(used, config.imputation, numeric, config.constant)
    imputed = imputer.apply(used)
    encoder = fit_encoder(imputed, config.encoding, text, config.on_unseen, config.one_hot)
    encoded = encoder.apply(imputed)
    scaler = fit_scaler(encoded, config.scaling, numeric_columns(encoded))
    slot_scales = {s.vector: fit_slot_scale(config.scaling, s) for s in encoder.slots}
    return FittedPrep(config, target, imputer, encoder, scaler, encoded.columns, slot_scales)
