"""The whole walk through one table: profile, prepare, train, verify, advise."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from featloom import constants as K
from featloom.functions.columns import numeric_columns
from featloom.operators import correlation, models, profile, sampling, signal, summaries, verify
from featloom.operators.preprocess import PrepConfig


@dataclass
class Study:
    """A table, its target and the row keys; every step returns DataFrames.

    ``plot_rows`` and ``train_rows`` cap the rows used for charts and training
    by a stratified sample. Both are off by default: Spark reads the whole table.
    """

    df: DataFrame
    target: str
    keys: list[str]
    config: PrepConfig = field(default_factory=PrepConfig)
    plot_rows: int | None = None
    train_rows: int | None = None

    def _capped(self, rows: int | None) -> DataFrame:
        return self.df if rows is None else sampling.sample_stratified(self.df, rows, self.target, self.keys)

    def _features(self, rows: int | None) -> DataFrame:
        kept = profile.drop_null_target(self._capped(rows), self.target)
        return kept.drop(*[k for k in self.keys if k != self.target])

    def overview(self) -> dict[str, DataFrame]:
        """Schema, rows without target, target kind and which models may train."""
        info = profile.target_type(self.df, self.target)
        return {
            "schema": profile.schema_summary(self.df),
            "target_rows": profile.null_target_counts(self.df, self.target),
            "target": info,
            "gate": profile.training_gate(info, K.MODELS),
        }

    def report(self, chosen: list[str] = tuple(K.MODELS)) -> DataFrame:
        return signal.feature_report(self._features(self.plot_rows), self.target, chosen)

    def selection(self) -> dict[str, DataFrame]:
        """Correlation with the target, ranges, collinear pairs, advice."""
        rows = self._features(self.plot_rows)
        return {
            "corr_to_target": correlation.corr_to_target(rows, self.target),
            "scale_ranges": summaries.scale_ranges(rows, self.target),
            "collinear_pairs": correlation.collinear_pairs(rows, self.target),
            "guidance": summaries.model_guidance(rows, self.target),
        }

    def charts(self) -> dict[str, DataFrame]:
        """Target distribution, boxes by class, missing patterns, histograms."""
        rows = self._features(self.plot_rows)
        kind, distribution = summaries.target_distribution(rows, self.target)
        found = {
            f"target_{kind}": distribution,
            "missing_patterns": summaries.missing_patterns(rows),
            "histograms": summaries.feature_histograms(rows, self.target),
        }
        separation = summaries.box_separation(rows, self.target)
        if separation is not None:
            found["separation"] = separation
        return found

    def train(self, model: str, **params) -> models.TrainResult:
        """Refuses with ``ValueError`` where the gate says no."""
        return models.train_evaluate(
            self._capped(self.train_rows), self.target, model, self.config, self.keys, **params
        )

    def verify(self, result: models.TrainResult, max_features: int | None = None) -> dict[str, DataFrame]:
        """Ablation, sweeps of the numeric features and a one-line summary."""
        rows = self._capped(self.train_rows)
        trained = result.model
        ablated = verify.ablation(
            rows, self.target, trained.name, self.config, self.keys, max_features=max_features
        )
        numeric = set(numeric_columns(self.df.drop(*self.keys), self.target))
        swept = [f for f in trained.features if f in numeric]
        found = {"ablation": ablated}
        if swept:
            found["curves"], found["responses"] = verify.sensitivity(rows, trained, swept)
        first = found["responses"].where(F.col("feature") == swept[0]) if swept else None
        found["summary"] = verify.verification_summary(ablated, first)
        return found

    def compare(self, feature: str) -> DataFrame:
        return verify.model_response(
            self._capped(self.train_rows), self.target, feature, self.config, self.keys
        )
