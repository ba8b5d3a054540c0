"""Label rules as CASE expressions over profile columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from featloom import constants as K


def signal_label(strength: Column) -> Column:
    return (
        F.when(strength >= K.SIGNAL_HIGH, "High")
        .when(strength >= K.SIGNAL_MEDIUM, "Medium")
        .otherwise("Low")
    )


def sensitivity_label(value_range: Column, cv: Column) -> Column:
    """NULL (undefined spread) compares as not-true and so falls to Low."""
    return (
        F.when((value_range > K.RANGE_HIGH) | (cv > K.CV_HIGH), "High")
        .when((value_range > K.RANGE_MEDIUM) | (cv > K.CV_MEDIUM), "Medium")
        .otherwise("Low")
    )


def compatibility(signal: Column, sensitivity: Column, model: Column) -> Column:
    risky = model.isin(K.SCALE_MODELS) & (sensitivity == "High") & signal.isin("High", "Medium")
    return F.when(signal == "Low", "Weak").when(risky, "Risky").otherwise("Good")


def recommendation(signal: Column, sensitivity: Column, fit: Column, model: Column) -> Column:
    return (
        F.when(signal == "Low", "Optional (drop if noisy)")
        .when((fit == "Risky") & (model == K.LOGISTIC), "Scale + Regularize")
        .when(fit == "Risky", "Scale first")
        .when((sensitivity == "High") & model.isin(K.KNN, K.SVM), "Must scale")
        .when(signal == "High", "Keep (strong)")
        .otherwise("Keep")
    )


def flags(signal: Column, sensitivity: Column, model: Column, is_numeric: Column) -> Column:
    marks = F.concat_ws(
        " ",
        F.when(signal == "High", K.FLAG_STRONG),
        F.when((sensitivity == "High") & model.isin(K.SCALE_MODELS), K.FLAG_SCALE),
        F.when((model == K.TREE) & signal.isin("High", "Medium"), K.FLAG_TREE),
        F.when((model == K.KNN) & is_numeric, K.FLAG_DISTANCE),
    )
    return F.coalesce(F.nullif(marks, F.lit("")), F.lit(K.FLAG_NONE))


def model_note(model: Column) -> Column:
    note = F.lit(K.NO_MODEL_NOTE)
    for name, text in K.MODEL_NOTES.items():
        note = F.when(model == name, text).otherwise(note)
    return note


def ablation_effect(drop: Column) -> Column:
    points = drop * 100
    return (
        F.when(points > K.ABLATION_POINTS, "positive")
        .when(points < -K.ABLATION_POINTS, "negative")
        .otherwise("neutral")
    )


def response_type(value_range: Column, step_std: Column) -> Column:
    return (
        F.when(value_range < K.FLAT_RANGE, "flat")
        .when(step_std > K.NOISY_STD, "noisy")
        .otherwise("smooth")
    )


def response_strength(value_range: Column) -> Column:
    return (
        F.when(value_range > K.STRONG_RESPONSE, "good")
        .when(value_range > K.MODERATE_RESPONSE, "moderate")
        .otherwise("flat")
    )
