"""How much each feature says about the target, and the feature report.

All features are measured together: one wide aggregate, or one grouping by the
target, for the numeric ones; one grouping of (feature, level[, class]) counts
for the rest. The number of jobs does not depend on the number of features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from featloom import constants as K
from featloom.functions import rules
from featloom.functions.columns import (
    CATEGORICAL, NUMERIC, as_double, batches, class_of, col, level_key, nan_to_null, stat_rows, union_all, unpivot,
)
from featloom.functions.stats import sum_of_squares_ratio
from featloom.operators.moments import pair_correlations
from featloom.session import cut_lineage

# Running values kept per feature: min, max, deviation 3 and mean 2; count, mean 2,
# variance 3, min and max.
SPREAD_BUFFERS, CLASS_BUFFERS = 7, 8
MAX_BROADCAST_MARGINS = 100_000  # rows of a name, a key of 64 characters at most and a count


def _measured_as_number(data_type: T.DataType) -> bool:
    return class_of(data_type) == NUMERIC or isinstance(data_type, T.BooleanType)


def _measured_as_levels(data_type: T.DataType) -> bool:
    return class_of(data_type) == CATEGORICAL or isinstance(
        data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def _double(df: DataFrame, name: str):
    # bool -> 0/1 needs the step over int
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return col(name).cast("int").cast("double")
    return as_double(name)


def pearson_to_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Signed r of each numeric feature with a numeric target.

    Always in the matrix form, however many features there are: one scan, and
    one notion of a constant column.
    """
    y = _double(df, target)
    wide = df.select(*[_double(df, f).alias(f"x{i}") for i, f in enumerate(features)], y.alias("y"))
    found = pair_correlations(wide, wide.columns, [(i, len(features)) for i in range(len(features))])
    names = F.array(*[F.lit(f) for f in features])
    return found.select(
        F.col("i").alias("ordinal"), F.element_at(names, F.col("i") + 1).alias("feature"), F.col("corr").alias("r")
    )


def _class_moments(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Count, mean, variance, min and max per feature and target class.

    One grouping for all features; rows without target form a class of their
    own (``known`` is false).
    """
    aggregates = {
        "n": lambda x: F.count(x).cast("double"),
        "m": F.avg,
        "v": F.var_pop,
        "lo": F.min,
        "hi": F.max,
    }
    position = {f: i for i, f in enumerate(features)}
    parts = []
    for group in batches(features, CLASS_BUFFERS):
        by_class = df.groupBy(col(target).alias("g")).agg(
            *[agg(_double(df, f)).alias(f"{tag}{position[f]}") for f in group for tag, agg in aggregates.items()]
        )
        rows = [
            F.struct(F.lit(position[f]).alias("ordinal"), F.lit(f).alias("feature"),
                     *[F.col(f"{tag}{position[f]}").alias(tag) for tag in aggregates])
            for f in group
        ]
        parts.append(by_class.select(F.col("g").isNotNull().alias("known"), F.inline(F.array(*rows))))
    return cut_lineage(union_all(parts))  # classes x features rows, used twice


def eta_squared(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """η² of numeric features by the classes of the target, over complete rows."""
    groups = _class_moments(df.where(col(target).isNotNull()), features, target)
    return _combine_groups(groups, ["ordinal", "feature"])


def eta_squared_by_levels(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """η² of a numeric target by the levels of each categorical feature."""
    wide = df.select(*[col(f) for f in features], _double(df, target).alias("__y"))
    groups = (
        unpivot(wide, features, "string", ids=["__y"])
        .where(F.col("value").isNotNull() & F.col("__y").isNotNull())
        .groupBy("feature", level_key(F.col("value")).alias("level"))
        .agg(F.count("__y").cast("double").alias("n"), F.avg("__y").alias("m"), F.var_pop("__y").alias("v"),
             F.min("__y").alias("lo"), F.max("__y").alias("hi"))
    )
    return _combine_groups(cut_lineage(groups), ["feature"])


def _combine_groups(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Per-group count, mean and variance -> η² per feature, means first."""
    grand = groups.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("grand")
    )
    return (
        groups.join(F.broadcast(grand), keys)  # one row per feature on the right
        .groupBy(*keys)
        .agg(sum_of_squares_ratio(*[F.col(c) for c in ("n", "m", "v", "grand", "lo", "hi")]).alias("eta_squared"))
    )


def _profile_by_class(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """η² and spread of numeric features from a single scan.

    The overall range, mean and sample std follow from the class moments, so
    the table is not read again for the scale sensitivity.
    """
    groups = _class_moments(df, features, target)
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    known_n = F.when(F.col("known"), n).otherwise(0.0)
    means = groups.groupBy("ordinal", "feature").agg(
        F.try_divide(F.sum(n * m), F.sum(n)).alias("mean"),
        F.try_divide(F.sum(known_n * m), F.sum(known_n)).alias("known_mean"),
        F.sum(n).alias("total"),
        (F.max("hi") - F.min("lo")).alias("value_range"),
    )
    gap = m - F.col("mean")
    std = F.sqrt(F.try_divide(F.sum(n * v + n * gap * gap), F.col("total") - 1.0))
    of_class = [F.when(F.col("known"), c) for c in (n, m, v, F.col("known_mean"), F.col("lo"), F.col("hi"))]
    per_feature = ["ordinal", "feature", "value_range", "mean", "total"]
    return (
        groups.join(F.broadcast(means), ["ordinal", "feature"])  # one row per feature
        .groupBy(*per_feature)
        .agg(sum_of_squares_ratio(*of_class).alias("s"), std.alias("std"))
        .select("feature", "s", "value_range", (F.col("std") / (F.abs("mean") + K.CV_EPSILON)).alias("cv"))
    )


def _profile_by_number(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """|r| and spread of numeric features; a scan each."""
    return pearson_to_target(df, features, target).select("feature", F.abs("r").alias("s")).join(
        scale_sensitivity(df, features).select("feature", "value_range", "cv"), "feature"
    )


def _spread(x) -> dict:
    return {
        "value_range": F.max(x) - F.min(x),
        "cv": F.stddev_samp(x) / (F.abs(F.avg(x)) + K.CV_EPSILON),
    }


def contingency(df: DataFrame, features: list[str], target: str, readable: bool = True) -> DataFrame:
    """Counts per (feature, level, class) over complete pairs, long form.

    ``readable=False`` lets long texts stand as digests where only the counts matter.
    """
    shown = (lambda c: c) if readable else level_key
    wide = df.select(*[col(f) for f in features], col(target).cast("string").alias("__t"))
    return (
        unpivot(wide, features, "string", ids=["__t"])
        .where(F.col("value").isNotNull() & F.col("__t").isNotNull())
        .groupBy("feature", shown(F.col("value")).alias("level"), shown(F.col("__t")).alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cramers_v(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """V of each categorical feature with a categorical target; NULL if degenerate.

    ``χ²/n = Σ O²/(R·C) − 1`` covers the empty cells without building them. The
    margins are sums over the counted table, joined back on their own keys.
    """
    cells = cut_lineage(contingency(df, features, target, readable=False))  # counted once, used for both margins
    level_totals = cells.groupBy("feature", "level").agg(F.sum("n").alias("level_n"))
    class_totals = cells.groupBy("feature", "class").agg(F.sum("n").alias("class_n"))
    o = F.col("n").cast("double")
    # Few margins are broadcast, after a count; a class that many levels share is then no hot key.
    chi = (
        cells.join(_few_or_shuffled(level_totals), ["feature", "level"])
        .join(_few_or_shuffled(class_totals), ["feature", "class"])
        .groupBy("feature")
        .agg(F.sum(o * o / (F.col("level_n").cast("double") * F.col("class_n").cast("double"))).alias("s"))
    )
    r = level_totals.groupBy("feature").agg(F.count(F.lit(1)).alias("r"))
    k = class_totals.groupBy("feature").agg(F.count(F.lit(1)).alias("k"))
    degrees = F.least("r", "k") - 1
    v = F.sqrt(F.greatest(F.col("s") - 1.0, F.lit(0.0)) / degrees)
    return (
        chi.join(r, "feature").join(k, "feature")
        .select("feature", F.when(degrees > 0, v).alias("cramers_v"))
    )


def _few_or_shuffled(margins: DataFrame) -> DataFrame:
    return F.broadcast(margins) if margins.count() <= MAX_BROADCAST_MARGINS else margins


def _profile(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Strength and spread of every feature, in feature order."""
    kinds = {f: df.schema[f].dataType for f in features}
    numbers = [f for f in features if _measured_as_number(kinds[f])]
    levels = [f for f in features if _measured_as_levels(kinds[f])]
    numeric_target = _measured_as_number(df.schema[target].dataType)

    parts = []
    if numbers:
        measure = _profile_by_number if numeric_target else _profile_by_class
        parts.append(measure(df, numbers, target).withColumn(
            "method", F.lit("pearson" if numeric_target else "eta_squared")))
    if levels:
        found = (
            eta_squared_by_levels(df, levels, target).select("feature", F.col("eta_squared").alias("s"))
            if numeric_target
            else cramers_v(df, levels, target).select("feature", F.col("cramers_v").alias("s"))
        )
        missing = F.lit(None).cast("double")
        parts.append(found.select("feature", "s", missing.alias("value_range"), missing.alias("cv"),
                                  F.lit("eta_squared" if numeric_target else "cramers_v").alias("method")))
    # One row per column of the table.
    frame = df.sparkSession.createDataFrame(
        [(i, f, class_of(kinds[f]) == NUMERIC, isinstance(kinds[f], T.BooleanType)) for i, f in enumerate(features)],
        "ordinal int, feature string, is_numeric boolean, is_bool boolean",
    )
    measured = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else frame.selectExpr(
        "feature", "double(null) as s", "double(null) as value_range", "double(null) as cv", "string(null) as method")
    strength = F.nanvl(F.col("s"), F.lit(None).cast("double"))
    return frame.join(measured, "feature", "left").withColumns(
        {
            "strength": strength,
            "signal": rules.signal_label(strength),
            "sensitivity": F.when(
                F.col("is_numeric"), rules.sensitivity_label(F.col("value_range"), F.col("cv"))
            ).when(F.col("is_bool"), "Low").otherwise("N/A"),
        }
    )


def signal_strength(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """``ordinal, feature, is_numeric, method, strength, signal`` for every feature.

    number–number |r|; number–levels η² in either direction; levels–levels V.
    An undefined strength is labelled Low.
    """
    features = features or [f for f in df.columns if f != target]
    return _profile(nan_to_null(df), target, features).select(
        "ordinal", "feature", "is_numeric", "method", "strength", "signal"
    )


def scale_sensitivity(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Range and coefficient of variation of numeric features, with the label.

    Non-numeric features are N/A; bool features are Low.
    """
    features = features or df.columns
    stats, facts = {}, {}
    for f in features:
        numeric = class_of(df.schema[f].dataType) == NUMERIC
        kind = NUMERIC if numeric else "bool" if isinstance(df.schema[f].dataType, T.BooleanType) else "none"
        nothing = F.max(F.lit(None).cast("double"))
        stats[f] = _spread(as_double(f)) if numeric else {"value_range": nothing, "cv": nothing}
        facts[f] = {"kind": kind}
    label = (
        F.when(F.col("kind") == NUMERIC, rules.sensitivity_label(F.col("value_range"), F.col("cv")))
        .when(F.col("kind") == "bool", "Low")
        .otherwise("N/A")
    )
    return stat_rows(df, stats, SPREAD_BUFFERS, facts).select(
        "ordinal", "feature", "value_range", "cv", label.alias("sensitivity")
    )


def feature_report(
    df: DataFrame, target: str, models: list[str] = tuple(K.MODELS), features: list[str] | None = None
) -> DataFrame:
    """Suitability of every feature for every model, one row each.

    One scan for the numeric features, one for the others.
    """
    features = features or [f for f in df.columns if f != target]
    profile = _profile(nan_to_null(df), target, features)
    asked = profile.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    signal, sensitivity, model = F.col("signal"), F.col("sensitivity"), F.col("model")
    fit = rules.compatibility(signal, sensitivity, model)
    return asked.select(
        "model", "ordinal", "feature",
        rules.flags(signal, sensitivity, model, F.col("is_numeric")).alias("flags"),
        "signal",
        sensitivity.alias("scale_sensitivity"),
        fit.alias("compatibility"),
        rules.recommendation(signal, sensitivity, fit, model).alias("recommendation"),
        rules.model_note(model).alias("model_note"),
    )
