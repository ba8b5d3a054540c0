"""The tables behind the charts: counts, histograms, boxes, ranges, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from featloom import constants as K
from featloom.functions.columns import (
    NUMERIC, as_double, batches, class_of, col, nan_to_null, numeric_columns, stat_rows, stat_values, union_all, unpivot,
)
from featloom.operators.profile import few_values
from featloom.operators.quantiles import exact_quantiles
from featloom.session import cut_lineage

BOX_BUFFERS = 6  # running values kept per feature in a box pass


def value_counts(df: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """Counts per present value, largest first (ties by value)."""
    df = nan_to_null(df)
    counts = (
        df.where(col(target).isNotNull()).groupBy(col(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )
    return counts if top is None else counts.limit(top)


def target_distribution(df: DataFrame, target: str) -> tuple[str, DataFrame]:
    """Counts for up to 20 distinct values; else a histogram or the top values."""
    if few_values(df, target, K.TOP_VALUES) is not None:
        return "counts", value_counts(df, target)
    if class_of(df.schema[target].dataType) == NUMERIC:
        mean = df.agg(F.avg(as_double(target))).first()[0]
        return "histogram", histograms(df, [target]).withColumn("mean", F.lit(mean).cast("double"))
    return "top", value_counts(df, target, K.TOP_VALUES)


def _bin(x: Column, low: float, high: float, bins: int) -> Column:
    if high == low:
        return F.when(x.isNotNull(), F.lit(0))
    at = F.floor((x - F.lit(float(low))) / F.lit(float(high - low)) * bins)
    return F.when(at >= bins, bins - 1).otherwise(at).cast("int")  # ``least`` would skip NULL


def bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(min, max) per column, one pass; columns without values are left out."""
    found = stat_values(df, {c: {"low": F.min(as_double(c)), "high": F.max(as_double(c))} for c in columns}, 2)
    return {c: (found[c]["low"], found[c]["high"]) for c in columns if found[c]["low"] is not None}


def histograms(df: DataFrame, columns: list[str], bins: int = K.HISTOGRAM_BINS, edges: dict | None = None) -> DataFrame:
    """Equal-width counts: ``feature, bin, bin_low, bin_high, n``.

    Two scans (range, then counts); the shuffle holds features x bins rows.
    """
    edges = edges or bounds(df, columns)
    kept = [c for c in columns if c in edges]
    if not kept:
        return df.sparkSession.createDataFrame([], "feature string, bin int, bin_low double, bin_high double, n bigint")
    binned = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        _bin(as_double(c), *edges[c], bins).alias("bin"),
                        F.lit(float(edges[c][0])).alias("low"),
                        F.lit(float(edges[c][1] - edges[c][0]) / bins).alias("width"),
                    )
                    for c in kept
                ]
            )
        )
    ).where(F.col("bin").isNotNull())
    return (
        binned.groupBy("feature", "bin", "low", "width").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "feature", "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"),
            "n",
        )
    )


def feature_histograms(df: DataFrame, target: str | None = None, max_features: int | None = None) -> DataFrame:
    return histograms(df, numeric_columns(df, target)[:max_features])


def distribution_shift(before: DataFrame, after: DataFrame, column: str, bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Histograms of one column before and after a step, over shared bins."""
    a, b = bounds(before, [column]).get(column), bounds(after, [column]).get(column)
    known = [e for e in (a, b) if e is not None]
    edges = {column: (min(e[0] for e in known), max(e[1] for e in known))} if known else {}
    return (
        histograms(before, [column], bins, edges).withColumn("stage", F.lit("before"))
        .unionByName(histograms(after, [column], bins, edges).withColumn("stage", F.lit("after")))
    )


def box_summary(df: DataFrame, features: list[str], target: str, classes: list) -> DataFrame:
    """Five-number summary with 1.5·IQR whiskers per feature and class.

    Whiskers end at the outermost values inside the fences; ``n_outliers``
    counts the values beyond. Quartiles are exact.
    """
    chosen = nan_to_null(df).where(col(target).isin(classes))
    quartiles = exact_quantiles(chosen, features, [0.25, 0.5, 0.75], by=target)
    kind = df.schema[target].dataType.simpleString()
    parts = [
        _whiskers(chosen, group, target, kind, quartiles) for group in batches(features, BOX_BUFFERS)
    ]
    # One row per feature and class.
    table = df.sparkSession.createDataFrame(
        [(g, f, *q) for (g, f), q in quartiles.items()],
        f"class {kind}, feature string, q1 double, median double, q3 double",
    )
    return union_all(parts).where(F.col("n") > 0).join(F.broadcast(table), ["class", "feature"])


def _whiskers(chosen: DataFrame, features: list[str], target: str, kind: str, quartiles: dict) -> DataFrame:
    """Counts, extremes and whisker ends of a few features, one scan by class."""
    slots = list(enumerate(features))
    rows = []
    for g in {g for g, _ in quartiles}:
        fences = []
        for _, f in slots:
            q1, _, q3 = quartiles.get((g, f), (None, None, None))
            fences += [None, None] if q1 is None else [q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)]
        rows.append((g, *fences))
    schema = ", ".join([f"class {kind}", *[f"lo{i} double, hi{i} double" for i, _ in slots]])
    fences = F.broadcast(chosen.sparkSession.createDataFrame(rows, schema))  # one row per class
    data = chosen.select(col(target).alias("class"), *[as_double(f).alias(f"x{i}") for i, f in slots])
    aggregates = []
    for i, _ in slots:
        x = F.col(f"x{i}")
        inside = x.between(F.col(f"lo{i}"), F.col(f"hi{i}"))
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
            F.min(F.when(inside, x)).alias(f"low{i}"),
            F.max(F.when(inside, x)).alias(f"high{i}"),
            F.count_if(~inside).alias(f"out{i}"),
        ]
    structs = [
        F.struct(
            F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"), F.col(f"low{i}").alias("whisker_low"),
            F.col(f"high{i}").alias("whisker_high"), F.col(f"out{i}").alias("n_outliers"),
        )
        for i, f in slots
    ]
    return data.join(fences, "class").groupBy("class").agg(*aggregates).select("class", F.inline(F.array(*structs)))


def class_boxes(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The columns of ``box_summary`` for every class of the target, however many there are.

    Counted values are dealt to ranges in order of class, feature and value, so ranks are running
    counts inside a range. Only the first group of a range can begin in an earlier one: these
    few groups, at most two rows per range, are broadcast with their offsets and quartiles. No class
    reaches the driver, no group needs a task of its own, and values of one group may fill many ranges.
    """
    kind = df.schema[target].dataType
    rows = unpivot(nan_to_null(df).where(col(target).isNotNull()).withColumn("__class", col(target)), features, "double", ids=["__class"])
    rows = rows.select(F.col("__class").alias("class"), "feature", "value").where(F.col("value").isNotNull())
    counts = rows.groupBy("class", "feature", "value").agg(F.count(F.lit(1)).alias("k"))
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut_lineage(counts.repartitionByRange(ranges, "class", "feature", "value").withColumn("part", F.spark_partition_id()))
    group, here = ["class", "feature"], Window.partitionBy("part", "class", "feature")
    # Groups in several ranges, with the rows before each range and in all.
    parts = dealt.groupBy("part", *group).agg(F.sum("k").alias("inside"))
    whole = Window.partitionBy(*group)
    spans = parts.withColumns({
        "ranges": F.count(F.lit(1)).over(whole), "all": F.sum("inside").over(whole),
        "before": F.sum("inside").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside")})
    spans = cut_lineage(spans.where(F.col("ranges") > 1).select("part", *group, "all", "before"))
    ranked = dealt.join(F.broadcast(spans), ["part", *group], "left").withColumns({
        "total": F.coalesce("all", F.sum("k").over(here)),
        "upto": F.coalesce("before", F.lit(0)) + F.sum("k").over(here.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))})
    names, wanted = ["q1", "median", "q3"], {}
    for name, p in zip(names, (0.25, 0.5, 0.75)):
        position = (F.col("total") - 1) * p
        first = F.floor(position)
        for end, rank in (("a", first), ("b", F.least(first + 1, F.col("total") - 1))):
            wanted[f"{name}_{end}"] = F.when((F.col("upto") - F.col("k") <= rank) & (rank < F.col("upto")), F.col("value"))
    marked = ranked.withColumns(wanted)
    # Quartiles of groups in several ranges; all others find theirs in their own range.
    far = cut_lineage(marked.where(F.col("all").isNotNull()).groupBy(*group).agg(*[F.max(c).alias(f"far_{c}") for c in wanted]))
    found = marked.join(F.broadcast(far), group, "left").withColumns({c: F.coalesce(f"far_{c}", F.max(c).over(here)) for c in wanted})
    shares = {n: (F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p) for n, p in zip(names, (0.25, 0.5, 0.75))}
    found = found.withColumns({n: F.col(f"{n}_a") + shares[n] * (F.col(f"{n}_b") - F.col(f"{n}_a")) for n in names})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    boxes = found.groupBy(*group).agg(
        F.max("total").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("k"))).alias("n_outliers"), *[F.max(n).alias(n) for n in names])
    return boxes.withColumn("class", F.col("class").cast(kind))


def box_by_target(
    df: DataFrame, target: str, max_features: int | None = None, max_classes: int | None = None
) -> DataFrame | None:
    """Boxes of the numeric features by class, a table of any size; of the first ones and the most frequent classes, if asked."""
    features = numeric_columns(df, target)[:max_features]
    if not features:
        return None
    if max_classes is None:
        return class_boxes(df, features, target)
    classes = [r["value"] for r in value_counts(df, target, max_classes).collect()]
    return box_summary(df, features, target, classes)


def box_separation(
    df: DataFrame, target: str, max_features: int | None = None, max_classes: int | None = None
) -> DataFrame | None:
    """Boxes for the classes in sorted order, the first ones if asked; None above 20 classes."""
    features = numeric_columns(df, target)[:max_features]
    values = few_values(df, target, K.TOP_VALUES) if features else None
    return box_summary(df, features, target, values[:max_classes]) if values else None


def feature_vs_target(
    df: DataFrame, target: str, keys: list[str], max_features: int | None = None, rows: int = K.PLOT_SAMPLE_ROWS
) -> tuple[str, DataFrame]:
    """A sample of ``rows`` scatter points for a numeric target with over 20 values, else boxes."""
    from featloom.operators.sampling import sample_random

    numeric = class_of(df.schema[target].dataType) == NUMERIC
    if numeric and few_values(df, target, K.TOP_VALUES) is None:
        features = numeric_columns(df, target)[:max_features]
        points = sample_random(df, rows, keys)
        return "scatter", unpivot(points, features, "double", ids=[target])
    return "boxes", box_by_target(df, target, max_features)


def missing_patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per combination of missing columns: ``pattern, n_missing, n``.

    ``pattern`` has one 0/1 per column, in column order; rows without anything
    missing form the all-0 pattern.
    """
    df, columns = nan_to_null(df), columns or df.columns
    marks = [F.when(col(c).isNull(), "1").otherwise("0") for c in columns]
    pattern = df.select(F.concat(*marks).alias("pattern"))
    return pattern.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).select(
        "pattern", F.length(F.regexp_replace("pattern", "0", "")).alias("n_missing"), "n"
    )


def scale_ranges(df: DataFrame, target: str | None = None) -> DataFrame:
    """Range of each numeric feature, its share of the largest, and dominance."""
    features = numeric_columns(df, target)
    if not features:
        return df.sparkSession.createDataFrame(
            [], "ordinal int, feature string, value_range double, normalized double, is_dominant boolean"
        )
    rows = stat_rows(df, {f: {"value_range": F.max(as_double(f)) - F.min(as_double(f))} for f in features}, 2)
    largest = F.max("value_range").over(Window.partitionBy())  # one row per column
    share = F.try_divide(F.col("value_range"), largest)
    return (
        rows.where(F.col("value_range").isNotNull())
        .select("ordinal", "feature", "value_range", share.alias("normalized"),
                F.coalesce(share > K.DOMINANT_SHARE, F.lit(False)).alias("is_dominant"))
        .orderBy(F.desc("value_range"), "ordinal")
    )


def model_guidance(df: DataFrame, target: str | None = None, models: list[str] = tuple(K.MODELS)) -> DataFrame:
    """Advice per model from dominant ranges and collinear pairs."""
    from featloom.operators.correlation import collinear_pairs

    dominant = scale_ranges(df, target).where("is_dominant").agg(
        F.array_join(
            F.transform(
                F.slice(
                    F.array_sort(F.collect_list(F.struct((-F.col("value_range")).alias("r"), "ordinal", "feature"))),
                    1, 2,
                ),
                lambda s: s["feature"],
            ),
            ", ",
        ).alias("dominant")
    )  # rows of one entry per column
    first_pair = collinear_pairs(df, target).agg(
        F.min(F.struct("i", "j", "pair", "corr")).alias("p"), F.count(F.lit(1)).alias("n_pairs")
    )
    facts = dominant.withColumn("one", F.lit(1)).join(first_pair.withColumn("one", F.lit(1)), "one")
    asked = facts.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    model, has_pair = F.col("model"), F.col("n_pairs") > 0
    parts = F.concat_ws(
        ". ",
        F.when(model.isin(K.SCALE_MODELS) & (F.col("dominant") != ""), F.concat(F.lit("Scale "), F.col("dominant"))),
        F.when(
            (model == K.LOGISTIC) & has_pair,
            F.concat(F.lit("Consider dropping one of "), F.col("p.pair"), F.lit(" (r="),
                     F.format_string("%.2f", F.col("p.corr")), F.lit(")")),
        ),
        F.when(model == K.TREE, "Scaling not required"),
        F.when((model == K.TREE) & has_pair, "Multicollinearity not critical for trees"),
    )
    return asked.select(
        "model",
        F.when(parts == "", "No immediate action needed.").otherwise(F.concat(parts, F.lit("."))).alias("guidance"),
    )


def feature_space(df: DataFrame, target: str, x: str, y: str, bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """2-D binned counts per class: the scatter of two features at any size.

    Empty if one of the two has no values.
    """
    edges = bounds(df, [x, y])
    if len(edges) < len({x, y}):
        kind = df.schema[target].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"bin_x int, bin_y int, class {kind}, n bigint")
    return (
        df.select(
            _bin(as_double(x), *edges[x], bins).alias("bin_x"),
            _bin(as_double(y), *edges[y], bins).alias("bin_y"),
            col(target).alias("class"),
        )
        .where(F.col("bin_x").isNotNull() & F.col("bin_y").isNotNull())
        .groupBy("bin_x", "bin_y", "class").agg(F.count(F.lit(1)).alias("n"))
    )


def unpivot_metrics(results: DataFrame) -> DataFrame:
    """(model, experiment) x (accuracy, f1_score) -> metric, score."""
    return results.unpivot(["model", "experiment"], ["accuracy", "f1_score"], "metric", "score")
