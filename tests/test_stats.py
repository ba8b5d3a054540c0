"""Profile, signal, correlation and quantiles on small tables worked out by hand."""

import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from featloom import constants as K
from featloom.functions.columns import nan_to_null
from featloom.operators import casting, correlation, moments, profile, signal, summaries
from featloom.operators.quantiles import exact_quantiles


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- quantiles ---------------------------------------------------------------------


def test_quantiles_of_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.25, 0.5, 0.0, 1.0])[None, "x"] == [1.75, 2.5, 1.0, 10.0]


def test_quantiles_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(None, 7.0)], "x double, y double")
    found = exact_quantiles(df, ["x", "y"], [0.5, 0.9])
    assert found[None, "x"] == [None, None]
    assert found[None, "y"] == [7.0, 7.0]


@pytest.mark.parametrize("limit", [1, 50, 1_000_000])
def test_quantiles_with_a_hot_value(spark, limit):
    """A third of all rows share one value; narrowing must still end and be exact."""
    rng = random.Random(1)
    values = [5.0] * 10_000 + [rng.gauss(0, 10) for _ in range(20_000)]
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": [-v for v in values]})).repartition(8)
    p = [0.01, 0.05, 0.25, 0.5, 0.65, 0.75, 0.95, 0.99]
    found = exact_quantiles(df, ["x", "y"], p, inside_limit=limit)
    assert np.allclose(found[None, "x"], np.quantile(values, p), atol=1e-12)
    assert np.allclose(found[None, "y"], np.quantile([-v for v in values], p), atol=1e-12)


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 9_000, p=[0.7, 0.2, 0.1]), "x": rng.exponential(1, 9_000)})
    found = exact_quantiles(spark.createDataFrame(pdf), ["x"], [0.25, 0.5, 0.75], by="g", inside_limit=3)
    for g, part in pdf.groupby("g"):
        assert np.allclose(found[g, "x"], part.x.quantile([0.25, 0.5, 0.75]), atol=1e-12)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.floats(0, 1))
def test_quantiles_match_numpy(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert math.isclose(exact_quantiles(df, ["x"], [p])[None, "x"][0], np.quantile(values, p), abs_tol=1e-9)


# --- correlation --------------------------------------------------------------------


@pytest.fixture(scope="module")
def messy(spark):
    rng = np.random.default_rng(7)
    n = 3_000
    a = rng.normal(1e6, 1, n)
    pdf = pd.DataFrame({"a": a, "b": 3 * a + rng.normal(0, 1, n), "c": rng.exponential(2, n), "k": 0.1, "d": -a})
    pdf.loc[rng.random(n) < 0.2, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.3, "c"] = np.nan
    return pdf


def test_correlations_match_pandas(spark, messy):
    df = nan_to_null(spark.createDataFrame(messy)).repartition(5)
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in rows(correlation.corr_matrix(df))}
    want = messy.corr()
    for a in messy:
        for b in messy:
            if "k" in (a, b):
                assert got[a, b] is None
            else:
                assert math.isclose(got[a, b], want.loc[a, b], abs_tol=1e-9), (a, b)


def test_correlations_of_200_columns_in_tiles(spark):
    """Several bands, gaps, a constant and an offset that dwarfs the spread; then a target against all."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(300, 200)) + rng.normal(size=(300, 1))
    values[rng.random(values.shape) < 0.1] = np.nan
    values[:, 7], values[:, 150] = 4.5, values[:, 3] + 1e9
    pdf = pd.DataFrame(values, columns=[f"v{i}" for i in range(200)])
    df = nan_to_null(spark.createDataFrame(pdf).repartition(5))
    got = moments.pair_correlations(df, list(pdf.columns), [(i, j) for i in range(200) for j in range(i, 200)]).toPandas()
    want = pdf.corr().to_numpy()
    assert len(got) == 200 * 201 // 2 and not got.duplicated(["i", "j"]).any()
    undefined = (got.i == 7) | (got.j == 7)
    assert got.loc[undefined, "corr"].isna().all()
    rest = got[~undefined]
    assert np.abs(rest["corr"].to_numpy() - want[rest.i, rest.j]).max() < 1e-6
    ranked = {r["feature"]: r["corr"] for r in rows(correlation.corr_to_target(df, "v0"))}
    assert len(ranked) == 198 and all(math.isclose(r, abs(want[0, int(f[1:])]), abs_tol=1e-6) for f, r in ranked.items())


@pytest.mark.parametrize("tasks", [1, 97])
def test_tiles_meet_a_bounded_number_of_blocks(spark, tasks):
    """The second round doesn't grow with the number of tasks, and neither result nor rows depend on it."""
    df = spark.range(2000).select(F.col("id").cast("double").alias("a"), (F.col("id") * F.col("id")).cast("double").alias("b")).repartition(tasks)
    found = moments.pair_correlations(df, ["a", "b"], [(0, 1), (1, 1)])
    got = {(r["i"], r["j"]): r["corr"] for r in rows(found)}
    x = np.arange(2000.0)
    assert math.isclose(got[0, 1], np.corrcoef(x, x * x)[0, 1], abs_tol=1e-12) and math.isclose(got[1, 1], 1.0)
    assert rows(moments.pair_correlations(df.limit(0), ["a", "b"], [(0, 1)])) == [{"i": 0, "j": 1, "corr": None}]
    assert moments.pair_correlations(df, ["a", "b"], []).count() == 0


def test_correlation_of_constant_within_the_pair(spark):
    pdf = pd.DataFrame({"x": [7.0, 1.3, 1.3, 1.3], "y": [np.nan, 1.0, 2.0, 4.0]})
    got = rows(correlation.corr_matrix(nan_to_null(spark.createDataFrame(pdf))))
    assert [r["corr"] for r in got if r["feature_a"] != r["feature_b"]] == [None, None]


def test_many_features_use_the_matrix_form(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(500, 15)), columns=[f"v{i}" for i in range(15)])
    pdf["t"] = pdf.v0 + rng.normal(size=500)
    got = {r["feature"]: r["r"] for r in rows(signal.pearson_to_target(spark.createDataFrame(pdf), list(pdf)[:15], "t"))}
    assert all(math.isclose(got[c], pdf[c].corr(pdf.t), abs_tol=1e-9) for c in got) and len(got) == 15


def test_collinear_pairs(spark, messy):
    df = nan_to_null(spark.createDataFrame(messy))
    got = rows(correlation.collinear_pairs(df, "c").orderBy("i", "j"))
    assert [r["pair"] for r in got] == ["a ↔ b", "a ↔ d", "b ↔ d"]
    assert got[1]["corr"] == pytest.approx(1) and got[1]["signed_corr"] == pytest.approx(-1)
    assert correlation.collinear_pairs(df.select("a", "c"), "c").count() == 0


def test_corr_to_target_codes_classes_by_rank(spark):
    df = spark.createDataFrame([(0.0, "b"), (2.0, "c"), (-1.0, "a"), (-2.0, None)], "x double, t string")
    assert rows(correlation.corr_to_target(df, "t"))[0]["corr"] == pytest.approx(
        abs(np.corrcoef([0, 2, -1, -2], [1, 2, 0, -1])[0, 1]))


# --- signal ---------------------------------------------------------------------------


def test_signal_on_constants_and_empty(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a", "u"), (2.0, 5.0, "b", "u"), (4.0, 5.0, "a", "u")],
                               "x double, k double, c string, one string")
    got = {r["feature"]: r for r in rows(signal.signal_strength(df, "x"))}
    assert got["k"]["strength"] is None and got["k"]["signal"] == "Low"
    assert got["one"]["strength"] == 0.0
    by_class = {r["feature"]: r for r in rows(signal.signal_strength(df, "c"))}
    assert by_class["one"]["strength"] is None and by_class["one"]["signal"] == "Low"
    empty = rows(signal.signal_strength(df.where("x > 100"), "c"))
    assert {r["signal"] for r in empty} == {"Low"} and len(empty) == 3


def test_bool_and_date_features(spark):
    df = spark.createDataFrame([(True, "2020-01-01", "p"), (False, "2020-01-02", "q")], "b boolean, d string, t string")
    df = df.withColumn("d", F.to_date("d"))
    report = {r["feature"]: r for r in rows(signal.feature_report(df, "t", [K.KNN]))}
    assert report["b"]["signal"] == "High" and report["b"]["flags"] == K.FLAG_STRONG  # not marked numeric
    assert report["b"]["scale_sensitivity"] == "Low"
    assert report["d"]["signal"] == "High" and report["d"]["scale_sensitivity"] == "N/A"


def test_cramers_v_matches_chi_square(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.choice(list("uvwx"), 800)})
    pdf["b"] = np.where(rng.random(800) < 0.6, pdf.a.str.upper(), rng.choice(list("PQ"), 800))
    o = pd.crosstab(pdf.a, pdf.b).to_numpy(float)
    e = o.sum(1, keepdims=True) @ o.sum(0, keepdims=True) / o.sum()
    want = np.sqrt(((o - e) ** 2 / e).sum() / o.sum() / (min(o.shape) - 1))
    got = rows(signal.cramers_v(spark.createDataFrame(pdf), ["a"], "b"))[0]["cramers_v"]
    assert got == pytest.approx(want)


def test_sensitivity_of_single_row(spark):
    got = rows(signal.scale_sensitivity(spark.createDataFrame([(500.0,)], "x double")))[0]
    assert got["sensitivity"] == "Low" and got["cv"] is None


# --- profile --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "values, kind, valid",
    [
        ("double: 1.0 2.0", "binary", True),
        ("double: 1.5 2.5", "continuous", False),
        ("string: a b c", "multiclass", True),
        ("string: None None", "unknown", False),
        ("int: 3 3", "binary", False),
    ],
)
def test_target_type(spark, values, kind, valid):
    data_type, items = values.split(": ")
    convert = {"double": float, "string": str, "int": int}[data_type]
    data = [(None if v == "None" else convert(v),) for v in items.split()]
    info = profile.target_type(spark.createDataFrame(data, f"t {data_type}"), "t").first()
    assert (info["target_kind"], info["is_valid_for_training"]) == (kind, valid)


def test_schema_summary(spark):
    df = spark.createDataFrame([(i, f"n{i}", None if i % 2 else "z") for i in range(60)], "a int, b string, c string")
    got = {r["column"]: r for r in rows(profile.schema_summary(df))}
    assert got["b"]["high_cardinality"] and got["b"]["n_unique"] == 60
    assert got["c"]["missing_pct"] == 50.0 and got["a"]["missing_pct"] is None
    approx = {r["column"]: r["n_unique"] for r in rows(profile.n_distinct(df, ["b", "c"], approximate=True))}
    assert abs(approx["b"] - 60) < 6 and approx["c"] == 1


def test_nan_is_missing(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert rows(profile.missing_pct(df))[0]["missing_pct"] == pytest.approx(200 / 3)


def test_validate_schema(spark):
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    got = {r["column"]: r for r in rows(casting.validate_schema(df, ["a", "z"], {"a": "int"}))}
    assert got["z"]["error"] == "Missing column: z"
    assert got["a"]["error"] == "Column a has type string, expected int" and got["a"]["unconvertible"] == 1


# --- summaries --------------------------------------------------------------------------


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 3.0), (10.0, 3.0), (None, 3.0), (5.0, 3.0)], "x double, k double")
    got = {(r["feature"], r["bin"]): r["n"] for r in rows(summaries.histograms(df, ["x", "k"], 2))}
    assert got == {("x", 0): 1, ("x", 1): 2, ("k", 0): 4}


def test_target_distribution_kinds(spark):
    ids = spark.range(100)
    assert summaries.target_distribution(ids.selectExpr("id % 3 as t"), "t")[0] == "counts"
    assert summaries.target_distribution(ids.selectExpr("id as t"), "t")[0] == "histogram"
    kind, top = summaries.target_distribution(ids.selectExpr("cast(id as string) as t"), "t")
    assert kind == "top" and top.count() == 20


def test_box_whiskers(spark):
    df = spark.createDataFrame([(float(v), "a") for v in [1, 2, 3, 4, 100]] + [(9.0, None)], "x double, t string")
    got = rows(summaries.box_by_target(df, "t"))[0]
    assert (got["q1"], got["median"], got["q3"]) == (2.0, 3.0, 4.0)
    assert (got["whisker_low"], got["whisker_high"], got["n_outliers"], got["max"]) == (1.0, 4.0, 1, 100.0)
    many = spark.range(30).selectExpr("id as x", "id as t")
    assert summaries.box_separation(many, "t") is None


def test_boxes_of_very_many_classes(spark):
    """A class with a third of the rows over several ranges, thousands with a few rows, names that clash."""
    rng = np.random.default_rng(4)
    cls = np.where(np.arange(9_000) % 3 == 0, 7, rng.integers(100, 3_000, 9_000))
    frame = pd.DataFrame({"class": cls, "value": rng.normal(size=9_000).round(2), "part": rng.integers(0, 5, 9_000).astype(float)})
    frame.loc[::50, "value"] = np.nan
    frame.loc[3, "value"] = 1e6
    df = spark.createDataFrame(frame).withColumn("class", F.when(F.col("class") != 101, F.col("class")))
    got = {(r["class"], r["feature"]): r for r in rows(summaries.class_boxes(df, ["value", "part"], "class"))}
    known = frame[frame["class"] != 101]
    assert got.keys() == {(c, f) for f in ("value", "part") for c, x in known.groupby("class")[f] if x.notna().any()}
    for (c, f), r in got.items():
        x = known.loc[known["class"] == c, f].dropna()
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert [r[k] for k in ("q1", "median", "q3", "min", "max", "whisker_low", "whisker_high")] == pytest.approx(
            [q1, q2, q3, x.min(), x.max(), inside.min(), inside.max()]), (c, f)
        assert (r["n"], r["n_outliers"]) == (len(x), len(x) - len(inside))
    assert summaries.class_boxes(df.limit(0), ["value"], "class").count() == 0


def test_feature_vs_target_scatter(spark):
    df = spark.range(50).selectExpr("id", "id * 2.0D as x", "cast(id as double) as t")
    kind, points = summaries.feature_vs_target(df, "t", ["id"])
    assert kind == "scatter" and points.count() == 100  # id and x for every row


def test_missing_patterns(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, "x"), (3, None)], "a int, b string")
    assert {r["pattern"]: (r["n_missing"], r["n"]) for r in rows(summaries.missing_patterns(df))} == {
        "01": (1, 2), "11": (2, 1), "00": (0, 1)}


def test_guidance_without_findings(spark):
    df = spark.createDataFrame([("a",)], "t string").withColumn("x", F.lit(None).cast("double"))
    got = {r["model"]: r["guidance"] for r in rows(summaries.model_guidance(df, "t"))}
    assert got[K.KNN] == "No immediate action needed." and got[K.TREE] == "Scaling not required."


def test_text_only_table(spark):
    """Nothing numeric: empty tables or None, never an error."""
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "c string, t string")
    assert correlation.corr_matrix(df, "t") is None
    for found in (correlation.collinear_pairs(df, "t"), correlation.corr_to_target(df, "t"),
                  summaries.scale_ranges(df, "t"), summaries.feature_histograms(df, "t")):
        assert found.count() == 0
    assert summaries.box_by_target(df, "t") is None and summaries.box_separation(df, "t") is None
    assert signal.feature_report(df, "t").count() == 4


def test_eta_squared_of_a_constant_that_has_no_exact_double(spark):
    df = spark.range(0, 1_000, 1, 4).selectExpr("0.1D as k", "0.1D as y", "cast(id % 7 as string) as t")
    assert rows(signal.eta_squared(df, ["k"], "t"))[0]["eta_squared"] == 0.0
    assert rows(signal.eta_squared_by_levels(df, ["t"], "y"))[0]["eta_squared"] == 0.0
    assert {r["signal"] for r in rows(signal.signal_strength(df, "t", ["k"]))} == {"Low"}


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert rows(profile.n_distinct(df, ["x"]))[0]["n_unique"] == 1


def test_huge_values_are_not_fractions(spark):
    df = spark.createDataFrame([(1e300,), (2.0,)], "t double")
    assert profile.target_type(df, "t").first()["target_kind"] == "binary"


def test_rows_without_target_count_for_spread_only(spark):
    data = [(1.0, "a"), (2.0, "a"), (3.0, "b"), (400.0, None)]
    df = spark.createDataFrame(data, "x double, t string")
    got = rows(signal.feature_report(df, "t", [K.KNN]))[0]
    assert got["scale_sensitivity"] == "High"
    values, mean = [1.0, 2.0, 3.0], 2.0
    want = (2 * 0.25 + 1.0) / sum((v - mean) ** 2 for v in values)
    assert rows(signal.signal_strength(df, "t"))[0]["strength"] == pytest.approx(want)
    spread = rows(signal.scale_sensitivity(df, ["x"]))[0]
    assert rows(signal._profile(df, "t", ["x"]))[0]["cv"] == pytest.approx(spread["cv"])


def test_long_texts_count_by_their_whole_content(spark):
    """Texts that differ only after a long common beginning are different levels."""
    df = spark.range(40).selectExpr(
        "concat(repeat('x', 5000), cast(id % 4 as string)) as c", "cast(id % 4 > 1 as string) as t", "id % 4 * 1.0D as y")
    assert rows(profile.n_distinct(df, ["c"]))[0]["n_unique"] == 4
    assert rows(signal.cramers_v(df, ["c"], "t"))[0]["cramers_v"] == pytest.approx(1.0)
    assert rows(signal.eta_squared_by_levels(df, ["c"], "y"))[0]["eta_squared"] == pytest.approx(1.0)


def test_nan_and_null_give_the_same_results(spark):
    nan = float("nan")
    data = [(1.0, 1.0, "a"), (nan, 2.0, "b"), (3.0, nan, "a"), (4.0, 4.5, "b"), (9.0, 1.5, "b"), (nan, nan, "a")]
    a = spark.createDataFrame(data, "x double, y double, t string")
    b = nan_to_null(a)
    for run in (
        lambda d: profile.schema_summary(d), lambda d: profile.missing_pct(d), lambda d: profile.n_distinct(d, ["x", "y"]),
        lambda d: profile.target_type(d, "x"), lambda d: profile.null_target_counts(d, "x"),
        lambda d: signal.feature_report(d, "t"), lambda d: signal.signal_strength(d, "y"),
        lambda d: signal.scale_sensitivity(d), lambda d: correlation.corr_matrix(d),
        lambda d: correlation.corr_to_target(d, "t"), lambda d: summaries.histograms(d, ["x", "y"]),
        lambda d: summaries.box_by_target(d, "t"), lambda d: summaries.missing_patterns(d),
        lambda d: summaries.value_counts(d, "x"), lambda d: summaries.scale_ranges(d, "t"),
    ):
        assert sorted(map(str, run(a).collect())) == sorted(map(str, run(b).collect()))
    assert exact_quantiles(a, ["x", "y"], [0.1, 0.5]) == exact_quantiles(b, ["x", "y"], [0.1, 0.5])


def test_quantiles_of_many_columns(spark):
    """Plans must stay small on wide tables."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(400, 40)), columns=[f"v{i}" for i in range(40)])
    start = time.time()
    found = exact_quantiles(spark.createDataFrame(pdf), list(pdf), [0.5])
    assert all(math.isclose(found[None, c][0], pdf[c].median(), abs_tol=1e-12) for c in pdf)
    assert time.time() - start < 60


def test_strength_does_not_depend_on_the_number_of_features(spark):
    wide = spark.range(200).selectExpr("id * 1.0D AS t", "1e6 + 1e-8 * id AS near", *[f"sin(id * {k}) AS x{k}" for k in range(1, 16)])
    few, many = ({r["feature"]: (r["strength"], r["signal"]) for r in rows(signal.signal_strength(wide, "t", ["near", *[f"x{k}" for k in range(1, n)]]))}
                 for n in (12, 13))
    assert all(many[f] == few[f] for f in few)


def test_corr_to_target_counts_present_classes_only(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0, 2.5], ["a", "b", "z", "z", None, "a"])), "x double, t string")
    expected = abs(np.corrcoef([1, 2, 3, 4, 5, 2.5], [0, 1, 2, 2, -1, 0])[0, 1])
    assert rows(correlation.corr_to_target(df, "t"))[0]["corr"] == pytest.approx(expected)


def test_feature_space_without_values(spark):
    df = spark.createDataFrame([(1.0, None, "a")], "x double, y double, t string")
    assert summaries.feature_space(df, "t", "x", "y").count() == 0
