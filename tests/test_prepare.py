"""Sampling, outliers, imputation, encoding, scaling, ingest, streams."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featloom.operators import casting, derive, encode, outliers, preprocess, sampling
from featloom.operators.encode import fit_levels, frequency_encode, label_encode, one_hot_encode
from featloom.operators.preprocess import PrepConfig, fit_prep
from featloom.session import shared_dir
from featloom.sources import files, messy
from featloom.streaming.apply import prepare_stream


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


# --- sampling ------------------------------------------------------------------------


def test_sample_is_exact_and_stable(spark):
    df = spark.range(0, 10_000, 1, 7).withColumn("t", F.expr("case when id % 10 = 0 then 'r' else 's' end"))
    first = sampling.sample_random(df, 777, ["id"])
    second = sampling.sample_random(df.repartition(3), 777, ["id"])
    assert first.count() == 777
    assert set(column(first, "id")) == set(column(second, "id"))
    assert sampling.sample_random(df, 20_000, ["id"]).count() == 10_000
    assert sampling.sample_random(df, 0, ["id"]).count() == 0
    assert sampling.sample_random(df.limit(0), 5, ["id"]).count() == 0
    parts = dict(sampling.sample_stratified(df, 1_005, "t", ["id"]).groupBy("t").count().collect())
    assert sum(parts.values()) == 1_005 and parts["r"] in (100, 101)


def test_sample_with_a_hot_key(spark):
    """A third of the rows are copies of one key; the size must still be exact."""
    df = spark.range(0, 3_000).selectExpr("case when id < 1000 then 7 else id end as id", "id as row")
    for size in (1, 10, 500, 1_500, 2_999):
        assert sampling.sample_random(df, size, ["id"]).count() == size


def test_stratified_sample_says_how_it_was_drawn(spark):
    df = spark.range(300).selectExpr("id", "id % 3 as fits", "id as many", "1 as one", "case when id > 5 then id % 2 end as gaps", "id div 299 as lone")
    asked = {"fits": "stratified", "many": "more than 20 classes", "one": "fewer than 2 classes", "gaps": "missing values in the target", "lone": "a class of one row"}
    for target, expected in asked.items():
        sample, outcome = sampling.stratified_sample(df, 60, target, ["id"])
        row = outcome.first()
        assert sample.count() == 60 == row["rows"]
        assert (row["strategy"], row["reason"]) == (("stratified", None) if target == "fits" else ("plain", expected))
        if target != "fits":
            with pytest.raises(ValueError, match=expected):
                sampling.stratified_sample(df, 60, target, ["id"], on_impossible="error")
    assert sampling.stratified_sample(df, 298, "fits", ["id"])[1].first()["reason"] == "no room for every class on both sides"
    assert sampling.stratified_sample(df, 500, "many", ["id"])[1].first()["strategy"] == "all"


def test_stratified_falls_back(spark):
    base = spark.range(500)
    cases = [
        base.withColumn("t", F.lit("one")),
        base.withColumn("t", F.col("id").cast("string")),
        base.withColumn("t", F.when(F.col("id") > 0, "x").otherwise("lonely")),
        base.withColumn("t", F.when(F.col("id") % 2 > 0, "x").when(F.col("id") % 3 > 0, "y")),
    ]
    for df in cases:
        assert set(column(sampling.sample_stratified(df, 50, "t", ["id"]), "id")) == set(
            column(sampling.sample_random(df, 50, ["id"]), "id"))


def test_split_is_a_partition(spark):
    df = spark.range(0, 5_000, 1, 4)
    train, test = sampling.split(df, ["id"])
    assert train.count() + test.count() == 5_000 and train.intersect(test).count() == 0
    assert 900 < test.count() < 1_100
    again = sampling.split(df.coalesce(1), ["id"])[1]
    assert column(test, "id") == column(again, "id")


# --- outliers, derived columns, casts ---------------------------------------------------


def test_outliers_match_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(1_000), "x": rng.standard_t(2, 1_000), "y": rng.standard_t(2, 1_000)})
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    clipped = outliers.handle_outliers(df, ["x"], "clip")
    lo, hi = pdf.x.mean() - 3 * pdf.x.std(), pdf.x.mean() + 3 * pdf.x.std()
    got = np.array(column(clipped, "x"), dtype=float)
    assert np.allclose(got, pdf.x.clip(lo, hi), equal_nan=True)

    def removed(order):
        kept = pdf
        for c in order:
            m, s = kept[c].mean(), kept[c].std()
            kept = kept[(kept[c] >= m - 3 * s) & (kept[c] <= m + 3 * s)]
        return list(kept.id)

    assert column(outliers.handle_outliers(df, ["x", "y"], "remove"), "id") == removed(["x", "y"])
    assert column(outliers.handle_outliers(df, ["y", "x"], "remove"), "id") == removed(["y", "x"])
    assert outliers.handle_outliers(df, ["x"], "none") is df
    with pytest.raises(ValueError):
        outliers.handle_outliers(df, ["x"], "trim")


def test_clip_single_and_empty(spark):
    one = spark.createDataFrame([(1, 5.0)], "id int, x double")
    assert column(outliers.clip_outliers(one, ["x"]), "x") == [5.0]
    assert outliers.clip_outliers(one.where("id > 1"), ["x"]).count() == 0


def test_derived_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3, "t"), (2, None, 4, "u")], "id int, a double, b int, s string")
    made = derive.polynomials(derive.interactions(df, [("a", "b"), ("a", "s"), ("a", "zz")]), ["a", "s"], 3)
    assert made.columns == ["id", "a", "b", "s", "a_x_b", "a^2", "a^3"]
    assert column(made, "a_x_b") == [6.0, None] and column(made, "a^3") == [8.0, None]


def test_cast_is_all_or_nothing(spark):
    df = spark.createDataFrame([(1, "5", "7"), (2, None, "x")], "id int, a string, b string")
    got = casting.cast_types(df, {"a": "int", "b": "int", "zz": "int"})
    assert dict(got.dtypes) == {"id": "int", "a": "int", "b": "string"}
    assert column(got, "a") == [5, None]


# --- imputation ---------------------------------------------------------------------------


def test_imputers(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, 1.0), (5, None)], "id int, x double")
    fill = {s: column(preprocess.fit_imputer(df, s, ["x"], -9).apply(df), "x")[-1]
            for s in ("Mean", "Median", "Most Frequent", "Constant")}
    assert fill == {"Mean": 2.0, "Median": 2.0, "Most Frequent": 1.0, "Constant": -9.0}
    assert preprocess.fit_imputer(df, "Drop Rows", ["x"]).apply(df).count() == 4
    assert preprocess.fit_imputer(df, "Drop Rows", []).apply(df).count() == 5
    with pytest.raises(ValueError):
        preprocess.fit_imputer(df, "Zero", ["x"])


def test_wholly_missing_column_is_reported(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    for strategy in ("Mean", "Median", "Most Frequent"):
        imputer = preprocess.fit_imputer(df, strategy, ["x"])
        assert imputer.unfilled == ["x"] and column(imputer.apply(df), "x") == [None, None]


# --- encodings ------------------------------------------------------------------------------


@pytest.fixture
def levels(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id int, c string")


@pytest.mark.parametrize("limit", [100, 0])
def test_encodings_small_and_large(spark, levels, limit):
    """The distributed path (limit 0) must give what the fetched one gives."""
    tables = fit_levels(levels, ["c"], small_limit=limit)
    assert (tables["c"].table is not None) == (limit == 0)
    assert column(label_encode(levels, tables), "c") == [0, 1, 2, 0]
    got = column(frequency_encode(levels, tables), "c")
    assert got == pytest.approx([2 / 3, 1 / 3, 0, 2 / 3])
    hot = one_hot_encode(levels, tables, "columns" if limit else "vector")
    if limit:
        assert hot.columns == ["id", "c_a", "c_b", "c_nan"]
        assert column(hot, "c_a") == [1.0, 0.0, 0.0, 1.0] and column(hot, "c_nan") == [0.0, 0.0, 1.0, 0.0]
    else:
        assert [list(v.toArray()) for v in column(hot, "c_vec")] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 0]]


@pytest.mark.parametrize("limit", [100, 0])
def test_unseen_levels(spark, levels, limit):
    tables = fit_levels(levels.where("c is not null"), ["c"], small_limit=limit)
    new = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, c string")
    with pytest.raises(Exception, match="not seen in fit"):
        label_encode(new, tables).collect()
    assert column(label_encode(new, tables, "null"), "c") == [0, None, None]
    assert column(label_encode(new, tables, "minus_one"), "c") == [0, -1, -1]
    assert column(frequency_encode(new, tables), "c") == pytest.approx([2 / 3, 0, 0])
    hot = one_hot_encode(new, tables, "columns" if limit else "vector")
    if limit:
        assert column(hot, "c_a") == [1.0, 0.0, 0.0] and column(hot, "c_b") == [0.0, 0.0, 0.0]
    else:
        assert [list(v.toArray()) for v in column(hot, "c_vec")] == [[1, 0], [0, 0], [0, 0]]


def test_many_levels_with_a_hot_one(spark):
    df = spark.range(0, 6_000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('l', id) end as c")
    small, large = fit_levels(df, ["c"]), fit_levels(df, ["c"], small_limit=10)
    a, b = label_encode(df, small), label_encode(df, large)
    assert column(a, "c") == column(b, "c")
    assert column(frequency_encode(df, small), "c") == column(frequency_encode(df, large), "c")
    assert a.select("c").distinct().count() == 4_001


def test_nan_text_shares_the_missing_class(spark):
    df = spark.createDataFrame([(1, "nan"), (2, None), (3, "a")], "id int, c string")
    assert column(label_encode(df, fit_levels(df, ["c"])), "c") == [1, 1, 0]
    assert column(label_encode(df, fit_levels(df, ["c"], small_limit=0)), "c") == [1, 1, 0]
    assert one_hot_encode(df, fit_levels(df, ["c"])).columns == ["id", "c_a", "c_nan", "c_nan_missing"]


@pytest.mark.parametrize("scaling", ["StandardScaler", "MinMaxScaler", "RobustScaler", "No Scaling"])
def test_slots_scale_as_columns_do(spark, scaling):
    """What a slot stands for, from level counts alone, equals the scaled indicator column."""
    rows = [(i, "a" if i % 2 else ("b" if i % 3 else None)) for i in range(40)] + [(40, "nan"), (41, "c")]
    df = spark.createDataFrame(rows, "id int, c string")
    config = lambda form: preprocess.PrepConfig("Mean", "One-Hot Encoding", scaling, one_hot=form)
    wide = preprocess.fit_prep(df, None, config("columns"), ["c"]).apply(df)
    prep = preprocess.fit_prep(df, None, config("vector"), ["c"])
    scale = prep.slot_scales["c_vec"]
    names = scale.slots.names
    assert names == ["c_a", "c_b", "c_c", "c_nan", "c_nan_missing"] == wide.columns[1:]
    applied = prep.apply(df)
    assert [a["name"] for a in applied.schema["c_vec"].metadata["ml_attr"]["attrs"]["numeric"]] == names
    vectors = {r["id"]: r["c_vec"].toArray() for r in applied.collect()}
    for r in wide.collect():
        assert vectors[r["id"]] - scale.shift / scale.width == pytest.approx([r[n] for n in names])
    counts, n = prep.slot_counts(df)
    assert counts["c_vec"].tolist() == scale.slots.counts.tolist() == [20, 13, 1, 1, 7] and n == 42


# --- scaling, sequence ----------------------------------------------------------------------


def test_scalers(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0), (4, 9.0, 5.0)], "id int, x double, k double")
    standard = preprocess.fit_scaler(df, "StandardScaler", ["x", "k"]).apply(df)
    assert column(standard, "x") == pytest.approx([-0.97333, -0.64889, 0, 1.62221], abs=1e-4)
    minmax = preprocess.fit_scaler(df, "MinMaxScaler", ["x", "k"]).apply(df)
    assert column(minmax, "x") == pytest.approx([0, 0.125, 0.375, 1])
    robust = preprocess.fit_scaler(df, "RobustScaler", ["x", "k"]).apply(df)
    assert column(robust, "x") == pytest.approx([-2 / 3.5, -1 / 3.5, 1 / 3.5, 6 / 3.5])
    for scaled in (standard, minmax, robust):
        assert column(scaled, "k") == [0.0] * 4
    assert preprocess.fit_scaler(df, "No Scaling", ["x"]).apply(df) is df


def test_prep_scales_codes_and_keeps_the_rest(spark, levels):
    df = levels.withColumns({"x": F.col("id") * 1.0, "flag": F.col("id") > 2, "day": F.current_date()})
    prep = fit_prep(df, "id", PrepConfig("Mean", "Label Encoding", "MinMaxScaler"))
    assert prep.features == ["c", "x", "flag"]
    assert column(prep.apply(df), "c") == [0.0, 0.5, 1.0, 0.0] and column(prep.apply(df), "flag") == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        PrepConfig(scaling="Log")


def test_prep_on_a_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    prep = fit_prep(batch, None, PrepConfig("Mean", "Frequency Encoding", "StandardScaler"), ["event_type", "value"])
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (prepare_stream(stream, prep).writeStream.format("memory").queryName("prepared")
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    query.processAllAvailable()
    query.stop()
    assert spark.table("prepared").exceptAll(prep.apply(batch)).count() == 0
    assert spark.table("prepared").count() == batch.count()
    with pytest.raises(ValueError):
        prepare_stream(batch, prep)


# --- sources ----------------------------------------------------------------------------------


def test_csv_types_and_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,e\n1,1.5,x,True,2020-01-01\nNA,nan,"two\nlines",False,2020-01-02\n3,2e3,null,,1d\n')
    df = files.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "string"}
    got = [tuple(r) for r in df.collect()]
    assert got[1] == (None, None, "two\nlines", False, "2020-01-02") and got[2][2:4] == (None, None)
    table, info = files.load_with_metadata(spark, str(path), 2)
    row = info.first()
    assert (row["total_rows"], row["loaded_rows"], row["columns"], row["is_sampled"]) == (3, 2, 5, True)
    assert table.count() == 2 and row["file_size_mb"] == pytest.approx(path.stat().st_size / 1048576)


def test_generated_table(spark):
    a = messy.generate_messy(spark, 2_000, 3).toPandas()
    b = messy.generate_messy(spark, 2_000, 8).toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert 0.05 < a.Income.isna().mean() < 0.15 and 0.02 < a.Education.isna().mean() < 0.08
    assert abs(a.Age.mean() - 35) < 1.5 and abs(a.YearsEmployed.mean() - 5) < 0.6
    assert 0.4 < a.Purchased.mean() < 0.6 and a.CreditScore.between(300, 849).all()


# --- shared folder --------------------------------------------------------------------------


def test_shared_folder_comes_from_the_session():
    def session(folder, master):
        return SimpleNamespace(conf={"spark.checkpoint.dir": folder} if folder else {},
                               sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("hdfs://x/cp", "yarn")) == "hdfs://x/cp"
    assert shared_dir(session(None, "local[2]")).endswith("featloom-checkpoints")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session(None, "yarn"))


def test_missing_class_may_be_the_hot_one(spark):
    df = spark.range(0, 3_000).selectExpr("id", "case when id % 3 > 0 then concat('l', id) end as c")
    small, large = fit_levels(df, ["c"]), fit_levels(df, ["c"], small_limit=10)
    assert large["c"].table.where("level = 'nan'").first()["all_rows"] == 1_000
    assert column(label_encode(df, small), "c") == column(label_encode(df, large), "c")


def test_long_levels_stay_distributed(spark, monkeypatch):
    """Few levels, but too large together to fetch."""
    monkeypatch.setattr(encode, "SMALL_BYTES", 1_000)
    df = spark.range(40).selectExpr("id", "repeat(chr(65 + id % 20), 100) as c")
    tables = fit_levels(df, ["c"])
    assert tables["c"].table is not None
    assert column(label_encode(df, tables), "c") == [i % 20 for i in range(40)]


@pytest.mark.parametrize("hot", ["known", "missing", "unseen"])
def test_hot_levels_do_not_meet_in_one_task(spark, hot):
    """The executed join, with adaptive execution and automatic broadcasts off."""
    level = {"known": "'l7'", "missing": "NULL", "unseen": "'never fitted'"}[hot]
    rows = spark.range(40_000, numPartitions=8).selectExpr(f"CASE WHEN id % 2 = 0 THEN {level} ELSE concat('l', id % 5000) END AS c")
    tables = fit_levels(spark.range(5000).selectExpr("concat('l', id) AS c"), ["c"], small_limit=10)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = label_encode(rows, tables, on_unseen="null")
        sizes = sorted(r["n"] for r in coded.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        assert sum(sizes) == 40_000 and sizes[-1] < 3 * sizes[len(sizes) // 2]
        assert frequency_encode(rows, tables).where("c > 0").count() == (40_000 if hot == "known" else 20_000)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
