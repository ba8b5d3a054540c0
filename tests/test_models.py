"""Training, nearest neighbours and verification."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featloom import constants as K
from featloom.operators import knn, metrics, models, sampling, verify
from featloom.operators.preprocess import PrepConfig
from featloom.sources.messy import messy_table

FULL = PrepConfig("Mean", "Label Encoding", "StandardScaler")


@pytest.fixture(scope="module")
def people(spark):
    return messy_table(spark.range(0, 600, 1, 4)).persist()


def test_continuous_target_is_refused(people):
    df = people.withColumn("t", F.randn(1))
    with pytest.raises(ValueError, match="continuous values"):
        models.train_evaluate(df, "t", K.LOGISTIC, FULL, ["id"])


def test_constant_target_is_refused(people):
    with pytest.raises(ValueError, match="two unique classes"):
        models.train_evaluate(people.withColumn("t", F.lit(1)), "t", K.LOGISTIC, FULL, ["id"])


@pytest.mark.parametrize("name", K.MODELS)
def test_every_model_beats_guessing(people, name):
    row = models.train_evaluate(people, "Purchased", name, FULL, ["id"]).metrics.first()
    assert row["accuracy"] > 0.6 and 0 < row["f1_score"] <= 1


@pytest.mark.parametrize("encoding", ["One-Hot Encoding", "Frequency Encoding"])
def test_other_encodings_train(people, encoding):
    config = PrepConfig("Median", encoding, "RobustScaler")
    result = models.train_evaluate(people, "Purchased", K.LOGISTIC, config, ["id"])
    assert result.metrics.first()["accuracy"] > 0.6
    assert models.importance_ranking(people.sparkSession, result.model).count() == 3


def test_tree_ignores_scaling(people):
    got = {r["experiment"]: r["accuracy"] for r in verify.scaling_impact(
        people, "Purchased", [K.TREE], ["No Scaling", "StandardScaler"], ["id"]).collect()}
    assert got["No Scaling"] == pytest.approx(got["StandardScaler"], abs=1e-9)


def test_predict_returns_class_values(people):
    df = people.withColumn("t", F.when(F.col("Purchased") == 1, "yes").otherwise("no")).drop("Purchased")
    fitted = models.train_evaluate(df, "t", K.TREE, FULL, ["id"]).model
    got = fitted.predict(df, ["id"])
    assert {r[0] for r in got.select("predicted_class").distinct().collect()} == {"yes", "no"}
    assert got.count() == 600


def test_label_codes_follow_number_order(people):
    df = people.withColumn("t", F.when(F.col("Purchased") == 1, 10).otherwise(9))
    assert models.check_target(df, "t") == [9, 10]


def test_custom_parameters(people):
    assert models.estimator(K.LOGISTIC, 100, 2, maxIter=7).getMaxIter() == 7
    assert models.estimator(K.LOGISTIC, 100, 2).getRegParam() == pytest.approx(0.01)
    assert models.estimator(K.TREE, 100, 2, maxDepth=3).getMaxDepth() == 3
    with pytest.raises(ValueError):
        models.estimator("Forest", 100, 2)
    result = models.train_evaluate(people, "Purchased", K.KNN, FULL, ["id"], k=1)
    assert result.model.model.k == 1 and models.importance(result.model) == []


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    row = metrics.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == 0.5 and row["f1_score"] == pytest.approx((2 * 2 / 3 + 0.5 + 0) / 4)


def test_kernel_svm_learns_a_circle(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, 2))
    inside = (x**2).sum(axis=1) < 1.2
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, inside)], "a double, b double, t int")
    scores = {}
    for kernel in ("linear", "rbf"):
        result = models.train_evaluate(df, "t", K.SVM, PrepConfig(), C=10.0, kernel=kernel, maxIter=50)
        scores[kernel] = result.metrics.first()["accuracy"]
    assert scores["rbf"] > 0.9 > scores["linear"] + 0.1
    assert models.importance(result.model) == []
    with pytest.raises(ValueError):
        models.train_evaluate(df, "t", K.TREE, PrepConfig(), kernel="rbf")


# --- nearest neighbours -----------------------------------------------------------------


def brute(train, labels, queries, k):
    out = []
    for q in queries:
        total = np.zeros(len(train))
        for j in range(train.shape[1]):
            total += (q[j] - train[:, j]) ** 2
        near = np.lexsort((labels, np.sqrt(total)))[:k]
        found, counts = np.unique(labels[near], return_counts=True)
        out.append(found[counts.argmax()])
    return out


@pytest.mark.parametrize("cells, points, queries", [(10_000, 20_000, 4_000), (40, 15, 9), (7, 3, 50)])
def test_knn_matches_brute_force(spark, monkeypatch, cells, points, queries):
    """Many tiny cells and blocks must give what one big search gives."""
    monkeypatch.setattr(knn, "POINTS_PER_CELL", cells)
    monkeypatch.setattr(knn, "BLOCK_POINTS", points)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", queries)
    rng = np.random.default_rng(11)
    train = np.vstack([rng.normal(size=(300, 3)), np.tile([0.25, 0.25, 0.25], (150, 1)),  # a third are copies
                       rng.integers(0, 3, (100, 3))]).astype(float)
    labels = rng.integers(0, 3, len(train)).astype(float)
    ask = np.vstack([rng.normal(size=(80, 3)), train[290:330], [[50.0, 50.0, 50.0]]])
    tdf = spark.createDataFrame(pd.DataFrame({"x": list(train), "y": labels}))
    qdf = spark.createDataFrame(pd.DataFrame({"qid": range(len(ask)), "x": list(ask)}))
    for k in (1, 5):
        model = knn.fit_knn(tdf, F.col("x"), F.col("y"), k)
        got = [r["prediction"] for r in model.vote(qdf).orderBy("qid").collect()]
        assert got == brute(train, labels, ask, k)


def test_knn_with_fewer_points_than_k(spark):
    tdf = spark.createDataFrame([([0.0], 1.0), ([5.0], 0.0)], "x array<double>, y double")
    qdf = spark.createDataFrame([(1, [1.0])], "qid long, x array<double>")
    votes = knn.fit_knn(tdf, F.col("x"), F.col("y"), 5).vote(qdf).first()
    assert votes["prediction"] == 0.0 and votes["votes"] == {0.0: 1, 1.0: 1}


@pytest.mark.parametrize("form", ["text", "number", "far"])
def test_knn_with_a_class_per_customer(spark, monkeypatch, form):
    """Hundreds of classes that are never listed: predictions as by brute force, class values back."""
    from featloom.operators import encode
    rng = np.random.default_rng(3)
    x, t = rng.normal(size=1500), rng.integers(0, 400, 1500)
    t[::3] = 5
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1500), "x": x, "t": t}))
    if form != "number":
        df = df.withColumn("t", F.format_string("c%03d", F.col("t").cast("int")))
    if form == "far":
        monkeypatch.setattr(models, "fit_levels", lambda d, c: encode.fit_levels(d, c, small_limit=0))
    monkeypatch.setattr(models, "few_values", lambda *a: pytest.fail("classes were listed"))
    result = models.train_evaluate(df, "t", K.KNN, PrepConfig(), ["id"], features=["x"])
    assert isinstance(result.model.classes, models.ClassDictionary)
    got = {r["id"]: r["predicted_class"] for r in result.model.predict(df, ["id"]).collect()}
    side = {r["id"]: r["is_test"] for r in sampling.mark_test(df, ["id"]).collect()}
    learnt = np.array([not side[i] for i in range(1500)])
    expected = brute(x[learnt][:, None], t[learnt].astype(float), x[:, None], 5)
    name = (lambda c: int(c)) if form == "number" else (lambda c: f"c{int(c):03d}")
    assert got == {i: name(c) for i, c in enumerate(expected)}
    right = np.mean([e == c for e, c, inside in zip(expected, t, learnt) if not inside])
    assert result.metrics.first()["accuracy"] == pytest.approx(right)
    with pytest.raises(ValueError, match="listed"):
        models.fit_model(df, K.TREE, "t", result.model.classes, ["x"])


# --- verification ------------------------------------------------------------------------


def test_ablation(people):
    got = verify.ablation(people, "Purchased", K.LOGISTIC, FULL, ["id"]).collect()
    assert len(got) == 7 and [r["rank"] for r in got] == list(range(1, 8))
    drops = [r["drop"] for r in got]
    assert drops == sorted(drops, reverse=True) and all(r["error"] is None for r in got)
    assert {got[0]["feature"], got[1]["feature"]} <= {"Age", "Income"}
    asked = verify.ablation(people, "Purchased", K.TREE, FULL, ["id"], features=["City"])
    assert [r["feature"] for r in asked.collect()] == ["City"]


def test_ablation_leaves_out_every_column(spark):
    """The one column that matters comes last of ten."""
    rows = [(i, *[(i * (7 + j)) % 11 for j in range(9)], i % 2, "yes" if i % 2 else "no") for i in range(200)]
    names = ["id", *[f"f{j}" for j in range(9)], "last", "label"]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'label' else 'int'}" for n in names))
    ablated = verify.ablation(frame, "label", K.TREE, FULL, ["id"])
    got = ablated.collect()
    assert len(got) == 10 and got[0]["feature"] == "last" and got[0]["drop"] > 0.1
    assert "last" in verify.verification_summary(ablated).first()["summary"]
    assert verify.ablation(frame, "label", K.TREE, FULL, ["id"], max_features=2).count() == 2


def test_verification_summary(spark):
    rows = [(1, "a", 0.2), (2, "b", 0.05), (3, "c", -0.1)]
    df = spark.createDataFrame(rows, "rank int, feature string, drop double")
    assert verify.verification_summary(df).first()[0] == "Key features: a, b (+20.0%, +5.0%)"
    flat = spark.createDataFrame([("b", "flat")], "feature string, response_type string")
    assert verify.verification_summary(df, flat).first()[0].endswith(" | b has flat response")
    none = verify.verification_summary(df.where("rank = 3"), flat).first()[0]
    assert none == "No single feature dominates accuracy."


def test_sensitivity(people):
    fitted = models.train_evaluate(people, "Purchased", K.LOGISTIC, FULL, ["id"]).model
    curve, summary = verify.sensitivity(people, fitted, ["Age", "City"])
    assert curve.count() == 40
    age = [r["prediction"] for r in curve.where("feature = 'Age'").orderBy("step").collect()]
    assert age == sorted(age) and age[-1] - age[0] > 0.2
    kinds = {r["feature"]: r for r in summary.collect()}
    assert kinds["Age"]["response_type"] in ("smooth", "noisy") and kinds["Age"]["response_strength"] == "good"
    with pytest.raises(ValueError):
        verify.sensitivity(people, fitted, ["Nope"])


def test_sensitivity_finds_one_hot_children(people):
    config = PrepConfig("Mean", "One-Hot Encoding", "StandardScaler")
    fitted = models.train_evaluate(people, "Purchased", K.TREE, config, ["id"]).model
    children = [c for c in fitted.features if c.startswith("City_")]
    assert verify.resolve_feature("City", fitted.features) == children[0]
    curve = verify.sensitivity(people, fitted, ["City"])[0]
    assert {r[0] for r in curve.select("feature").distinct().collect()} == set(children)
    assert curve.count() == 20 * len(children)


VECTOR, COLUMNS = (PrepConfig("Mean", "One-Hot Encoding", "StandardScaler", one_hot=f) for f in ("vector", "columns"))


def test_vector_and_columns_give_the_same(people):
    """Same folds, names, importances and curves, whichever form the one-hot slots have."""
    rows = people.withColumn("City", F.when(F.col("id") % 17 == 0, "nan").when(F.col("id") % 13 > 0, F.col("City")))
    seen = {}
    for config in (VECTOR, COLUMNS):
        result = models.train_evaluate(rows, "Purchased", K.LOGISTIC, config, ["id"])
        curve, summary = verify.sensitivity(rows, result.model, ["City", "Age"])
        seen[config.one_hot] = (
            result.metrics.first()["accuracy"], dict(models.importance(result.model)),
            {(r["feature"], r["step"]): (r["value"], r["prediction"]) for r in curve.collect()},
            {r["feature"]: r["response_type"] for r in summary.collect()})
    for a, b in zip(*seen.values()):
        if not isinstance(a, dict):
            assert a == b
            continue
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == b[k] if isinstance(a[k], str) else a[k] == pytest.approx(b[k], abs=2e-3), k
    names = seen["vector"][1]
    assert {"City_nan", "City_nan_missing"} <= set(names)
    again = models.train_evaluate(rows, "Purchased", K.LOGISTIC, VECTOR, ["id"]).model
    assert [s.name for s in again.find_slots("City_nan")] == ["City_nan"]
    assert again.find_slots("City_nowhere") == []


@pytest.mark.parametrize("name", [K.KNN, K.TREE])
def test_responses_in_both_forms(people, name):
    got = [sorted(map(tuple, verify.model_response(people, "Purchased", "City", c, ["id"], models=[name], points=3).collect())) for c in (VECTOR, COLUMNS)]
    assert len(got[0]) == len(got[1]) > 3
    for a, b in zip(*got):
        assert a[:3] == b[:3] and a[3:5] == pytest.approx(b[3:5]) and a[5] is None


def test_thousands_of_levels(spark):
    """1,500 levels: names, ranking and curves as for a few; the level that decides comes first."""
    df = spark.range(6_000).selectExpr(
        "id", "concat('l', case when id % 3 = 0 then 7 else id % 1500 end) as level", "cast(id % 11 as double) as x",
        "case when id % 3 = 0 or id % 97 = 1 then 1 else 0 end as t")
    fitted = models.train_evaluate(df, "t", K.TREE, VECTOR, ["id"], maxDepth=3).model
    top = models.importance_ranking(spark, fitted, 2).collect()
    assert top[0]["feature"] == "level_l7" and top[0]["importance"] > 0.9
    curve, summary = verify.sensitivity(df, fitted, ["level_l7", "x"], points=5)
    values = [r["prediction"] for r in curve.where("feature = 'level_l7'").orderBy("step").collect()]
    assert values[-1] - values[0] > 0.5
    assert verify.sensitivity(df, fitted, ["level"], points=2)[0].count() == 2 * fitted.prep.slot_scales["level_vec"].slots.size


def test_levels_that_are_not_fetched(spark, monkeypatch):
    """With level tables left in Spark, names are looked up one by one."""
    from featloom.operators import encode, preprocess
    df = spark.range(400).selectExpr("id", "case when id % 5 = 0 then null when id % 7 = 0 then 'nan' else concat('l', id % 4) end as level",
                                     "case when id % 5 = 0 then 1 else 0 end as t")
    near = models.train_evaluate(df, "t", K.TREE, VECTOR, ["id"], maxDepth=3).model
    monkeypatch.setattr(preprocess, "fit_levels", lambda d, c: encode.fit_levels(d, c, small_limit=0))
    far = models.train_evaluate(df, "t", K.TREE, VECTOR, ["id"], maxDepth=3).model
    assert far.prep.slot_scales["level_vec"].slots.names is None
    assert models.importance(far) == models.importance(near)
    assert [s.name for s in far.find_slots("level")] == [s.name for s in near.find_slots("level")]
    assert far.find_slots("level_l2") == near.find_slots("level_l2") != []
    with pytest.raises(ValueError, match="vector"):
        models.train_evaluate(df, "t", K.TREE, COLUMNS, ["id"])


def test_model_response(people):
    got = verify.model_response(people, "Purchased", "Income", FULL, ["id"])
    assert got.count() == 75 and got.where("prediction not between 0 and 1").count() == 0
    assert {r[0] for r in got.select("model").distinct().collect()} == {K.LOGISTIC, K.KNN, K.TREE}


def test_svm_with_three_classes(people):
    df = people.withColumn("t", F.when(F.col("Age") < 30, 0).when(F.col("Age") < 40, 1).otherwise(2)).drop("Purchased")
    result = models.train_evaluate(df, "t", K.SVM, FULL, ["id"], maxIter=5)
    assert result.metrics.first()["accuracy"] > 0.4
    assert len(models.importance(result.model)) == len(result.model.features)


def test_model_response_goes_on_when_one_model_fails(people):
    got = verify.model_response(people, "Purchased", "Income", FULL, ["id"], models=["No Such Model", K.TREE], points=3).collect()
    failed = [r for r in got if r["model"] == "No Such Model"]
    assert len(failed) == 1 and failed[0]["prediction"] is None and "unknown model" in failed[0]["error"]
    assert len([r for r in got if r["error"] is None]) == 3


def test_sensitivity_names_unknown_features(people):
    trained = models.train_evaluate(people, "Purchased", K.TREE, FULL, ["id"]).model
    with pytest.raises(ValueError, match="no_such"):
        verify.sensitivity(people, trained, ["Income", "no_such"])


@pytest.mark.parametrize("cells, points, queries", [(10_000, 20_000, 4_000), (2, 3, 9)])
def test_one_hot_neighbours_stay_sparse(spark, monkeypatch, cells, points, queries):
    """Two one-hot features and two numbers, levels seen and unseen; no array of all slots is made."""
    monkeypatch.setattr(knn, "POINTS_PER_CELL", cells)
    monkeypatch.setattr(knn, "BLOCK_POINTS", points)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", queries)
    rng = np.random.default_rng(5)
    n = 260
    rows = pd.DataFrame({"id": range(n), "a": rng.normal(size=n).round(1), "g": [f"g{i}" for i in rng.integers(0, 9, n)],
                         "b": rng.integers(0, 3, n).astype(float), "h": [f"h{i}" for i in rng.integers(0, 40, n)], "t": rng.integers(0, 3, n)})
    df = spark.createDataFrame(rows)
    setup = models.prepare_experiment(df, "t", PrepConfig("Mean", "One-Hot Encoding", "StandardScaler", one_hot="vector"), ["id"])
    fitted = models.fit_model(setup.train, K.KNN, "t", setup.classes, setup.features, setup.prep)
    assert isinstance(fitted.model, knn.BoxModel) and len(fitted.model.plain) == 2
    assert {len(r["x"]) for r in fitted.model.points.select("x").collect()} == {2}  # was one number for each of some 50 slots
    train = np.array([(*r["features"].toArray(), r["label"]) for r in models.assemble(models.with_labels(setup.train, "t", setup.classes), setup.features, ["label"]).collect()])
    _, test = sampling.split(df, ["id"])
    ask = models.assemble(setup.prep.apply(test), setup.features, ["id"]).collect()
    want = brute(train[:, :-1], train[:, -1], np.array([r["features"].toArray() for r in ask]), 5)
    got = {r["id"]: r["prediction"] for r in fitted.score(setup.prep.apply(test), ["id"]).collect()}
    setup.release()
    assert [got[r["id"]] for r in ask] == want


def test_only_the_least_labels_of_equal_points_are_kept(spark):
    tdf = spark.range(0, 500).select(F.array(F.lit(1.0)).alias("x"), F.col("id").cast("double").alias("y"))
    model = knn.fit_knn(tdf, F.col("x"), F.col("y"), 3)
    assert sorted(r["label"] for r in model.points.collect()) == [0.0, 1.0, 2.0]
    got = model.vote(spark.createDataFrame([(1, [7.0])], "qid long, x array<double>")).first()
    assert got["prediction"] == 0.0 and got["votes"] == {0.0: 1, 1.0: 1, 2.0: 1}


def test_fourier_rows_are_not_stored_beside_the_blocks(people, monkeypatch):
    kept, persist = [], type(people).persist
    monkeypatch.setattr(type(people), "persist", lambda df, *a: kept.append(df.columns) or persist(df, *a))
    df = people.select("id", "Purchased", F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    result = models.train_evaluate(df, "Purchased", K.SVM, FULL, ["id"], kernel="rbf")
    assert kept and not any("features" in columns for columns in kept)
    x = models.assemble(result.model.prep.apply(df), ["x", "y"], ["id"]).limit(50)
    map_ = result.model.projection
    for a, b in zip(sorted(x.collect()), sorted(map_.apply(x).collect())):
        want = np.sqrt(2 / len(map_.offsets)) * np.cos(a["features"].toArray() @ map_.weights + map_.offsets)
        assert np.allclose(b["features"].toArray(), want, atol=1e-12)


def test_points_without_a_number_are_never_near(spark):
    tdf = spark.createDataFrame([([float(i), None if i == 3 else 0.0], float(i)) for i in range(9)], "x array<double>, y double")
    qdf = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, x array<double>")
    assert knn.fit_knn(tdf, F.col("x"), F.col("y"), 2).vote(qdf).count() == 0  # as before boxes
    few = tdf.where("y between 3 and 4")
    assert knn.fit_knn(few, F.col("x"), F.col("y"), 5).vote(qdf).first()["votes"] == {4.0: 1}
