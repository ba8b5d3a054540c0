"""The whole walk on the generated table, and the logistic optimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom import constants as K
from featloom.operators import models
from featloom.operators.preprocess import PrepConfig
from featloom.plans.study import Study
from featloom.sources.messy import messy_table

FULL = PrepConfig("Mean", "Label Encoding", "StandardScaler")


@pytest.fixture(scope="module")
def study(spark):
    rows = messy_table(spark.range(0, 400, 1, 4))
    rows = rows.withColumn("Purchased", F.when(F.col("id") % 50 > 0, F.col("Purchased")))
    return Study(rows, "Purchased", ["id"], FULL, plot_rows=300)


def test_overview(study):
    found = study.overview()
    assert tuple(found["target_rows"].first()) == (392, 8)
    assert found["target"].first()["target_kind"] == "binary"
    assert found["gate"].where("is_compatible").count() == 4
    assert found["schema"].count() == 9


def test_report_and_selection(study):
    report = study.report()
    assert report.count() == 7 * 4
    strong = {r["feature"] for r in report.where("signal <> 'Low' and model = 'KNN'").collect()}
    assert {"Age", "Income"} <= strong
    selection = study.selection()
    assert [r["feature"] for r in selection["corr_to_target"].collect()[:2]] in (["Age", "Income"], ["Income", "Age"])
    dominant = [r["feature"] for r in selection["scale_ranges"].where("is_dominant").collect()]
    assert dominant == ["Income"]
    assert selection["guidance"].where("model = 'KNN'").first()["guidance"] == "Scale Income."


def test_charts(study):
    found = study.charts()
    assert {"target_counts", "missing_patterns", "histograms", "separation"} == set(found)
    assert found["separation"].select("feature").distinct().count() == 4


def test_train_verify_compare(study):
    result = study.train(K.LOGISTIC)
    found = study.verify(result, max_features=3)
    assert found["ablation"].count() == 3 and found["curves"].count() == 80
    assert found["summary"].first()["summary"].startswith(("Key features", "No single feature"))
    assert study.compare("Income").count() == 75


def test_logistic_regression_minimises_the_penalised_loss(spark):
    """Gradient of ½|w|² + C·Σ loss is zero at the fitted weights, C = 1."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) * [1, 5, 0.2]
    y = (x @ [1.0, -0.3, 2.0] + rng.normal(size=500) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, t int")
    fitted = models.fit_model(df, K.LOGISTIC, "t", [0, 1], ["a", "b", "c"], tol=1e-10)
    w, b = fitted.model.coefficients.toArray(), fitted.model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + x.T @ (p - y)).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_awkward_column_names(spark):
    """Dots, carets, spaces and quotes in names go through every step."""
    rows = spark.range(0, 300, 1, 4).selectExpr(
        "id as `row.id`", "cast(id % 17 as double) as `a.b`", "cast(id % 5 as double) as `c^2`",
        "case when id % 3 = 0 then 'x y' else 'z' end as `d e`", "cast(id % 17 > 8 as int) as `t.t`")
    walk = Study(rows, "t.t", ["row.id"], FULL)
    assert walk.report().count() == 12
    assert walk.overview()["schema"].count() == 5
    assert all(df.count() >= 0 for part in (walk.charts(), walk.selection()) for df in part.values())
    for config in (FULL, PrepConfig("Median", "One-Hot Encoding", "RobustScaler")):
        walk.config = config
        result = walk.train(K.TREE)
        assert result.metrics.first()["accuracy"] == 1.0
        assert walk.verify(result)["ablation"].first()["feature"] == "a.b"


def test_training_without_keys_splits_by_whole_row(spark):
    rows = spark.range(0, 500, 1, 4).selectExpr("cast(id as double) as x", "cast(id % 2 as boolean) as t")
    result = models.train_evaluate(rows, "t", K.TREE, FULL)
    assert result.model.classes == [False, True]
    assert result.model.predict(rows).select("predicted_class").dtypes == [("predicted_class", "boolean")]
    with pytest.raises(ValueError, match="neither numbers"):
        models.check_target(rows.select(F.expr("timestamp_seconds(x) as t")), "t")
