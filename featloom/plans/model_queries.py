"""Model training and verification. Fits differ between engines, so only the
nearest-neighbour votes and the split sizes have a SQL twin."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featloom import constants as K
from featloom.operators import models, sampling, verify
from featloom.operators.knn import fit_knn
from featloom.operators.preprocess import PrepConfig
from featloom.plans.registry import query, sql_uniform, table

FULL = PrepConfig("Mean", "Label Encoding", "StandardScaler")


def _orders(spark, sf):
    """Orders with a target that depends on the price, and gaps in the price."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 7 != 0, price).alias("price"),
        F.col("o_custkey").cast("double").alias("cust"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("prio"),
        "o_orderstatus",
        F.when(price + (key % 101) * 1500.0 > 330000, "large").otherwise("small").alias("size"),
    )


def _trained(spark, sf, name, target="size", config=FULL, **params):
    return models.train_evaluate(
        _orders(spark, sf), target, name, config, ["o_orderkey"],
        features=["price", "cust", "prio"], **params,
    )


def _scores(result):
    return result.metrics.select("model", F.round("accuracy", 4).alias("accuracy"), F.round("f1_score", 4).alias("f1_score"))


@query("model_logreg", tested_by="tests/test_models.py::test_every_model_beats_guessing")
def model_logreg(spark, sf):
    return _scores(_trained(spark, sf, K.LOGISTIC))


@query("model_tree", tested_by="tests/test_models.py::test_every_model_beats_guessing")
def model_tree(spark, sf):
    return _scores(_trained(spark, sf, K.TREE))


@query("model_svm", tested_by="tests/test_models.py::test_every_model_beats_guessing")
def model_svm(spark, sf):
    return _scores(_trained(spark, sf, K.SVM))


@query("model_svm_rbf", tested_by="tests/test_models.py::test_kernel_svm_learns_a_circle")
def model_svm_rbf(spark, sf):
    return _scores(_trained(spark, sf, K.SVM, kernel="rbf"))


@query("train_evaluate", tested_by="tests/test_models.py::test_other_encodings_train")
def train_evaluate(spark, sf):
    """Three classes, one-hot features."""
    config = PrepConfig("Median", "One-Hot Encoding", "MinMaxScaler")
    return _scores(_trained(spark, sf, K.LOGISTIC, "o_orderstatus", config))


def _customer_points(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment",
        F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("x"),
    )


@query("model_knn", f"""
WITH c AS (SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment, {sql_uniform('c_custkey')} < 0.2 AS test FROM customer),
d AS (SELECT q.c_custkey AS qid, t.c_mktsegment AS label,
  sqrt((q.c_acctbal - t.c_acctbal) * (q.c_acctbal - t.c_acctbal)
       + CAST(q.c_nationkey - t.c_nationkey AS DOUBLE) * CAST(q.c_nationkey - t.c_nationkey AS DOUBLE)) AS dist
  FROM c q JOIN c t ON q.test AND NOT t.test),
n AS (SELECT qid, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, label) AS rn FROM d) WHERE rn <= 5),
v AS (SELECT qid, label, count(*) AS votes FROM n GROUP BY 1, 2)
SELECT qid AS c_custkey, label AS predicted_class, votes FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS rn FROM v) WHERE rn = 1""")
def model_knn(spark, sf):
    customers = _customer_points(spark, sf)
    train, test = sampling.split(customers, ["c_custkey"])
    classes = models.check_target(customers, "c_mktsegment")
    model = fit_knn(train.withColumn("label", models.label_column("c_mktsegment", classes)), F.col("x"), F.col("label"))
    votes = model.vote(test.select(F.col("c_custkey").alias("qid"), "x"))
    names = F.array(*[F.lit(c) for c in classes])
    return votes.select(
        F.col("qid").alias("c_custkey"),
        F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted_class"),
        F.element_at("votes", F.col("prediction")).alias("votes"),
    )


@query("knn_by_customer", f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS x, 'c' || o_custkey AS label, {sql_uniform('o_orderkey')} < 0.2 AS test FROM orders),
d AS (SELECT q.o_orderkey AS qid, t.label, abs(q.x - t.x) AS dist FROM o q JOIN o t ON q.test AND NOT t.test),
n AS (SELECT qid, label FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, label) <= 5),
v AS (SELECT qid, label, count(*) AS votes FROM n GROUP BY 1, 2)
SELECT qid AS o_orderkey, label AS predicted_class FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) = 1""")
def knn_by_customer(spark, sf):
    """Whose order is it, by its price? A class per customer, never listed."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"))
    fitted = models.train_evaluate(orders, "customer", K.KNN, PrepConfig(), ["o_orderkey"], features=["o_totalprice"]).model
    _, test = sampling.split(orders, ["o_orderkey"])
    return fitted.predict(test, ["o_orderkey"]).select("o_orderkey", "predicted_class")


@query("model_knn_embeddings", f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, {sql_uniform('vec_id')} < 0.2 AS test FROM embeddings),
d AS (SELECT q.vec_id AS qid, q.label AS truth, t.label AS label, list_distance(q.x, t.x) AS dist
  FROM e q JOIN e t ON q.test AND NOT t.test),
n AS (SELECT qid, truth, label FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, label) AS rn FROM d) WHERE rn <= 5),
v AS (SELECT qid, truth, label, count(*) AS votes FROM n GROUP BY ALL),
p AS (SELECT truth, label AS guess FROM
  (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) AS rn FROM v) WHERE rn = 1),
a AS (SELECT truth AS c, count(*) AS support, count(*) FILTER (truth = guess) AS tp FROM p GROUP BY 1),
b AS (SELECT guess AS g, count(*) AS called FROM p GROUP BY 1)
SELECT round(sum(tp) / CAST(sum(support) AS DOUBLE), 4) AS accuracy,
  round(sum(support * 2.0 * tp / (support + coalesce(called, 0))) / sum(support), 4) AS f1_score
FROM a LEFT JOIN b ON c = g""")
def model_knn_embeddings(spark, sf):
    """Accuracy of 5 nearest neighbours on the embedding vectors."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vec"))
    train, test = sampling.split(rows, ["vec_id"])
    classes = models.check_target(rows, "label")
    fitted = models.fit_model(train, K.KNN, "label", classes, ["vec"])
    found = models.evaluate(fitted, test)
    return found.select(F.round("accuracy", 4).alias("accuracy"), F.round("f1_score", 4).alias("f1_score"))


@query("importance_ranking", tested_by="tests/test_models.py::test_vector_and_columns_give_the_same")
def importance_ranking(spark, sf):
    fitted = _trained(spark, sf, K.TREE).model
    return models.importance_ranking(spark, fitted).withColumn("importance", F.round("importance", 4))


def _ablated(spark, sf):
    orders = _orders(spark, sf).drop("o_orderstatus")
    return verify.ablation(orders, "size", K.TREE, FULL, ["o_orderkey"])


@query("ablation", tested_by="tests/test_models.py::test_ablation_leaves_out_every_column")
def ablation(spark, sf):
    return _ablated(spark, sf)


@query("verification_summary", tested_by="tests/test_models.py::test_verification_summary")
def verification_summary(spark, sf):
    return verify.verification_summary(_ablated(spark, sf))


@query("sensitivity", tested_by="tests/test_models.py::test_vector_and_columns_give_the_same")
def sensitivity(spark, sf):
    fitted = _trained(spark, sf, K.LOGISTIC).model
    orders = _orders(spark, sf).drop("o_orderstatus")
    curve, _ = verify.sensitivity(orders, fitted, ["price", "cust"])
    return curve.withColumn("prediction", F.round("prediction", 4))


@query("sensitivity_summary", tested_by="tests/test_models.py::test_sensitivity")
def sensitivity_summary(spark, sf):
    fitted = _trained(spark, sf, K.LOGISTIC).model
    orders = _orders(spark, sf).drop("o_orderstatus")
    return verify.sensitivity(orders, fitted, ["price", "cust"])[1]


def _customers(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"),
        F.when(F.col("c_acctbal") + (F.col("c_custkey") % 7) * 500 > 6000, 1).otherwise(0).alias("rich"),
    )


# Up to 1,201 one-hot levels of a text column, missing and the text "nan" among them. Distances
# between one-hot rows are known from the level counts, so nearest neighbours have a twin.
_WIDE = PrepConfig("Mean", "One-Hot Encoding", "StandardScaler", one_hot="vector")
_WIDE_SQL = f"""
c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 1201 = 5 THEN NULL WHEN c_custkey % 1201 = 6 THEN 'nan'
          WHEN c_custkey % 4 = 0 THEN 'common' ELSE 'g' || (c_custkey % 1201) END AS grp,
          CASE WHEN c_acctbal + (c_custkey % 4) * 1500 > 6000 THEN 1 ELSE 0 END AS rich, {sql_uniform('c_custkey')} < 0.2 AS test FROM customer),
tr AS (SELECT * FROM c WHERE NOT test),
lev AS (SELECT grp, count(*) / CAST((SELECT count(*) FROM tr) AS DOUBLE) AS p FROM tr GROUP BY grp),
slot AS (SELECT grp, coalesce('grp_' || grp, 'grp_nan_missing') AS name, p, sqrt(p * (1 - p)) AS w FROM lev),
num AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM tr),
pts AS (SELECT (c_acctbal - m) / s AS x, tr.grp, rich, slot.w FROM tr JOIN slot ON tr.grp IS NOT DISTINCT FROM slot.grp, num)"""


def _wide_customers(spark, sf):
    key = F.col("c_custkey")
    group = F.when(key % 1201 == 5, None).when(key % 1201 == 6, "nan").when(key % 4 == 0, "common").otherwise(
        F.concat(F.lit("g"), (key % 1201).cast("string")))
    return table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", group.alias("grp"), F.when(F.col("c_acctbal") + (key % 4) * 1500 > 6000, 1).otherwise(0).alias("rich"))


@query("wide_predict", f"""
WITH {_WIDE_SQL},
ask AS (SELECT c_custkey, (c_acctbal - m) / s AS x, c.grp, slot.w FROM c LEFT JOIN slot ON c.grp IS NOT DISTINCT FROM slot.grp, num WHERE test),
d AS (SELECT c_custkey, rich, sqrt((a.x - b.x) * (a.x - b.x) + CASE WHEN a.grp IS NOT DISTINCT FROM b.grp THEN 0
        ELSE coalesce(1 / (a.w * a.w), 0) + 1 / (b.w * b.w) END) AS dist FROM ask a, pts b),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, rich) AS rn FROM d QUALIFY rn <= 5),
v AS (SELECT c_custkey, rich, count(*) AS k FROM n GROUP BY 1, 2)
SELECT c_custkey, rich AS predicted_class FROM v QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY k DESC, rich) = 1""")
def wide_predict(spark, sf):
    """Nearest neighbours over a scaled one-hot vector of many levels, seen and unseen ones."""
    rows = _wide_customers(spark, sf)
    fitted = models.train_evaluate(rows, "rich", K.KNN, _WIDE, ["c_custkey"]).model
    _, test = sampling.split(rows, ["c_custkey"])
    return fitted.predict(test, ["c_custkey"]).select("c_custkey", "predicted_class")


@query("wide_sensitivity", f"""
WITH {_WIDE_SQL},
rows_ AS (SELECT count(*) AS rows_ FROM c),
most AS (SELECT slot.name, count(*) AS k FROM c JOIN slot ON c.grp IS NOT DISTINCT FROM slot.grp GROUP BY 1),
base AS (SELECT median((c_acctbal - m) / s) AS x0 FROM c, num),
asked AS (SELECT slot.*, k > 0 AS seen, (0 - p) / w AS low, (1 - p) / w AS high FROM slot JOIN most USING (name)),
grid AS (SELECT name, grp, w, step, CASE WHEN step = 19 THEN high ELSE low + (high - low) / 19.0 * step END AS value
         FROM asked, range(0, 20) AS t(step)),
d AS (SELECT g.name, step, value, rich, sqrt((x0 - b.x) * (x0 - b.x) + CASE WHEN b.grp IS NOT DISTINCT FROM g.grp
        THEN power(step / 19.0 / g.w - 1 / g.w, 2) ELSE power(step / 19.0 / g.w, 2) + 1 / (b.w * b.w) END) AS dist
      FROM (SELECT * FROM grid WHERE name IN ('grp_common', 'grp_nan', 'grp_nan_missing', 'grp_g1', 'grp_g2')) g, base, pts b),
n AS (SELECT *, row_number() OVER (PARTITION BY name, step ORDER BY dist, rich) AS rn FROM d QUALIFY rn <= 5)
SELECT name AS feature, CAST(step AS INTEGER) AS step, round(any_value(value), 6) AS value, round(sum(rich) / 5.0, 4) AS prediction FROM n GROUP BY 1, 2""")
def wide_sensitivity(spark, sf):
    """Curves of single levels, found by their names, from the least to the largest value of their slots."""
    rows = _wide_customers(spark, sf)
    fitted = models.train_evaluate(rows, "rich", K.KNN, _WIDE, ["c_custkey"]).model
    asked = [n for n in ("grp_common", "grp_nan", "grp_nan_missing", "grp_g1", "grp_g2") if fitted.find_slots(n)]
    curve, _ = verify.sensitivity(rows, fitted, asked)
    return curve.select("feature", "step", F.round("value", 6).alias("value"), F.round("prediction", 4).alias("prediction"))


@query("wide_ranges", f"""
WITH {_WIDE_SQL}
SELECT name AS feature, round((0 - p) / w, 6) AS low, round((1 - p) / w, 6) AS high FROM slot""")
def wide_ranges(spark, sf):
    """Every child of a one-hot feature, with the range its scaled slot takes in the training rows."""
    rows = _wide_customers(spark, sf)
    setup = models.prepare_experiment(rows, "rich", _WIDE, ["c_custkey"])
    try:
        found = verify.slot_ranges(setup, "grp")
    finally:
        setup.release()
    return found.select("feature", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("model_response", tested_by="tests/test_models.py::test_responses_in_both_forms")
def model_response(spark, sf):
    return verify.model_response(_customers(spark, sf), "rich", "c_acctbal", FULL, ["c_custkey"])


@query("scaling_impact", tested_by="tests/test_models.py::test_tree_ignores_scaling")
def scaling_impact(spark, sf):
    return verify.scaling_impact(
        _customers(spark, sf), "rich", [K.LOGISTIC, K.KNN, K.TREE], ["No Scaling", "StandardScaler"], ["c_custkey"]
    )


# Two classes with a gap between them: every sound model finds the right class of every test row.
_GAP_ROWS = "c_acctbal < 3500 OR c_acctbal > 5500"
_GAP_SQL = f"""SELECT c_custkey, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS predicted_class
FROM customer WHERE ({_GAP_ROWS}) AND {sql_uniform('c_custkey')} < 0.2"""


def _gap_predictions(spark, sf, model):
    rows = table(spark, sf, "customer").where(_GAP_ROWS).select(
        "c_custkey", "c_acctbal", F.expr("CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END").alias("rich"))
    setup = models.prepare_experiment(rows, "rich", PrepConfig("Mean", "Label Encoding", "StandardScaler"), ["c_custkey"])
    try:
        fitted = models.fit_model(setup.train, model, "rich", setup.classes, setup.features, setup.prep)
    finally:
        setup.release()
    _, test = sampling.split(rows, ["c_custkey"])
    return fitted.predict(test, ["c_custkey"]).select("c_custkey", "predicted_class")


@query("gap_logreg", _GAP_SQL)
def gap_logreg(spark, sf):
    return _gap_predictions(spark, sf, K.LOGISTIC)


@query("gap_svm", _GAP_SQL)
def gap_svm(spark, sf):
    return _gap_predictions(spark, sf, K.SVM)


@query("gap_tree", _GAP_SQL)
def gap_tree(spark, sf):
    return _gap_predictions(spark, sf, K.TREE)


@query("tree_full_depth", """
WITH points AS (SELECT c_custkey, c_nationkey, floor(c_acctbal / 100) AS hundreds, c_mktsegment FROM customer),
counted AS (SELECT c_nationkey, hundreds, c_mktsegment, count(*) AS n FROM points GROUP BY ALL),
best AS (SELECT c_nationkey, hundreds, c_mktsegment AS predicted_class FROM counted
         QUALIFY row_number() OVER (PARTITION BY c_nationkey, hundreds ORDER BY n DESC, c_mktsegment) = 1)
SELECT c_custkey, predicted_class FROM points JOIN best USING (c_nationkey, hundreds)""")
def tree_full_depth(spark, sf):
    """A tree of full depth learns every customer's segment by heart, equal points by their most frequent one."""
    rows = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 100).alias("hundreds"), "c_mktsegment")
    classes = models.check_target(rows, "c_mktsegment")
    fitted = models.fit_model(rows, K.TREE, "c_mktsegment", classes, ["c_nationkey", "hundreds"], maxDepth=None)
    return fitted.predict(rows, ["c_custkey"]).select("c_custkey", "predicted_class")
