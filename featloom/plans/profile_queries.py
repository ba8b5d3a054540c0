"""Loading, sampling, schema profile, target type."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom import constants as K
from featloom.functions.columns import union_all
from featloom.operators import casting, derive, outliers, profile, sampling
from featloom.plans.registry import (
    GAPPY_SQL, gappy, query, sql_hash, sql_rows, sql_uniform, table,
)
from featloom.session import scratch_path
from featloom.sources import files, messy


@query("row_count", "SELECT count(*) AS total_rows FROM lineitem")
def row_count(spark, sf):
    return files.row_count(table(spark, sf, "lineitem"))


@query("load_metadata", """
SELECT count(*) AS total_rows, least(count(*), 5000) AS loaded_rows,
       CAST(6 AS BIGINT) AS columns, count(*) > 5000 AS is_sampled FROM orders""")
def load_metadata(spark, sf):
    orders = table(spark, sf, "orders")
    capped = files.cap_rows(orders, K.PLOT_SAMPLE_ROWS, ["o_orderkey"])
    return files.load_metadata(orders, capped).select(
        "total_rows", "loaded_rows", F.col("columns").cast("bigint").alias("columns"), "is_sampled"
    )


@query("csv_ingest", """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def csv_ingest(spark, sf):
    path = scratch_path(spark, "orders-csv")
    (
        table(spark, sf, "orders")
        .select(
            "o_orderkey", "o_custkey", "o_orderstatus",
            F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        )
        .write.option("header", True).option("nullValue", "NA").csv(path)
    )
    return files.read_csv(spark, path, multiline=False)


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, sf):
    return files.preview(table(spark, sf, "orders"), "o_orderkey")


def _u(salt):
    return sql_uniform("id", f"42:{salt}")


def _normal(salt):
    return f"(sqrt(-2.0 * ln(1.0 - {_u(salt + 'r')})) * cos(2.0 * pi() * {_u(salt + 'a')}))"


@query("gen_messy", f"""
WITH ids AS (SELECT o_orderkey AS id FROM orders),
v AS (SELECT id,
  CAST(trunc(35.0 + 10.0 * {_normal('age')}) AS BIGINT) AS Age,
  50000.0 + 15000.0 * {_normal('income')} AS Income,
  CAST(floor({_u('credit')} * 550) + 300 AS BIGINT) AS CreditScore,
  -5.0 * ln(1.0 - {_u('years')}) AS YearsEmployed,
  CASE WHEN {_u('education')} < 0.3 THEN 'High School' WHEN {_u('education')} < 0.7 THEN 'Bachelors'
       WHEN {_u('education')} < 0.9 THEN 'Masters' ELSE 'PhD' END AS Education,
  CASE WHEN {_u('city')} < 0.2 THEN 'New York' WHEN {_u('city')} < 0.4 THEN 'London'
       WHEN {_u('city')} < 0.6 THEN 'Paris' WHEN {_u('city')} < 0.8 THEN 'Tokyo' ELSE 'Mumbai' END AS City,
  CASE WHEN {_u('gender')} < 1.0/3 THEN 'Male' WHEN {_u('gender')} < 2.0/3 THEN 'Female'
       ELSE 'Non-Binary' END AS Gender,
  {_normal('noise')} AS noise,
  {_u('gap_income')} AS gi, {_u('gap_education')} AS ge
 FROM ids),
p AS (SELECT *, Income / 100000.0 + Age / 100.0 + 0.1 * noise AS score FROM v)
SELECT id, Age, round(CASE WHEN gi >= 0.1 THEN Income END, 3) AS Income, CreditScore,
  round(YearsEmployed, 6) AS YearsEmployed, CASE WHEN ge >= 0.05 THEN Education END AS Education,
  City, Gender, CAST(score > avg(score) OVER () AS INTEGER) AS Purchased
FROM p""")
def gen_messy(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    made = messy.messy_table(ids)
    return made.withColumns({"Income": F.round("Income", 3), "YearsEmployed": F.round("YearsEmployed", 6)})


@query("sample_random", f"""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
ORDER BY {sql_hash('o_orderkey')}, o_orderkey LIMIT 5000""")
def sample_random(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return sampling.sample_random(orders, K.PLOT_SAMPLE_ROWS, ["o_orderkey"])


_OUTCOME_TARGETS = {"l_returnflag": "l_returnflag", "l_partkey": "l_partkey", "constant": "1", "gaps": "CASE WHEN l_linenumber > 1 THEN l_linestatus END"}


@query("sample_outcome", "WITH t AS (SELECT (SELECT count(*) FROM lineitem) AS rows_) " + " UNION ALL ".join(
    f"""SELECT '{name}' AS target, CASE WHEN reason IS NULL THEN 'stratified' ELSE 'plain' END AS strategy, reason, CAST(500 AS BIGINT) AS rows FROM
(SELECT CASE WHEN count(*) > 20 THEN 'more than 20 classes' WHEN count(*) FILTER (v IS NULL) > 0 THEN 'missing values in the target'
  WHEN count(*) < 2 THEN 'fewer than 2 classes' WHEN min(k) <= 1 THEN 'a class of one row'
  WHEN count(*) > least(500, sum(k) - 500) THEN 'no room for every class on both sides' END AS reason
 FROM (SELECT {expression} AS v, count(*) AS k FROM lineitem GROUP BY 1))""" for name, expression in _OUTCOME_TARGETS.items()))
def sample_outcome(spark, sf):
    """How a stratified sample was drawn, for targets that allow one and targets that don't."""
    rows = table(spark, sf, "lineitem")
    found = [sampling.stratified_sample(rows.withColumn("v", F.expr(e)), 500, "v", ["l_orderkey", "l_linenumber"])[1].select(
        F.lit(name).alias("target"), "strategy", "reason", "rows") for name, e in _OUTCOME_TARGETS.items()]
    return union_all(found)


@query("sample_stratified", f"""
WITH n AS (SELECT o_orderpriority AS c, count(*) AS size, sum(count(*)) OVER () AS total FROM orders GROUP BY 1),
s AS (SELECT *, 5000.0 * size / total AS share FROM n),
q AS (SELECT c, CASE WHEN total <= 5000 THEN size ELSE
        floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, c)
                                 <= 5000 - sum(floor(share)) OVER () THEN 1 ELSE 0 END END AS quota FROM s),
r AS (SELECT o_orderkey, o_orderpriority, o_totalprice,
        row_number() OVER (PARTITION BY o_orderpriority ORDER BY {sql_hash('o_orderkey')}, o_orderkey) AS rn
      FROM orders)
SELECT o_orderkey, o_orderpriority, o_totalprice FROM r JOIN q ON o_orderpriority = c WHERE rn <= quota""")
def sample_stratified(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return sampling.plot_sample(orders, "o_orderpriority", ["o_orderkey"])


@query("split_counts", f"""
SELECT {sql_uniform('o_orderkey')} < 0.2 AS is_test, o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1, 2""")
def split_counts(spark, sf):
    marked = sampling.mark_test(table(spark, sf, "orders"), ["o_orderkey"])
    return marked.groupBy("is_test", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum")
    )


@query("column_types", sql_rows([
    f"SELECT '{c}' AS \"column\", '{k}' AS column_class, count({c}) AS present FROM lineitem"
    for c, k in [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
                 ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
                 ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "categorical"),
                 ("l_linestatus", "categorical"), ("l_shipdate", "other")]]))
def column_types(spark, sf):
    return profile.column_types(table(spark, sf, "lineitem")).drop("ordinal")


def _blank_customer(spark, sf):
    return table(spark, sf, "customer").withColumns(
        {
            "c_acctbal": F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")),
            "c_mktsegment": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")),
        }
    )


BLANK_CUSTOMER = """c AS (SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)"""


def _summary_row(i, c, kind):
    pct = f"100.0 * (count(*) - count({c})) / count(*)"
    unique = f"count(DISTINCT {c})" if kind == "categorical" else "CAST(NULL AS BIGINT)"
    high = f"count(DISTINCT {c}) > 50" if kind == "categorical" else "false"
    return f"""SELECT {i} AS ordinal, '{c}' AS "column", '{kind}' AS column_class,
      CASE WHEN {pct} > 0 THEN round({pct}, 1) END AS missing_pct,
      {unique} AS n_unique, {high} AS high_cardinality FROM c"""


@query("schema_summary", f"WITH {BLANK_CUSTOMER}\n" + sql_rows([
    _summary_row(i, c, k) for i, (c, k) in enumerate([
        ("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"),
        ("c_acctbal", "numeric"), ("c_mktsegment", "categorical")])]))
def schema_summary(spark, sf):
    return profile.schema_summary(_blank_customer(spark, sf))


@query("n_distinct", f"WITH {GAPPY_SQL}\n" + sql_rows([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM g" for c in ["qty", "disc", "flag", "status"]]))
def n_distinct(spark, sf):
    return profile.n_distinct(gappy(spark, sf), ["qty", "disc", "flag", "status"])


@query("missing_pct", f"WITH {GAPPY_SQL}\n" + sql_rows([
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct FROM g"
    for c in ["qty", "price", "disc", "tax", "flag", "status"]]))
def missing_pct(spark, sf):
    found = profile.missing_pct(gappy(spark, sf), ["qty", "price", "disc", "tax", "flag", "status"])
    return found.select("column", "n_rows", F.round("missing_pct", 4).alias("missing_pct"))


def _check_row(c, expected, actual, bad, error):
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v + "'"
    return (f"SELECT '{c}' AS \"column\", {text(expected)} AS expected, {text(actual)} AS actual, "
            f"{bad} AS unconvertible, {text(error)} AS error FROM part")


@query("validate_schema", sql_rows([
    _check_row("p_partkey", None, "bigint", "CAST(0 AS BIGINT)", None),
    _check_row("p_weight", None, None, "CAST(0 AS BIGINT)", "Missing column: p_weight"),
    _check_row("p_size", "double", "int", "count(*) FILTER (p_size IS NOT NULL AND TRY_CAST(p_size AS DOUBLE) IS NULL)",
               "Column p_size has type int, expected double"),
    _check_row("p_brand", "int", "string",
               "count(*) FILTER (p_brand IS NOT NULL AND TRY_CAST(p_brand AS INTEGER) IS NULL)",
               "Column p_brand has type string, expected int"),
    _check_row("p_retailprice", "double", "double", "CAST(0 AS BIGINT)", None)]
    ).replace("FROM part", "FROM part GROUP BY ()"))
def validate_schema(spark, sf):
    return casting.validate_schema(
        table(spark, sf, "part"), ["p_partkey", "p_weight"],
        {"p_size": "double", "p_brand": "int", "p_retailprice": "double"},
    )


@query("cast_types", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, CAST(p_size AS DOUBLE) AS p_size,
       CAST(substr(p_brand, 7) AS INTEGER) AS brand_no FROM part""")
def cast_types(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", "p_brand", "p_size", F.expr("substr(p_brand, 7)").alias("brand_no")
    )
    return casting.cast_types(
        part, {"p_partkey": "string", "p_brand": "int", "p_size": "double", "brand_no": "int", "absent": "int"}
    )


@query("drop_null_target", f"""
WITH {GAPPY_SQL} SELECT count(flag) AS kept, count(*) - count(flag) AS dropped FROM g""")
def drop_null_target(spark, sf):
    return profile.null_target_counts(gappy(spark, sf), "flag")


def _type_row(name, rel, c, frac):
    fractional = f"max(CASE WHEN {c} <> floor({c}) THEN 1 ELSE 0 END) = 1" if frac else "false"
    return f"""SELECT '{name}' AS target, CASE WHEN {fractional} THEN 'continuous'
        WHEN count(DISTINCT {c}) <= 2 THEN 'binary' ELSE 'multiclass' END AS target_kind,
      CASE WHEN {fractional} THEN 'regression' ELSE 'classification' END AS task_type,
      count(DISTINCT {c}) AS n_unique,
      CASE WHEN {fractional} THEN '' ELSE 'Logistic Regression,KNN,SVM,Decision Tree' END AS compatible_models,
      NOT ({fractional}) AND count(DISTINCT {c}) >= 2 AS is_valid_for_training FROM {rel}"""


TARGETS = [("flag", "lineitem", "l_returnflag", False), ("quantity", "lineitem", "l_quantity", True),
           ("discount", "lineitem", "l_discount", True), ("linenumber", "lineitem", "l_linenumber", False),
           ("toxic", "labels", "toxic", False)]


@query("target_type", sql_rows([_type_row(*t) for t in TARGETS]))
def target_type(spark, sf):
    result = None
    for name, rel, c, _ in TARGETS:
        info = profile.target_type(table(spark, sf, rel), c).select(
            F.lit(name).alias("target"), "target_kind", "task_type", "n_unique",
            F.array_join("compatible_models", ",").alias("compatible_models"), "is_valid_for_training",
        )
        result = info if result is None else result.unionByName(info)
    return result


@query("train_gate", f"""
WITH t AS ({sql_rows([_type_row(*t) for t in TARGETS])}),
m AS (SELECT unnest(['Logistic Regression', 'KNN', 'SVM', 'Decision Tree', 'Forest']) AS model),
x AS (SELECT target, model, CASE
  WHEN task_type = 'regression' THEN 'Skipped: Target is continuous (' || n_unique || ' unique values). ''' || model
       || ''' needs discrete class labels.'
  WHEN n_unique < 2 THEN 'Skipped: Target has only ' || n_unique || ' unique value(s). Cannot train on constant data.'
  WHEN model = 'Forest' THEN 'Skipped: ''Forest'' is not compatible with this target type.' END AS message
  FROM t, m)
SELECT target, model, message IS NULL AS is_compatible, message FROM x""")
def train_gate(spark, sf):
    result = None
    for name, rel, c, _ in TARGETS:
        info = profile.target_type(table(spark, sf, rel), c)
        gate = profile.training_gate(info, [*K.MODELS, "Forest"]).withColumn("target", F.lit(name))
        result = gate if result is None else result.unionByName(gate)
    return result


@query("outlier_clip", """
WITH b AS (SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM events)
SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value
FROM events, b""")
def outlier_clip(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return outliers.clip_outliers(events, ["value"]).withColumn("value", F.round("value", 6))


def _bounded(rel, c, t):
    return (f"SELECT * FROM {rel} WHERE {c} BETWEEN (SELECT avg({c}) - {t} * stddev_samp({c}) FROM {rel}) "
            f"AND (SELECT avg({c}) + {t} * stddev_samp({c}) FROM {rel})")


@query("outlier_remove", f"""
WITH {GAPPY_SQL}, a AS ({_bounded('g', 'price', 1.5)}), b AS ({_bounded('a', 'qty', 1.5)}),
c AS ({_bounded('b', 'disc', 1.5)})
SELECT l_orderkey, l_linenumber, qty, price, disc FROM c""")
def outlier_remove(spark, sf):
    rows = gappy(spark, sf).select("l_orderkey", "l_linenumber", "qty", "price", "disc")
    return outliers.remove_outliers(rows, ["price", "qty", "disc"], 1.5)


@query("outlier_remove_one_pass", f"""
WITH {GAPPY_SQL}, b AS (SELECT avg(price) AS mp, stddev_samp(price) AS sp, avg(qty) AS mq, stddev_samp(qty) AS sq FROM g)
SELECT l_orderkey, l_linenumber, qty, price FROM g, b
WHERE price BETWEEN mp - 1.5 * sp AND mp + 1.5 * sp AND qty BETWEEN mq - 1.5 * sq AND mq + 1.5 * sq""")
def outlier_remove_one_pass(spark, sf):
    rows = gappy(spark, sf).select("l_orderkey", "l_linenumber", "qty", "price")
    return outliers.remove_outliers(rows, ["price", "qty"], 1.5, sequential=False)


@query("interactions", f"""
WITH {GAPPY_SQL} SELECT l_orderkey, l_linenumber, round(qty * price, 3) AS qty_x_price,
  round(disc * tax, 6) AS disc_x_tax FROM g""")
def interactions(spark, sf):
    made = derive.interactions(gappy(spark, sf), [("qty", "price"), ("disc", "tax"), ("qty", "flag"), ("qty", "none")])
    return made.select("l_orderkey", "l_linenumber", F.round("qty_x_price", 3).alias("qty_x_price"),
                       F.round("disc_x_tax", 6).alias("disc_x_tax"))


@query("polynomials", f"""
WITH {GAPPY_SQL} SELECT l_orderkey, l_linenumber, round(pow(qty, 2), 4) AS "qty^2", round(pow(qty, 3), 4) AS "qty^3",
  round(pow(disc, 2), 6) AS "disc^2", round(pow(disc, 3), 6) AS "disc^3" FROM g""")
def polynomials(spark, sf):
    made = derive.polynomials(gappy(spark, sf), ["qty", "disc", "flag"], 3)
    new = [(c, 4 if c.startswith("qty") else 6) for c in ("qty^2", "qty^3", "disc^2", "disc^3")]
    return made.select("l_orderkey", "l_linenumber", *[F.round(f"`{c}`", d).alias(c) for c, d in new])


