"""Imputation, encoding, scaling, and the three in sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.operators import preprocess, sampling
from featloom.operators.preprocess import PrepConfig, fit_prep
from featloom.plans.registry import GAPPY_NUMERIC, GAPPY_SQL, gappy, query, sql_uniform, table

KEYS = ["l_orderkey", "l_linenumber"]


def _impute_sql(fill):
    columns = ", ".join(f"round(coalesce({c}, {fill(c)}), 6) AS {c}" for c in GAPPY_NUMERIC)
    return f"WITH {GAPPY_SQL} SELECT l_orderkey, l_linenumber, {columns} FROM g"


def _impute(spark, sf, strategy, constant=0):
    rows = gappy(spark, sf)
    imputer = preprocess.fit_imputer(rows, strategy, GAPPY_NUMERIC, constant)
    return imputer.apply(rows).select(*KEYS, *[F.round(c, 6).alias(c) for c in GAPPY_NUMERIC])


@query("impute_drop", f"WITH {GAPPY_SQL} SELECT l_orderkey, l_linenumber, qty, price, disc, tax FROM g "
                      "WHERE qty IS NOT NULL AND price IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL")
def impute_drop(spark, sf):
    return _impute(spark, sf, "Drop Rows")


@query("impute_mean", _impute_sql(lambda c: f"(SELECT avg({c}) FROM g)"))
def impute_mean(spark, sf):
    return _impute(spark, sf, "Mean")


@query("impute_median", _impute_sql(lambda c: f"(SELECT quantile_cont({c}, 0.5) FROM g)"))
def impute_median(spark, sf):
    return _impute(spark, sf, "Median")


@query("impute_mode", _impute_sql(
    lambda c: f"(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"))
def impute_mode(spark, sf):
    return _impute(spark, sf, "Most Frequent")


@query("impute_const", _impute_sql(lambda c: "-1"))
def impute_const(spark, sf):
    return _impute(spark, sf, "Constant", -1)



CODES = ("codes_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code "
         "FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM {rel}))")


@query("encode_label", f"""
WITH {GAPPY_SQL}, {CODES.format(c='flag', rel='g')}, {CODES.format(c='status', rel='g')}
SELECT l_orderkey, l_linenumber, f.code AS flag, s.code AS status
FROM g JOIN codes_flag f ON f.v = coalesce(g.flag, 'nan') JOIN codes_status s ON s.v = coalesce(g.status, 'nan')""")
def encode_label(spark, sf):
    rows = gappy(spark, sf).select(*KEYS, "flag", "status")
    return preprocess.fit_encoder(rows, "Label Encoding", ["flag", "status"]).apply(rows)


@query("encode_label_many_levels", f"""
WITH {CODES.format(c='c_name', rel='customer')}
SELECT c_custkey, f.code AS c_name FROM customer c JOIN codes_c_name f ON f.v = c.c_name""")
def encode_label_many_levels(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    return preprocess.fit_encoder(rows, "Label Encoding", ["c_name"]).apply(rows)


@query("encode_freq", f"""
WITH {GAPPY_SQL}, f AS (SELECT flag, count(*) / CAST((SELECT count(flag) FROM g) AS DOUBLE) AS share FROM g GROUP BY 1),
s AS (SELECT status, count(*) / CAST((SELECT count(status) FROM g) AS DOUBLE) AS share FROM g GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(coalesce(f.share, 0), 6) AS flag, round(coalesce(s.share, 0), 6) AS status
FROM g LEFT JOIN f ON g.flag = f.flag LEFT JOIN s ON g.status = s.status""")
def encode_freq(spark, sf):
    rows = gappy(spark, sf).select(*KEYS, "flag", "status")
    coded = preprocess.fit_encoder(rows, "Frequency Encoding", ["flag", "status"]).apply(rows)
    return coded.select(*KEYS, F.round("flag", 6).alias("flag"), F.round("status", 6).alias("status"))


def _indicator(c, level, name=None):
    test = f"{c} IS NULL" if level is None else f"{c} IS NOT DISTINCT FROM '{level}'"
    return f"CAST(CASE WHEN {test} THEN 1 ELSE 0 END AS DOUBLE) AS \"{name or f'{c}_{level}'}\""


@query("encode_onehot", f"""
WITH {GAPPY_SQL} SELECT l_orderkey, l_linenumber, {_indicator('flag', 'A')}, {_indicator('flag', 'N')},
  {_indicator('flag', 'R')}, {_indicator('flag', None, 'flag_nan')}, {_indicator('status', 'F')},
  {_indicator('status', 'O')} FROM g""")
def encode_onehot(spark, sf):
    rows = gappy(spark, sf).select(*KEYS, "flag", "status")
    return preprocess.fit_encoder(rows, "One-Hot Encoding", ["flag", "status"]).apply(rows)


def _scale_sql(shift, width):
    columns = ", ".join(
        f"round(({c} - (SELECT {shift.format(c=c)} FROM g)) / "
        f"(SELECT coalesce(nullif({width.format(c=c)}, 0), 1) FROM g), 6) AS {c}" for c in GAPPY_NUMERIC)
    return f"WITH {GAPPY_SQL} SELECT l_orderkey, l_linenumber, {columns} FROM g"


def _scale(spark, sf, strategy):
    rows = gappy(spark, sf)
    scaler = preprocess.fit_scaler(rows, strategy, GAPPY_NUMERIC)
    return scaler.apply(rows).select(*KEYS, *[(F.round(c, 6) + 0.0).alias(c) for c in GAPPY_NUMERIC])


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf):
    return _scale(spark, sf, "StandardScaler")


@query("scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, sf):
    return _scale(spark, sf, "MinMaxScaler")


@query("scale_robust", _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(spark, sf):
    return _scale(spark, sf, "RobustScaler")


# --- in sequence, fitted on the training side only -----------------------------------

ORDER_COLUMNS = """o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
  CAST(o_custkey AS DOUBLE) AS cust,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS prio, o_orderstatus AS status"""
ORDERS_SQL = (f"o AS (SELECT {ORDER_COLUMNS} FROM orders), "
              f"tr AS (SELECT * FROM o WHERE NOT ({sql_uniform('o_orderkey')} < 0.2))")


def _prepared(spark, sf, config):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.col("o_custkey").cast("double").alias("cust"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("prio"),
        F.col("o_orderstatus").alias("status"),
    )
    train, _ = sampling.split(orders, ["o_orderkey"])
    prep = fit_prep(train, "status", config, ["price", "cust", "prio"])
    done = prep.apply(orders)
    return done.select("o_orderkey", "status", *[(F.round(f"`{c}`", 6) + 0.0).alias(c) for c in prep.features])


@query("preprocess_full", f"""
WITH {ORDERS_SQL}, {CODES.format(c='prio', rel='tr')},
f AS (SELECT o_orderkey, status, coalesce(price, (SELECT avg(price) FROM tr)) AS price, cust,
        CAST(code AS DOUBLE) AS prio, {sql_uniform('o_orderkey')} < 0.2 AS test
      FROM o JOIN codes_prio ON v = coalesce(prio, 'nan')),
t AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(cust) AS mc, stddev_pop(cust) AS sc,
        avg(prio) AS mo, stddev_pop(prio) AS so FROM f WHERE NOT test)
SELECT o_orderkey, status, round((price - mp) / sp, 6) + 0.0 AS price, round((cust - mc) / sc, 6) + 0.0 AS cust,
  round((prio - mo) / so, 6) + 0.0 AS prio FROM f, t""")
def preprocess_full(spark, sf):
    return _prepared(spark, sf, PrepConfig("Mean", "Label Encoding", "StandardScaler"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("preprocess_onehot_minmax", f"""
WITH {ORDERS_SQL}, f AS (SELECT o_orderkey, status, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM tr)) AS price,
  cust, prio, {sql_uniform('o_orderkey')} < 0.2 AS test FROM o),
t AS (SELECT min(price) AS lp, max(price) AS hp, min(cust) AS lc, max(cust) AS hc FROM f WHERE NOT test)
SELECT o_orderkey, status, round((price - lp) / (hp - lp), 6) + 0.0 AS price, round((cust - lc) / (hc - lc), 6) + 0.0 AS cust,
  {', '.join(_indicator('prio', p) for p in PRIORITIES)}, {_indicator('prio', None, 'prio_nan')} FROM f, t""")
def preprocess_onehot_minmax(spark, sf):
    return _prepared(spark, sf, PrepConfig("Median", "One-Hot Encoding", "MinMaxScaler"))


@query("preprocess_freq_robust", f"""
WITH {ORDERS_SQL}, h AS (SELECT prio AS v, count(*) / CAST((SELECT count(prio) FROM tr WHERE price IS NOT NULL) AS DOUBLE) AS share
  FROM tr WHERE price IS NOT NULL GROUP BY 1),
f AS (SELECT o_orderkey, status, price, cust, coalesce(share, 0) AS prio, {sql_uniform('o_orderkey')} < 0.2 AS test
  FROM o LEFT JOIN h ON v = prio WHERE price IS NOT NULL),
t AS (SELECT quantile_cont(price, 0.5) AS mp, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS wp,
  quantile_cont(cust, 0.5) AS mc, quantile_cont(cust, 0.75) - quantile_cont(cust, 0.25) AS wc,
  quantile_cont(prio, 0.5) AS mo, coalesce(nullif(quantile_cont(prio, 0.75) - quantile_cont(prio, 0.25), 0), 1) AS wo
  FROM f WHERE NOT test)
SELECT o_orderkey, status, round((price - mp) / wp, 6) + 0.0 AS price, round((cust - mc) / wc, 6) + 0.0 AS cust,
  round((prio - mo) / wo, 6) + 0.0 AS prio FROM f, t""")
def preprocess_freq_robust(spark, sf):
    return _prepared(spark, sf, PrepConfig("Drop Rows", "Frequency Encoding", "RobustScaler"))
