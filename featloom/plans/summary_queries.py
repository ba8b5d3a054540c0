"""Chart tables: counts, histograms, boxes, missing patterns, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom import constants as K
from featloom.operators import metrics, outliers, summaries, verify
from featloom.plans.registry import GAPPY_NUMERIC, GAPPY_SQL, gappy, query, sql_hash, sql_rows, table


@query("target_value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def target_value_counts(spark, sf):
    kind, counts = summaries.target_distribution(table(spark, sf, "orders"), "o_orderpriority")
    assert kind == "counts"
    return counts


@query("target_top20", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def target_top20(spark, sf):
    return summaries.value_counts(table(spark, sf, "part"), "p_name", 20)


def _hist_sql(c, rel, bounds="", extra=""):
    bounds = bounds or f"(SELECT min({c}) AS lo, max({c}) AS hi FROM {rel})"
    return f"""SELECT '{c}' AS feature, bin, round(lo + bin * (hi - lo) / 30, 4) AS bin_low,
  round(lo + (bin + 1) * (hi - lo) / 30, 4) AS bin_high, count(*) AS n{extra}
FROM (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({c} - lo) / (hi - lo) * 30), 29) END AS INTEGER) AS bin,
        CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi
      FROM {rel}, {bounds} AS b WHERE {c} IS NOT NULL) GROUP BY bin, lo, hi"""


def _rounded(hist):
    return hist.withColumns({"bin_low": F.round("bin_low", 4), "bin_high": F.round("bin_high", 4)})


@query("target_hist", _hist_sql("l_extendedprice", "lineitem"))
def target_hist(spark, sf):
    kind, hist = summaries.target_distribution(table(spark, sf, "lineitem"), "l_extendedprice")
    assert kind == "histogram"
    return _rounded(hist.drop("mean"))


@query("target_mean", "SELECT round(avg(l_extendedprice), 4) AS mean FROM lineitem")
def target_mean(spark, sf):
    _, hist = summaries.target_distribution(table(spark, sf, "lineitem"), "l_extendedprice")
    return hist.select(F.round("mean", 4).alias("mean")).distinct()


@query("histograms", f"WITH {GAPPY_SQL}\n" + sql_rows([_hist_sql(c, "g") for c in GAPPY_NUMERIC]))
def histograms(spark, sf):
    rows = gappy(spark, sf).drop("l_orderkey", "l_linenumber")
    return _rounded(summaries.feature_histograms(rows, "flag", K.CHART_HISTOGRAMS))


@query("hist_shift", f"""WITH b AS (SELECT avg(value) - 3 * stddev_samp(value) AS lo3, avg(value) + 3 * stddev_samp(value) AS hi3 FROM events),
a AS (SELECT CASE WHEN value < lo3 THEN lo3 WHEN value > hi3 THEN hi3 ELSE value END AS value FROM events, b),
e AS (SELECT min(value) AS lo, max(value) AS hi FROM (SELECT value FROM events UNION ALL SELECT value FROM a))
{_hist_sql('value', 'events', 'e', ", 'before' AS stage")}
UNION ALL
{_hist_sql('value', 'a', 'e', ", 'after' AS stage")}""")
def hist_shift(spark, sf):
    before = table(spark, sf, "events").select("value")
    return _rounded(summaries.distribution_shift(before, outliers.clip_outliers(before, ["value"]), "value"))


def _box_sql(features, target, rel, classes):
    def one(f):
        return f"""SELECT '{f}' AS feature, q.class AS class, round(q1, 4) AS q1, round(median, 4) AS median,
  round(q3, 4) AS q3, count(*) AS n, round(min(x), 4) AS min, round(max(x), 4) AS max,
  round(min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
  round(max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (x NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT {target} AS class, CAST({f} AS DOUBLE) AS x FROM {rel} WHERE {f} IS NOT NULL) AS v
JOIN (SELECT {target} AS class, quantile_cont(CAST({f} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({f} AS DOUBLE), 0.5) AS median,
        quantile_cont(CAST({f} AS DOUBLE), 0.75) AS q3 FROM {rel} WHERE {f} IS NOT NULL GROUP BY 1) AS q ON q.class = v.class
WHERE q.class IN (SELECT c FROM {classes}) GROUP BY q.class, q1, median, q3"""
    return sql_rows([one(f) for f in features])


def _rounded_box(box):
    return box.withColumns({c: F.round(c, 4) for c in
                            ("q1", "median", "q3", "min", "max", "whisker_low", "whisker_high")})


@query("box_by_target", f"""WITH {GAPPY_SQL},
k AS (SELECT flag AS c FROM g WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, flag LIMIT 10)
{_box_sql(GAPPY_NUMERIC, 'flag', 'g', 'k')}""")
def box_by_target(spark, sf):
    rows = gappy(spark, sf).drop("l_orderkey", "l_linenumber")
    return _rounded_box(summaries.box_by_target(rows, "flag", K.CHART_VS_TARGET, K.BOX_CLASSES))


@query("box_by_customer", f"""WITH o AS (SELECT o_custkey, o_totalprice, CAST(o_orderkey % 97 AS DOUBLE) AS part FROM orders),
k AS (SELECT DISTINCT o_custkey AS c FROM o)
{_box_sql(['o_totalprice', 'part'], 'o_custkey', 'o', 'k')}""")
def box_by_customer(spark, sf):
    """A box for every customer: classes that grow with the table."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", (F.col("o_orderkey") % 97).cast("double").alias("part"))
    return _rounded_box(summaries.box_by_target(orders, "o_custkey"))


@query("box_separation", f"""WITH v AS (SELECT event_id, user_id, value, event_type FROM events),
k AS (SELECT DISTINCT event_type AS c FROM v ORDER BY c LIMIT 5)
{_box_sql(['event_id', 'user_id', 'value'], 'event_type', 'v', 'k')}""")
def box_separation(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    return _rounded_box(summaries.box_separation(rows, "event_type", K.CHART_SEPARATION, K.SEPARATION_CLASSES))


@query("feature_vs_target", f"""
WITH p AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS cust, o_totalprice FROM orders
           ORDER BY {sql_hash('o_orderkey')}, o_orderkey LIMIT 5000)
SELECT o_totalprice, 'o_orderkey' AS feature, CAST(o_orderkey AS DOUBLE) AS value FROM p
UNION ALL SELECT o_totalprice, 'cust', cust FROM p""")
def feature_vs_target(spark, sf):
    """Scatter points of two features against a numeric target."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("double").alias("cust"), "o_totalprice")
    kind, points = summaries.feature_vs_target(orders, "o_totalprice", ["o_orderkey"])
    assert kind == "scatter"
    return points


FLAG = "CASE WHEN {c} IS NULL THEN '1' ELSE '0' END"
PATTERN = " || ".join(FLAG.format(c=c) for c in ["qty", "price", "disc", "tax", "flag"])


@query("missing_patterns", f"""WITH {GAPPY_SQL} SELECT {PATTERN} AS pattern,
  CAST(length(replace({PATTERN}, '0', '')) AS INTEGER) AS n_missing, count(*) AS n FROM g GROUP BY 1, 2""")
def missing_patterns(spark, sf):
    return summaries.missing_patterns(gappy(spark, sf), ["qty", "price", "disc", "tax", "flag"])


@query("feature_space_bins", """
WITH b AS (SELECT min(l_quantity) AS lx, max(l_quantity) AS hx, min(l_extendedprice) AS ly, max(l_extendedprice) AS hy FROM lineitem)
SELECT CAST(least(floor((l_quantity - lx) / (hx - lx) * 30), 29) AS INTEGER) AS bin_x,
  CAST(least(floor((l_extendedprice - ly) / (hy - ly) * 30), 29) AS INTEGER) AS bin_y, l_returnflag AS class, count(*) AS n
FROM lineitem, b GROUP BY 1, 2, 3""")
def feature_space_bins(spark, sf):
    return summaries.feature_space(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")


@query("median_row", f"WITH {GAPPY_SQL}\n" + sql_rows([
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median FROM g" for c in GAPPY_NUMERIC]))
def median_row(spark, sf):
    found = verify.median_row(gappy(spark, sf), GAPPY_NUMERIC)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in found.items()], "feature string, median double")


def _bounds_sql(columns, rel):
    return sql_rows([
        f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.05) AS low, "
        f"quantile_cont({c}, 0.95) AS high, CAST(max({c}) AS DOUBLE) AS max FROM {rel}" for c in columns])


@query("grid_bounds", f"""WITH {GAPPY_SQL}, x AS ({_bounds_sql(GAPPY_NUMERIC, 'g')})
SELECT feature, round(min, 6) AS min, round(low, 6) AS low, round(high, 6) AS high, round(max, 6) AS max FROM x""")
def grid_bounds(spark, sf):
    found = verify.grid_bounds(gappy(spark, sf), GAPPY_NUMERIC)
    return found.withColumns({c: F.round(c, 6) for c in ("min", "low", "high", "max")})


GRID_SQL = "CASE WHEN step = {last} THEN {hi} ELSE {lo} + ({hi} - {lo}) / {last}.0 * step END"


@query("sweep_grid", f"""WITH {GAPPY_SQL}, x AS ({_bounds_sql(GAPPY_NUMERIC, 'g')}),
n AS (SELECT CAST(unnest(range(25)) AS INTEGER) AS step)
SELECT feature, step, round({GRID_SQL.format(last=24, lo='low', hi='high')}, 6) AS value FROM x, n""")
def sweep_grid(spark, sf):
    grid = verify.sweep_grid(verify.grid_bounds(gappy(spark, sf), GAPPY_NUMERIC), "low", "high", 25)
    return grid.withColumn("value", F.round("value", 6))


@query("sweep_noise", f"""WITH {GAPPY_SQL}, x AS ({_bounds_sql(GAPPY_NUMERIC, 'g')}),
n AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS step),
c AS (SELECT feature, step, 1 / (1 + exp(-10 * ({GRID_SQL.format(last=19, lo='min', hi='max')}))) AS p FROM x, n),
d AS (SELECT *, p - lag(p) OVER (PARTITION BY feature ORDER BY step) AS move FROM c),
s AS (SELECT feature, max(p) - min(p) AS value_range, stddev_pop(move) AS step_std FROM d GROUP BY 1)
SELECT feature, round(value_range, 6) AS value_range, round(step_std, 6) AS step_std,
  CASE WHEN value_range < 0.05 THEN 'flat' WHEN step_std > 0.1 THEN 'noisy' ELSE 'smooth' END AS response_type,
  CASE WHEN value_range > 0.2 THEN 'good' WHEN value_range > 0.05 THEN 'moderate' ELSE 'flat' END AS response_strength
FROM s""")
def sweep_noise(spark, sf):
    """Response types of a fixed logistic rule along each column's grid."""
    grid = verify.sweep_grid(verify.grid_bounds(gappy(spark, sf), GAPPY_NUMERIC), "min", "max", 20)
    curve = grid.withColumn("prediction", 1.0 / (1.0 + F.exp(-10.0 * F.col("value"))))
    found = verify.response_summary(curve, ["feature"])
    return found.withColumns({"value_range": F.round("value_range", 6), "step_std": F.round("step_std", 6)})


# --- metrics of a fixed prediction rule -------------------------------------------------

RULES = {"by_quantity": "CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END",
         "by_line": "CASE WHEN l_linenumber < 3 THEN 'A' ELSE 'N' END"}


def _predicted(spark, sf, rule):
    return table(spark, sf, "lineitem").select("l_returnflag", F.expr(RULES[rule]).alias("guess"))


@query("metrics_accuracy", f"""
SELECT round(avg(CASE WHEN l_returnflag = {RULES['by_quantity']} THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem""")
def metrics_accuracy(spark, sf):
    found = metrics.accuracy(_predicted(spark, sf, "by_quantity"), "l_returnflag", "guess")
    return found.select(F.round("accuracy", 6).alias("accuracy"))


def _metrics_sql(rule):
    return f"""SELECT sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy,
  sum(support * 2.0 * tp / (support + coalesce(predicted, 0))) / sum(support) AS f1_score
FROM (SELECT l_returnflag AS label, count(*) AS support, count(*) FILTER (l_returnflag = {RULES[rule]}) AS tp
      FROM lineitem GROUP BY 1) a
LEFT JOIN (SELECT {RULES[rule]} AS guess, count(*) AS predicted FROM lineitem GROUP BY 1) b ON label = guess"""


@query("metrics_weighted_f1", f"SELECT round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score FROM ({_metrics_sql('by_line')})")
def metrics_weighted_f1(spark, sf):
    found = metrics.classification_metrics(_predicted(spark, sf, "by_line"), "l_returnflag", "guess")
    return found.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1_score", 6).alias("f1_score"))


@query("perf_unpivot", sql_rows([
    f"""SELECT 'rule' AS model, '{rule}' AS experiment, '{m}' AS metric, round({m}, 6) AS score FROM ({_metrics_sql(rule)})"""
    for rule in RULES for m in ("accuracy", "f1_score")]))
def perf_unpivot(spark, sf):
    results = None
    for rule in RULES:
        row = metrics.classification_metrics(_predicted(spark, sf, rule), "l_returnflag", "guess").select(
            F.lit("rule").alias("model"), F.lit(rule).alias("experiment"), "accuracy", "f1_score")
        results = row if results is None else results.unionByName(row)
    return summaries.unpivot_metrics(results).withColumn("score", F.round("score", 6))
