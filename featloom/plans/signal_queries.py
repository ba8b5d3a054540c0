"""Signal, sensitivity, the feature report, correlations and guidance."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.constants import MODEL_NOTES
from featloom.operators import correlation, signal, summaries
from featloom.plans.registry import (
    GAPPY_NUMERIC, GAPPY_SQL, SIGNAL_NUMERIC, SIGNAL_SQL, gappy, query, signal_table, sql_cramer, sql_eta,
    sql_pearson, sql_rows, sql_signal, table,
)


@query("pearson", f"WITH {GAPPY_SQL}\n" + sql_rows([
    f"SELECT '{c}' AS feature, round({sql_pearson('g', c, 'disc')}, 6) + 0.0 AS r" for c in ["qty", "price", "tax"]]))
def pearson(spark, sf):
    found = signal.pearson_to_target(gappy(spark, sf), ["qty", "price", "tax"], "disc")
    return found.select("feature", (F.round("r", 6) + 0.0).alias("r"))


@query("eta_squared", f"WITH {GAPPY_SQL}\n" + sql_rows([
    f"SELECT '{c}' AS feature, round({sql_eta('g', c, 'flag')}, 6) AS eta_squared" for c in GAPPY_NUMERIC]))
def eta_squared(spark, sf):
    found = signal.eta_squared(gappy(spark, sf), GAPPY_NUMERIC, "flag")
    return found.select("feature", F.round("eta_squared", 6).alias("eta_squared"))


@query("eta_squared_by_levels", f"WITH {SIGNAL_SQL}\n" + sql_rows([
    f"SELECT '{c}' AS feature, round({sql_eta('s', 'gross', c)}, 6) AS eta_squared"
    for c in ["flag", "size_class", "band"]]))
def eta_squared_by_levels(spark, sf):
    found = signal.eta_squared_by_levels(signal_table(spark, sf), ["flag", "size_class", "band"], "gross")
    return found.select("feature", F.round("eta_squared", 6).alias("eta_squared"))


@query("eta_squared_text_length", f"""
SELECT 'n_text' AS feature, round({sql_eta("(SELECT length(text) AS n_text, role FROM conversations)", 'n_text', 'role')}, 6)
       AS eta_squared""")
def eta_squared_text_length(spark, sf):
    talk = table(spark, sf, "conversations").select("role", F.length("text").alias("n_text"))
    found = signal.eta_squared(talk, ["n_text"], "role")
    return found.select("feature", F.round("eta_squared", 6).alias("eta_squared"))


@query("cramers_v", f"WITH {SIGNAL_SQL}\n" + sql_rows([
    f"SELECT '{c}' AS feature, round({sql_cramer('s', c, 'band')}, 6) AS cramers_v"
    for c in ["flag", "status", "size_class"]]))
def cramers_v(spark, sf):
    found = signal.cramers_v(signal_table(spark, sf), ["flag", "status", "size_class"], "band")
    return found.select("feature", F.round("cramers_v", 6).alias("cramers_v"))


@query("crosstab", f"""WITH {GAPPY_SQL} SELECT flag AS level, status AS class, count(*) AS n FROM g
WHERE flag IS NOT NULL GROUP BY 1, 2""")
def crosstab(spark, sf):
    return signal.contingency(gappy(spark, sf), ["flag"], "status").select("level", "class", "n")


def _strength(c, target, target_numeric, numeric):
    if c in numeric and target_numeric:
        return "pearson", f"abs({sql_pearson('s', c, target)})"
    if c in numeric:
        return "eta_squared", sql_eta("s", c, target)
    if target_numeric:
        return "eta_squared", sql_eta("s", target, c)
    return "cramers_v", sql_cramer("s", c, target)


def _signal_sql(features, target, target_numeric, numeric=SIGNAL_NUMERIC):
    rows = []
    for i, c in enumerate(features):
        method, strength = _strength(c, target, target_numeric, numeric)
        rows.append(f"SELECT {i} AS ordinal, '{c}' AS feature, {str(c in numeric).lower()} AS is_numeric, "
                    f"'{method}' AS method, {strength} AS strength")
    return sql_rows(rows)


BAND_FEATURES = ["qty", "price", "disc", "tax", "gross", "net", "supp", "flag", "status", "size_class"]
NET_FEATURES = ["qty", "price", "disc", "tax", "gross", "supp", "flag", "status", "size_class", "band"]


@query("signal_strength", f"""WITH {SIGNAL_SQL}, x AS ({_signal_sql(BAND_FEATURES, 'band', False)})
SELECT ordinal, feature, is_numeric, method, round(strength, 6) AS strength, {sql_signal('strength')} AS signal FROM x""")
def signal_strength(spark, sf):
    found = signal.signal_strength(signal_table(spark, sf), "band", BAND_FEATURES)
    return found.withColumn("strength", F.round("strength", 6))


def _sensitivity_sql(features, numeric=SIGNAL_NUMERIC):
    rows = []
    for c in features:
        if c in numeric:
            rows.append(f"SELECT '{c}' AS feature, CAST(max({c}) - min({c}) AS DOUBLE) AS value_range, "
                        f"stddev_samp({c}) / (abs(avg({c})) + 1e-10) AS cv, true AS num FROM s")
        else:
            rows.append(f"SELECT '{c}' AS feature, CAST(NULL AS DOUBLE) AS value_range, CAST(NULL AS DOUBLE) AS cv, false AS num")
    return f"""SELECT feature, value_range, cv, CASE WHEN NOT num THEN 'N/A'
      WHEN value_range > 100 OR cv > 1 THEN 'High' WHEN value_range > 10 OR cv > 0.3 THEN 'Medium' ELSE 'Low' END
      AS sensitivity FROM ({sql_rows(rows)})"""


@query("scale_sensitivity", f"""WITH {SIGNAL_SQL}, x AS ({_sensitivity_sql(BAND_FEATURES)})
SELECT feature, round(value_range, 4) AS value_range, round(cv, 6) AS cv, sensitivity FROM x""")
def scale_sensitivity(spark, sf):
    found = signal.scale_sensitivity(signal_table(spark, sf), BAND_FEATURES)
    return found.select("feature", F.round("value_range", 4).alias("value_range"), F.round("cv", 6).alias("cv"),
                        "sensitivity")


def _report_sql(rel_sql, features, target, target_numeric, numeric=SIGNAL_NUMERIC):
    notes = " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in MODEL_NOTES.items())
    return f"""
WITH {rel_sql}, raw AS ({_signal_sql(features, target, target_numeric, numeric)}),
sig AS (SELECT *, {sql_signal('strength')} AS signal FROM raw),
sens AS ({_sensitivity_sql(features, numeric)}),
m AS (SELECT unnest(['Logistic Regression', 'KNN', 'SVM', 'Decision Tree']) AS model),
x AS (SELECT model, ordinal, sig.feature AS feature, is_numeric, signal, sensitivity AS sens,
        CASE WHEN signal = 'Low' THEN 'Weak'
             WHEN model <> 'Decision Tree' AND sensitivity = 'High' THEN 'Risky' ELSE 'Good' END AS fit
      FROM sig JOIN sens ON sig.feature = sens.feature CROSS JOIN m)
SELECT model, ordinal, feature,
  coalesce(nullif(concat_ws(' ', CASE WHEN signal = 'High' THEN '⭐' END,
    CASE WHEN sens = 'High' AND model <> 'Decision Tree' THEN '⚖️' END,
    CASE WHEN model = 'Decision Tree' AND signal <> 'Low' THEN '🌳' END,
    CASE WHEN model = 'KNN' AND is_numeric THEN '📏' END), ''), '—') AS flags,
  signal, sens AS scale_sensitivity, fit AS compatibility,
  CASE WHEN signal = 'Low' THEN 'Optional (drop if noisy)'
       WHEN fit = 'Risky' AND model = 'Logistic Regression' THEN 'Scale + Regularize'
       WHEN fit = 'Risky' THEN 'Scale first'
       WHEN sens = 'High' AND model IN ('KNN', 'SVM') THEN 'Must scale'
       WHEN signal = 'High' THEN 'Keep (strong)' ELSE 'Keep' END AS recommendation,
  CASE model {notes} END AS model_note
FROM x"""


@query("feature_report", _report_sql(SIGNAL_SQL, BAND_FEATURES, "band", False))
def feature_report(spark, sf):
    return signal.feature_report(signal_table(spark, sf), "band", features=BAND_FEATURES)


@query("feature_report_numeric_target", _report_sql(SIGNAL_SQL, NET_FEATURES, "net", True))
def feature_report_numeric_target(spark, sf):
    return signal.feature_report(signal_table(spark, sf), "net", features=NET_FEATURES)


FLAG_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"]


@query("feature_report_lineitem", _report_sql(
    "s AS (SELECT * FROM lineitem)", FLAG_FEATURES, "l_returnflag", False, FLAG_FEATURES[:4]))
def feature_report_lineitem(spark, sf):
    rows = table(spark, sf, "lineitem").select(*FLAG_FEATURES, "l_returnflag")
    return signal.feature_report(rows, "l_returnflag", features=FLAG_FEATURES)


DOCUMENT_FEATURES = ["text", "source", "n_chars"]


@query("feature_report_documents", _report_sql(
    "s AS (SELECT * FROM documents)", DOCUMENT_FEATURES, "lang", False, ["n_chars"]))
def feature_report_documents(spark, sf):
    """Whole texts as levels; copies of a text are one level."""
    rows = table(spark, sf, "documents").select(*DOCUMENT_FEATURES, "lang")
    return signal.feature_report(rows, "lang", features=DOCUMENT_FEATURES)


# --- correlations ---------------------------------------------------------------------


def _matrix_sql(columns, rel="g"):
    return sql_rows([
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({sql_pearson(rel, a, b)}, 6) + 0.0 AS corr"
        for a in columns for b in columns])


@query("corr_matrix", f"WITH {GAPPY_SQL}\n" + _matrix_sql(["qty", "price", "tax"]))
def corr_matrix(spark, sf):
    found = correlation.corr_matrix(gappy(spark, sf).drop("l_orderkey", "l_linenumber"), "disc")
    return found.withColumn("corr", F.round("corr", 6) + 0.0)


@query("corr_matrix_all", f"WITH {GAPPY_SQL}\n" + _matrix_sql(GAPPY_NUMERIC))
def corr_matrix_all(spark, sf):
    found = correlation.corr_matrix(gappy(spark, sf).drop("l_orderkey", "l_linenumber"))
    return found.withColumn("corr", F.round("corr", 6) + 0.0)


def _pairs_sql(columns, rel="s"):
    return sql_rows([
        f"SELECT {i} AS i, {j} AS j, '{columns[i]}' AS feature_a, '{columns[j]}' AS feature_b, "
        f"{sql_pearson(rel, columns[i], columns[j])} AS r"
        for i in range(len(columns)) for j in range(i + 1, len(columns))])


@query("corr_pairs", f"""WITH {SIGNAL_SQL}, p AS ({_pairs_sql(SIGNAL_NUMERIC)})
SELECT i, j, feature_a, feature_b, feature_a || ' ↔ ' || feature_b AS pair,
  round(abs(r), 6) AS corr, round(r, 6) AS signed_corr FROM p WHERE abs(r) >= 0.8""")
def corr_pairs(spark, sf):
    found = correlation.collinear_pairs(signal_table(spark, sf), "band")
    return found.withColumns({"corr": F.round("corr", 6), "signed_corr": F.round("signed_corr", 6)})


@query("corr_to_target", f"""WITH {SIGNAL_SQL},
codes AS (SELECT band AS b, row_number() OVER (ORDER BY band) - 1 AS y FROM (SELECT DISTINCT band FROM s)),
t AS (SELECT s.*, y FROM s JOIN codes ON band = b),
x AS ({sql_rows([f"SELECT {i} AS ordinal, '{c}' AS feature, abs({sql_pearson('t', c, 'y')}) AS corr"
                 for i, c in enumerate(SIGNAL_NUMERIC)])})
SELECT ordinal, feature, round(corr, 6) AS corr FROM x ORDER BY corr DESC""")
def corr_to_target(spark, sf):
    return correlation.corr_to_target(signal_table(spark, sf), "band").withColumn("corr", F.round("corr", 6))


@query("corr_to_target_missing", f"""WITH {GAPPY_SQL},
m AS (SELECT *, CASE flag WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'next' WHEN 'R' THEN 'zeta' END AS c FROM g),
codes AS (SELECT c AS b, row_number() OVER (ORDER BY c) - 1 AS y FROM (SELECT DISTINCT c FROM m WHERE c IS NOT NULL)),
t AS (SELECT m.*, coalesce(y, -1) AS y FROM m LEFT JOIN codes ON c = b),
x AS ({sql_rows([f"SELECT {i} AS ordinal, '{c}' AS feature, abs({sql_pearson('t', c, 'y')}) AS corr"
                 for i, c in enumerate(GAPPY_NUMERIC)])})
SELECT ordinal, feature, round(corr, 6) AS corr FROM x""")
def corr_to_target_missing(spark, sf):
    """Missing targets code as -1, present classes on both sides of 'nan' by rank."""
    named = F.expr("CASE flag WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'next' WHEN 'R' THEN 'zeta' END")
    rows = gappy(spark, sf).select(*GAPPY_NUMERIC, named.alias("c"))
    return correlation.corr_to_target(rows, "c").withColumn("corr", F.round("corr", 6))


@query("pearson_wide", f"""WITH {SIGNAL_SQL}, w AS (SELECT *, {', '.join(f'qty * {k} + price AS w{k}' for k in range(1, 9))} FROM s)
""" + sql_rows([f"SELECT '{c}' AS feature, round({sql_pearson('w', c, 'gross')}, 6) AS r"
                for c in [*[n for n in SIGNAL_NUMERIC if n != "gross"], *[f"w{k}" for k in range(1, 9)]]]))
def pearson_wide(spark, sf):
    """Fourteen features by the same path as three."""
    rows = signal_table(spark, sf).selectExpr("*", *[f"qty * {k} + price AS w{k}" for k in range(1, 9)])
    features = [*[n for n in SIGNAL_NUMERIC if n != "gross"], *[f"w{k}" for k in range(1, 9)]]
    return signal.pearson_to_target(rows, features, "gross").select("feature", F.round("r", 6).alias("r"))


@query("scale_ranges", f"""WITH {SIGNAL_SQL},
r AS ({sql_rows([f"SELECT {i} AS ordinal, '{c}' AS feature, CAST(max({c}) - min({c}) AS DOUBLE) AS value_range FROM s"
                 for i, c in enumerate(SIGNAL_NUMERIC)])})
SELECT ordinal, feature, round(value_range, 3) AS value_range, round(value_range / max(value_range) OVER (), 6) AS normalized,
  value_range / max(value_range) OVER () > 0.5 AS is_dominant FROM r""")
def scale_ranges(spark, sf):
    found = summaries.scale_ranges(signal_table(spark, sf), "band")
    return found.withColumns({"value_range": F.round("value_range", 3), "normalized": F.round("normalized", 6)})


@query("model_guidance", f"""WITH {SIGNAL_SQL},
r AS ({sql_rows([f"SELECT {i} AS ordinal, '{c}' AS feature, CAST(max({c}) - min({c}) AS DOUBLE) AS value_range FROM s"
                 for i, c in enumerate(SIGNAL_NUMERIC)])}),
d AS (SELECT string_agg(feature, ', ' ORDER BY value_range DESC, ordinal) AS names FROM
  (SELECT * FROM (SELECT *, value_range / max(value_range) OVER () AS share FROM r) WHERE share > 0.5
   ORDER BY value_range DESC, ordinal LIMIT 2)),
p AS (SELECT feature_a || ' ↔ ' || feature_b AS pair, abs(r) AS c FROM ({_pairs_sql(SIGNAL_NUMERIC)})
  WHERE abs(r) >= 0.8 ORDER BY i, j LIMIT 1)
SELECT 'Logistic Regression' AS model, 'Scale ' || names || '. Consider dropping one of ' || pair
  || printf(' (r=%.2f).', c) AS guidance FROM d, p
UNION ALL SELECT 'KNN', 'Scale ' || names || '.' FROM d
UNION ALL SELECT 'SVM', 'Scale ' || names || '.' FROM d
UNION ALL SELECT 'Decision Tree', 'Scaling not required. Multicollinearity not critical for trees.' FROM p""")
def model_guidance(spark, sf):
    return summaries.model_guidance(signal_table(spark, sf), "band")
