"""Properties that must hold on the given tables whatever the partitioning."""

import pytest
from pyspark.sql import functions as F

from featloom.operators import correlation, outliers, preprocess, signal
from featloom.operators.encode import fit_levels, frequency_encode
from featloom.plans.registry import GAPPY_NUMERIC, gappy, signal_table


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return gappy(spark, sf_dir).persist()


def test_scaled_columns(rows):
    standard = preprocess.fit_scaler(rows, "StandardScaler", GAPPY_NUMERIC).apply(rows)
    for c in GAPPY_NUMERIC:
        mean, std = standard.agg(F.avg(c), F.stddev_pop(c)).first()
        assert mean == pytest.approx(0, abs=1e-9) and std == pytest.approx(1)
    unit = preprocess.fit_scaler(rows, "MinMaxScaler", GAPPY_NUMERIC).apply(rows)
    for c in GAPPY_NUMERIC:
        assert tuple(unit.agg(F.min(c), F.max(c)).first()) == (0.0, 1.0)


def test_clipping_twice_changes_little_and_keeps_rows(rows):
    once = outliers.clip_outliers(rows, ["price"], 1.0)
    low, high = outliers.outlier_bounds(rows, ["price"], 1.0)["price"]
    assert once.count() == rows.count()
    assert once.where(~F.col("price").between(low, high)).count() == 0
    again = once.withColumn("price", outliers._clipped("price", low, high))
    assert again.exceptAll(once).count() == 0


def test_frequencies_sum_to_one(rows):
    coded = frequency_encode(rows.select(F.col("flag").alias("level"), "flag"), fit_levels(rows, ["flag"]))
    present = coded.where("level is not null").distinct()
    assert present.agg(F.sum("flag")).first()[0] == pytest.approx(1.0)


def test_correlations_are_symmetric_and_bounded(rows):
    found = {(r["feature_a"], r["feature_b"]): r["corr"] for r in correlation.corr_matrix(rows).collect()}
    for (a, b), r in found.items():
        assert -1.0 <= r <= 1.0 and found[b, a] == r and (a != b or r == pytest.approx(1.0))


def test_strengths_are_shares(spark, sf_dir):
    table = signal_table(spark, sf_dir)
    for target in ("band", "net"):
        assert signal.signal_strength(table, target).where("strength not between 0 and 1 + 1e-12").count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(rows, parts):
    moved = rows.repartition(parts)
    for run in (
        lambda d: signal.feature_report(d.drop("l_orderkey", "l_linenumber"), "flag").collect(),
        lambda d: preprocess.fit_imputer(d, "Median", GAPPY_NUMERIC).fill,
        lambda d: preprocess.fit_imputer(d, "Most Frequent", GAPPY_NUMERIC).fill,
        lambda d: [t.rows for t in fit_levels(d, ["flag", "status"]).values()],
        lambda d: outliers.remove_outliers(d, ["price", "qty"], 1.5).count(),
    ):
        a, b = run(rows), run(moved)
        assert (sorted(map(str, a)) == sorted(map(str, b))) if isinstance(a, list) else a == b
