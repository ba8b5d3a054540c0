"""Trees grown until their leaves are pure."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featloom import constants as K
from featloom.operators import deep_tree, models


def brute_tree(rows):
    """Exact tree on (features, label) rows; a leaf is its class, a node (feature, threshold, low, high)."""
    labels = [y for _, y in rows]
    top = max(sorted(set(labels)), key=labels.count)
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            cut, cost = a + (b - a) / 2, Fraction(0)
            for side in ([y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]):
                cost += len(side) - Fraction(sum(side.count(c) ** 2 for c in set(side)), len(side))
            if best is None or cost < best[0]:
                best = cost, f, cut
    if len(set(labels)) == 1 or best is None:
        return top
    _, f, cut = best
    return f, cut, brute_tree([r for r in rows if r[0][f] <= cut]), brute_tree([r for r in rows if r[0][f] > cut])


def brute_class(tree, x):
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


def points(spark, rows):
    frame = spark.createDataFrame([(i, [float(v) for v in x], float(y)) for i, (x, y) in enumerate(rows)], "id long, x array<double>, label double")
    return frame.select("id", "label", array_to_vector("x").alias("features"))


def classes_of(tree, frame):
    return {r["id"]: r["prediction"] for r in tree.transform(frame, ["id"]).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_small_trees_as_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [([rng.randint(0, 9), rng.randint(0, 4), rng.random()], rng.randint(0, 2)) for _ in range(70)] + [([1, 1, 0.5], k % 2) for k in range(5)]
    want = brute_tree(rows)
    tree = deep_tree.fit_deep_tree(points(spark, rows))
    fresh = [([rng.randint(-1, 10), rng.randint(0, 5), rng.random()], 0) for _ in range(200)]
    for asked in (rows, fresh):
        got = classes_of(tree, points(spark, asked))
        assert not tree.tops and all(got[i] == brute_class(want, x) for i, (x, _) in enumerate(asked))


def test_depth_beyond_the_estimators_limit(spark):
    """Alternating classes on a line: one point is cut off after the other."""
    rows = [([i], i % 2) for i in range(150)]
    tree = deep_tree.fit_deep_tree(points(spark, rows))
    assert tree.trees.agg(F.max("depth")).first()[0] > 30
    got = classes_of(tree, points(spark, rows))
    assert all(got[i] == y for i, (_, y) in enumerate(rows))


def test_regions_grow_in_tasks_of_bounded_size(spark, monkeypatch):
    """Distributed tops, regions refined again, a hot point with two classes, both ways to meet the trees."""
    rng = random.Random(5)
    rows = [([rng.random(), rng.random()], int(rng.random() < 0.3)) for _ in range(900)]
    rows += [([0.5, 0.5], 1)] * 260 + [([0.5, 0.5], 0)] * 140
    frame = points(spark, rows).coalesce(2)
    tree = deep_tree.fit_deep_tree(frame, cells=400, maxBins=32, seed=1)
    assert len(tree.tops) > 1
    routed = deep_tree.route(frame, tree.tops)
    assert routed.count() == len(rows)
    counted = {r["region"]: r["count"] for r in routed.groupBy("region").count().collect()}
    nodes = {r["region"]: len(r["feature"]) for r in tree.trees.collect()}
    assert set(counted) == set(nodes) and all(n <= 200 or nodes[k] == 1 for k, n in counted.items())
    got = classes_of(tree, frame)
    # Where no region stayed large, distinct rows keep their classes.
    small = {r["id"] for r in routed.collect() if counted[r["region"]] <= 200}
    assert all(got[i] == y for i, (_, y) in enumerate(rows[:900]) if i in small) and len(small) > 800
    assert {got[i] for i in range(900, len(rows))} == {1.0}
    monkeypatch.setattr(deep_tree, "BROADCAST_BYTES", -1)
    lanes = deep_tree.DeepTree(tree.tops, tree.trees.withColumn("lanes", F.lit(3)), tree.bytes)
    assert classes_of(lanes, frame) == got


def test_full_depth_through_the_models(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b), "yes" if c else "no") for i, (a, b, c) in enumerate(zip(
        rng.normal(size=200), rng.normal(size=200), rng.random(200) < 0.5))], "id long, a double, b double, t string")
    fitted = models.fit_model(df, K.TREE, "t", ["no", "yes"], ["a", "b"], maxDepth=None)
    got = fitted.predict(df, ["id", "t"]).collect()
    assert all(r["predicted_class"] == r["t"] and r["score"] == float(r["t"] == "yes") for r in got) and len(got) == 200
    assert models.importance(fitted) == []
    with pytest.raises(ValueError, match="no rows"):
        models.fit_model(df.limit(0), K.TREE, "t", ["no", "yes"], ["a", "b"], maxDepth=None)
