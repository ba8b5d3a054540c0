"""Decision trees grown until their leaves are pure: a distributed top, the rest in tasks.

A distributed tree is fitted first, deep enough that its leaves (regions) fit a task:
at most ``CELLS`` numbers each. Regions still larger are split by further distributed
fits on their own rows. Every region is then grown to purity in one task, on all its rows
and with exact midpoints as thresholds. Small tables need no top: the whole tree is exact.

Ties between splits go to the first feature, then to the smallest threshold; a node
without a gain is still split while it holds two classes and two values. Equal rows of
several classes end in one leaf, whose class is the most frequent, smallest label first.
Only a region above the bound in which no binned split gains anything stays one leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, functions as F

from featloom.functions.columns import union_all
from featloom.session import cut_lineage

CELLS = 1 << 20  # numbers of a region that one task grows: 8 MB
BROADCAST_BYTES = 64 << 20  # trees up to this size are sent to all tasks, larger ones meet their rows in a shuffle
LANE_ROWS = 1 << 20  # rows of a region that meet its tree in one task
NODES = "feature array<int>, threshold array<double>, left array<int>, right array<int>, label array<double>, share array<double>, second array<double>"
FIELDS = ("feature", "threshold", "left", "right", "label", "share", "second")


def best_split(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[int, float] | None:
    """(feature, threshold) of the least weighted Gini impurity; None if all rows are equal."""
    best, found, n = math.inf, None, len(y)
    hot = np.eye(classes)[y]
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values = x[order, f]
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        below = np.cumsum(hot[order], axis=0)
        left, size = below[cuts], cuts + 1.0
        right = below[-1] - left
        # n·Gini of both sides; counts are whole, so equal splits compare as equal.
        cost = n - (left * left).sum(axis=1) / size - (right * right).sum(axis=1) / (n - size)
        at = int(cost.argmin())
        if cost[at] < best - 1e-9:
            best, lower, upper = cost[at], values[cuts[at]], values[cuts[at] + 1]
            middle = lower + (upper - lower) / 2
            found = f, float(middle if middle < upper else lower)
    return found


def grow(x: np.ndarray, labels: np.ndarray) -> dict[str, list]:
    """Flat tree of one region; a feature of -1 marks a leaf, rows up to the threshold go left."""
    tree: dict[str, list] = {name: [] for name in FIELDS}

    def add(y: np.ndarray) -> int:
        values, counts = np.unique(y, return_counts=True)
        for name, value in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("label", float(values[counts.argmax()])),
                            ("share", counts.max() / len(y)), ("second", float((y == 1.0).mean()))):
            tree[name].append(value)
        return len(tree["label"]) - 1

    stack = [(add(labels), np.arange(len(labels)))]
    while stack:
        node, rows = stack.pop()
        values, codes = np.unique(labels[rows], return_inverse=True)
        split = best_split(x[rows], codes, len(values)) if len(values) > 1 else None
        if split is None:
            continue
        tree["feature"][node], tree["threshold"][node] = split
        low = x[rows, split[0]] <= split[1]
        for side, part in (("left", rows[low]), ("right", rows[~low])):
            tree[side][node] = add(labels[part])
            stack.append((tree[side][node], part))
    return tree


def walk(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    at = np.zeros(len(x), np.int64)
    active = np.flatnonzero(tree["feature"][at] >= 0)
    while len(active):
        nodes = at[active]
        low = x[active, tree["feature"][nodes]] <= tree["threshold"][nodes]
        at[active] = np.where(low, tree["left"][nodes], tree["right"][nodes])
        active = active[tree["feature"][at[active]] >= 0]
    return at


def depth_of(tree: dict[str, list]) -> int:
    depth, stack = 0, [(0, 0)]
    while stack:
        node, level = stack.pop()
        depth = max(depth, level)
        if tree["feature"][node] >= 0:
            stack += [(tree["left"][node], level + 1), (tree["right"][node], level + 1)]
    return depth


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


@dataclass
class DeepTree:
    tops: list[tuple[str, object]]  # (region it splits, model), in order
    trees: DataFrame  # region, lanes, one flat tree
    bytes: int  # of all flat trees
    _held: dict = field(default_factory=dict)

    def transform(self, rows: DataFrame, keep: list[str] = ()) -> DataFrame:
        """``keep`` columns, ``prediction`` and ``score`` of rows that hold ``features``."""
        routed = route(rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], "features"), self.tops)
        plain = routed.select("region", vector_to_array("features").alias("x"), *[f"k{i}" for i in range(len(keep))])
        kinds = "".join(f"k{i} {rows.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
        schema = f"{kinds}prediction double, top double, second double"
        scored = self._by_broadcast(plain, schema) if self.bytes <= BROADCAST_BYTES else self._by_shuffle(plain, schema)
        return scored.toDF(*keep, "prediction", "top", "second")

    def _by_broadcast(self, plain: DataFrame, schema: str) -> DataFrame:
        if not self._held:
            self._held.update({r["region"]: {n: np.array(r[n]) for n in FIELDS} for r in self.trees.collect()})
        shared = plain.sparkSession.sparkContext.broadcast(self._held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, out = _matrix(batch.column(1)), np.empty((3, batch.num_rows))
                    names, where = np.unique(np.array(batch.column(0).to_pylist()), return_inverse=True)
                    for k, name in enumerate(names):
                        own = np.flatnonzero(where == k)
                        out[:, own] = _answers(shared.value[str(name)], x[own])
                    yield _answered(batch, out)

        return plain.mapInArrow(run, schema)

    def _by_shuffle(self, plain: DataFrame, schema: str) -> DataFrame:
        """Trees come first among the rows of their region and lane; a task holds one tree at a time."""
        lanes = self.trees.select("region", "lanes")  # a row per region, joined by its key
        marked = plain.join(lanes, "region").withColumn("lane", (F.rand(7) * F.col("lanes")).cast("int"))
        names = [c for c in plain.columns if c not in ("region", "x")]
        tree = self.trees.select("region", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.struct(*FIELDS).alias("tree"))
        rows = marked.select("region", "x", *names, "lane").unionByName(tree, allowMissingColumns=True)
        dealt = rows.repartition("region", "lane").sortWithinPartitions("region", "lane", F.col("tree").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                trees = batch.column(batch.schema.get_field_index("tree"))
                places = [*np.flatnonzero(trees.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
                for start, stop in zip([-1, *places[:-1]], places):
                    if start >= 0:
                        held = {n: np.array(v) for n, v in trees[start].as_py().items()}
                    part = batch.slice(start + 1, stop - start - 1)
                    if part.num_rows:
                        yield _answered(part.select(["region", "x", *names]), _answers(held, _matrix(part.column(1))))

        return dealt.mapInArrow(run, schema)


def _answers(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    leaf = walk(tree, x)
    return np.stack([tree["label"][leaf], tree["share"][leaf], tree["second"][leaf]])


def _answered(batch: pa.RecordBatch, out: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[2:], *map(pa.array, out)],
                                      names=[*batch.schema.names[2:], "prediction", "top", "second"])


def route(rows: DataFrame, tops: list[tuple[str, object]]) -> DataFrame:
    """Rows with the ``region`` that the distributed trees send them to; only a region's rows meet its tree."""
    done, parts = rows.withColumn("region", F.lit("")), []
    for k, (region, model) in enumerate(tops):
        own = done.where(F.col("region") == region).drop("region")
        sent = model.transform(own).withColumn("region", F.concat(F.lit(f"{k}:"), F.col("leaf").cast("int").cast("string")))
        parts = [p.where(F.col("region") != region) for p in (parts or [done])] + [sent.select(*rows.columns, "region")]
        done = union_all(parts)
    return done


def fit_top(own: DataFrame, depth: int, settings: dict):
    """A distributed tree over some rows.

    The classifier takes splits back whose sides predict the same class. Where none is left,
    the share of the most frequent class is regressed on: its variance is half the Gini
    impurity of this class against the rest, and sides with different shares stay apart.
    """
    model = DecisionTreeClassifier(maxDepth=depth, leafCol="leaf", **settings).fit(own)
    if model.depth:
        return model
    most = own.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
    shares = own.withColumn("label", F.when(F.col("label") == most, 1.0).otherwise(0.0))
    return DecisionTreeRegressor(maxDepth=depth, leafCol="leaf", **{k: v for k, v in settings.items() if k != "impurity"}).fit(shares)


def fit_deep_tree(data: DataFrame, cells: int = CELLS, **settings) -> DeepTree:
    """``data`` holds ``label`` and ``features``, without gaps; ``settings`` go to the distributed fits."""
    known = data.where(F.col("label").isNotNull()).select("label", "features")
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_to_array("features"))).alias("width")).first()
    if not facts["n"]:
        raise ValueError("no rows to learn from")
    room = max(1, cells // max(1, facts["width"]))  # rows of a region that one task grows
    tops: list[tuple[str, object]] = []
    large, stuck = [("", facts["n"])] if facts["n"] > room else [], set()
    while large:
        for region, n in large:
            depth = min(20, math.ceil(math.log2(n / room)) + 2)
            own = route(known, tops).where(F.col("region") == region).drop("region")
            model = fit_top(own, depth, settings)
            if model.depth:
                tops.append((region, model))
            else:
                stuck.add(region)
        counted = route(known, tops).groupBy("region").count().where(F.col("count") > room)
        large = [(r["region"], r["count"]) for r in counted.toLocalIterator() if r["region"] not in stuck]
    routed = route(known, tops).select("region", "label", vector_to_array("features").alias("x"))

    def region_tree(group: pd.DataFrame) -> pd.DataFrame:
        tree = grow(np.stack(group["x"].to_numpy()), group["label"].to_numpy(float))
        return pd.DataFrame([{"region": group["region"].iloc[0], "lanes": -(-len(group) // LANE_ROWS), "depth": depth_of(tree), **tree}])

    schema = f"region string, lanes int, depth int, {NODES}"
    grown = routed.where(~F.col("region").isin(*stuck)) if stuck else routed
    parts = [grown.groupBy("region").applyInPandas(region_tree, schema)]
    if stuck:
        by_label = routed.where(F.col("region").isin(*stuck)).groupBy("region", "label").count()
        whole = by_label.groupBy("region").agg(
            F.sum("count").alias("n"), F.max(F.struct("count", (-F.col("label")).alias("label"))).alias("top"),
            F.sum(F.when(F.col("label") == 1.0, F.col("count")).otherwise(0)).alias("ones"))
        leaf = [F.array(F.lit(-1)).alias("feature"), F.array(F.lit(0.0)).alias("threshold"), F.array(F.lit(-1)).alias("left"),
                F.array(F.lit(-1)).alias("right"), F.array(-F.col("top.label")).alias("label"),
                F.array(F.col("top.count") / F.col("n")).alias("share"), F.array(F.col("ones") / F.col("n")).alias("second")]
        parts.append(whole.select("region", F.ceil(F.col("n") / LANE_ROWS).cast("int").alias("lanes"), F.lit(0).alias("depth"), *leaf))
    trees = cut_lineage(union_all(parts))
    size = trees.agg(F.sum(F.size("feature") * 44)).first()[0]
    return DeepTree(tops, trees, size)
