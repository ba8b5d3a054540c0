"""Toxicity categories by a classifier chain.

Categories are predicted one after the other by logistic models over the words of a text, the
beginnings of its words (inflected forms share them) and a few figures of its looks. Each model
also takes the log-odds that the models before it give. Those are out-of-fold in fitting: for
every learning document they come from models that haven't seen its text (folds are dealt by the
text, so copies share one), and a later model learns how far the earlier ones can be trusted on
new texts. Each fit is a task.

The models are fitted on at most ``max_labelled`` labelled rows, chosen by a hash of their
id; features come from a distributed count over these rows. Scoring covers every
whole text, in one pass without a shuffle. Null text scores like the empty text; rows of labels
with a null label or without their document are ignored, as are repeated ids (the least label
row of an id counts). With no labels, or one value only, a category's probability is its mean
(0 without labels). Ties cannot arise: scores are numbers, rows are scored each for itself. An empty
table gives no rows. Output columns replace columns of the same names; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\W\d_]+"
STEMS = (4, 5, 6)  # beginnings of longer words that are features too
LOOKS = 6
FOLDS = 4


def looks(text: str, found: list[str], distinct: int) -> list[float]:
    """Figures of a text's looks, each about 0 to 1."""
    n = max(1, len(text))
    return [min(1.0, np.log1p(len(found)) / 10), distinct / max(1, len(found)), sum(map(len, found)) / n,
            text.count("\n") / n * 20, (text.count("!") + text.count("|") + text.count("#")) / n * 10,
            sum(map(str.isupper, found)) / max(1, len(found))]


def features(text: str | None, word: re.Pattern) -> tuple[set[str], list[float]]:
    """The distinct words and beginnings (marked by a star), and the looks."""
    text = text or ""
    every = word.findall(text)
    found = set(map(str.lower, every))
    shape = looks(text, every, len(found))
    for n in STEMS:
        found |= {w[:n] + "*" for w in found if len(w) > n and w[-1] != "*"}
    return found, shape


@dataclass
class Chain:
    """Fitted models: per category weights of [looks, earlier log-odds, chosen features], and a bias."""

    categories: list[str]
    index: dict[str, int] = field(default_factory=dict)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)

    def score(self, found: set[str], shape: list[float]) -> list[float]:
        chosen = [i for f in found if (i := self.index.get(f)) is not None]
        row = (np.array(shape) - self.mean) / self.scale
        odds: list[float] = []
        for j, (w, b) in enumerate(zip(self.weights, self.bias)):
            dense = np.concatenate([row, squash(np.array(odds))])
            z = float(b + dense @ w[:LOOKS + j] + w[LOOKS + j:][chosen].sum())
            odds.append(z)
        return [float(1 / (1 + np.exp(-np.clip(z, -50, 50)))) for z in odds]


def squash(odds: np.ndarray) -> np.ndarray:
    return np.clip(odds, -8, 8) / 4


def fit_logistic(dense: np.ndarray, rows: np.ndarray, cols: np.ndarray, width: int, y: np.ndarray,
                 l2: float = 0.1, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient descent.

    ``rows`` and ``cols`` name the ones of a sparse 0/1 matrix of ``width`` columns. A
    rare category's rows weigh more, by the root of the classes' ratio, so that it isn't drowned.
    """
    n, d = dense.shape
    rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return np.zeros(d + width), start
    share = np.where(y > 0.5, np.sqrt((1 - rate) / rate), 1.0)
    start /= 2
    apply = lambda w: dense @ w[:d] + np.bincount(rows, w[d:-1][cols], n) + w[-1]
    back = lambda r: np.concatenate([dense.T @ r, np.bincount(cols, r[rows], width), [r.sum()]])
    v = np.ones(d + width + 1)
    for _ in range(15):  # largest eigenvalue, for the step
        v = back(share * apply(v))
        top = np.linalg.norm(v)
        v /= top
    step = 1 / (0.25 * top + l2)
    w = np.zeros(d + width + 1)
    w[-1] = start
    ahead, t = w.copy(), 1.0
    shrink = np.append(np.full(d + width, l2), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(apply(ahead), -50, 50)))
        new = ahead - step * (back(share * (p - y)) + shrink * ahead)
        t, before, moved = (1 + np.sqrt(1 + 4 * t * t)) / 2, t, new - w
        ahead, w = new + (before - 1) / t * moved, new
        if np.abs(moved).max() < 1e-3:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = 20_000, max_features: int = 4_000, least_docs: int = 4, strength: float = 20.0) -> Chain:
    """A chain over 0/1 columns of ``labels``, in their order.

    ``max_labelled`` bounds the learning rows. A feature is kept if at least ``least_docs`` of
    them have it and its G statistic against some category exceeds ``strength``; at most
    ``max_features``, the strongest.
    """
    spark = docs.sparkSession
    chain = Chain(list(categories), mean=np.zeros(LOOKS), scale=np.ones(LOOKS))
    y = [f"y{i}" for i in range(len(categories))]
    clean = (labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(categories, y)])
             .dropna().groupBy("id").agg(F.min(F.struct(*y)).alias("y")).select("id", "y.*"))
    known = clean.count()
    share = min(1.0, 0.95 * max_labelled / max(1, known))
    sample = clean.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # At most max_labelled small rows: broadcast, so texts stay where they are.
    learning = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            marks = list(zip(*(batch.column(n).to_pylist() for n in y)))
            for at in range(0, batch.num_rows, 500):
                counts: dict[str, list[float]] = {}
                for text, mark in zip(batch.column("text").slice(at, 500).to_pylist(), marks[at:at + 500]):
                    for f in features(text, word)[0]:
                        held = counts.setdefault(f, [0.0] * (len(y) + 1))
                        held[-1] += 1
                        for i, m in enumerate(mark):
                            held[i] += m
                columns = list(zip(*counts.values())) or [[]] * (len(y) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *[pa.array(c, pa.float64()) for c in columns]],
                                                 names=["feature", *y, "n"])

    schema = "feature string, " + ", ".join(f"{n} double" for n in [*y, "n"])
    totals = learning.agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in y]).first()
    rows = totals["n"]
    if rows:
        counts = learning.mapInArrow(spread, schema).groupBy("feature").agg(*[F.sum(n).alias(n) for n in [*y, "n"]])

        def g(n: str):
            rest = F.lit(float(rows))
            cells = [(F.col(n), F.col("n") * totals[n] / rest), (F.col("n") - F.col(n), F.col("n") * (rows - totals[n]) / rest),
                     (F.lit(totals[n]) - F.col(n), (rest - F.col("n")) * totals[n] / rest),
                     (rest - F.col("n") - (F.lit(totals[n]) - F.col(n)), (rest - F.col("n")) * (rows - totals[n]) / rest)]
            return 2 * reduce(lambda a, b: a + b, [F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0) for o, e in cells])

        strong = counts.where(F.col("n") >= least_docs).select("feature", F.greatest(*[g(n) for n in y], F.lit(0.0)).alias("g"))
        chain.index = {r.feature: i for i, r in enumerate(
            strong.where(F.col("g") > strength).orderBy(F.desc("g"), "feature").limit(max_features).collect())}
    shared = spark.sparkContext.broadcast(chain.index)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, index = re.compile(WORD), shared.value
        for batch in batches:
            folds, chosen, figures = [], [], []
            for text, marks in zip(batch.column("text"), zip(*(batch.column(n).to_pylist() for n in y))):
                found, shape = features(text.as_py(), word)
                folds.append(zlib.crc32((text.as_py() or "").encode("utf-8", "replace")) % FOLDS)
                chosen.append(np.sort(np.array([i for f in found if (i := index.get(f)) is not None], np.int32)).tobytes())
                figures.append(np.array([*shape, *marks]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("pick"), pa.array(folds, pa.int32()), pa.array(chosen, pa.binary()), pa.array(figures, pa.binary())],
                                             names=["pick", "fold", "chosen", "figures"])

    # One packed row per learning document; documents with one id may bring in more than the
    # bound, so it is asked for once more.
    picked = learning.withColumn("pick", F.xxhash64("id", "text"))
    rows = (picked.mapInArrow(reduce_rows, "pick long, fold int, chosen binary, figures binary").orderBy("pick", "chosen", "figures")
            .limit(max_labelled).select("fold", "chosen", "figures").toArrow())
    if not rows.num_rows:
        chain.weights = [np.zeros(LOOKS + j + len(chain.index)) for j in range(len(y))]
        chain.bias = [-50.0] * len(y)
        return chain
    figures = np.frombuffer(b"".join(rows.column("figures").to_pylist()), np.float64).reshape(rows.num_rows, -1)
    sizes = pc.binary_length(rows.column("chosen")).to_numpy() // 4
    cols = np.frombuffer(b"".join(rows.column("chosen").to_pylist()), np.int32)
    fold, dense, targets = rows.column("fold").to_numpy(), figures[:, :LOOKS], figures[:, LOOKS:]
    chain.mean, chain.scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
    dense = (dense - chain.mean) / chain.scale
    del rows, figures
    for j in range(len(y)):
        weights, bias, odds = _fit_in_tasks(spark, dense, sizes, cols, fold, len(chain.index), targets[:, j], j + 1 < len(y))
        chain.weights.append(weights)
        chain.bias.append(bias)
        dense = np.hstack([dense, squash(odds)[:, None]])
    return chain


def _fit_in_tasks(spark, dense: np.ndarray, sizes: np.ndarray, cols: np.ndarray, fold: np.ndarray, width: int, y: np.ndarray, folds: bool) -> tuple[np.ndarray, float, np.ndarray]:
    """The model on all rows, and if asked for every row's log-odds from a model that hasn't seen its fold.

    One task a fit. What is broadcast is bounded by ``max_labelled`` and the features of a text; only weights and odds return.
    """
    shared = spark.sparkContext.broadcast((dense, sizes, cols, fold, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                dense, sizes, cols, fold, y = shared.value
                inside = fold != k
                if not inside.any() or k < FOLDS and inside.all():
                    continue
                own = np.repeat(inside, sizes)
                rows = np.repeat(np.arange(inside.sum()), sizes[inside])
                w, b = fit_logistic(dense[inside], rows, cols[own], width, y[inside])
                d = dense.shape[1]
                rest = np.repeat(np.arange((~inside).sum()), sizes[~inside])
                z = dense[~inside] @ w[:d] + np.bincount(rest, w[d:][cols[~own]], (~inside).sum()) + b
                yield pa.record_batch({"k": pa.array([k]), "weights": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([b]), "odds": pa.array([z.tobytes()], pa.binary())})

    first = 0 if folds else FOLDS
    got = {r.k: r for r in spark.range(first, FOLDS + 1, 1, FOLDS + 1 - first).mapInArrow(run, "k long, weights binary, bias double, odds binary").collect()}
    shared.unpersist()
    odds = np.zeros(len(y))
    for k in range(FOLDS):
        if k in got:
            odds[fold == k] = np.frombuffer(got[k].odds)
    return np.frombuffer(got[FOLDS].weights), got[FOLDS].bias, odds


def predict(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with one probability per category."""
    out = [prefix + c for c in chain.categories]
    carried = list(carry if carry is not None else [c for c in docs.columns if c not in out])
    names = [f"c{i}" for i in range(len(carried))]
    frame = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in zip(carried, names)])
    shared = docs.sparkSession.sparkContext.broadcast(vars(chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, word = Chain(**shared.value), re.compile(WORD)
        for batch in batches:
            scores = [model.score(*features(t.as_py(), word)) for t in batch.column(0)]
            columns = list(zip(*scores)) or [[]] * len(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, pa.float64()) for c in columns]], names=[*names, *out])

    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(carried, names))
    return frame.mapInArrow(run, kinds + ", ".join(f"`{o}` double" for o in out)).toDF(*carried, *out)
