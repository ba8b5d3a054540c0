"""Four classifiers on prepared features, trained and judged on a stable split."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from featloom import constants as K
from featloom.functions.columns import CATEGORICAL, OTHER, class_of, col, nan_to_null
from featloom.operators.deep_tree import DeepTree, fit_deep_tree
from featloom.operators.encode import LevelTable, attach_codes, fit_levels, name_codes
from featloom.operators.kernel import FourierMap, fit_fourier_map
from featloom.operators.knn import Neighbours, fit_vectors
from featloom.operators.metrics import classification_metrics
from featloom.operators.preprocess import FittedPrep, PrepConfig, SlotScale, fit_prep
from featloom.operators.profile import few_values
from featloom.operators.sampling import split
from featloom.session import cut_lineage

# --- fixed values: model defaults ------------------------------------------------
DEFAULTS = {
    K.LOGISTIC: {"maxIter": 1000, "C": 1.0},
    K.KNN: {"k": K.KNN_NEIGHBOURS},
    K.SVM: {"maxIter": 100, "C": 1.0},
    K.TREE: {"maxDepth": 12, "maxBins": 256, "impurity": "gini", "seed": K.SEED},
}


def estimator(name: str, n_rows: int, n_classes: int, **params):
    """Spark ML estimator for a model name; ``params`` override the defaults.

    Logistic regression and SVM take the inverse strength ``C`` on the summed
    loss; Spark regularises the mean loss, hence ``regParam = 1/(C·n)``. The SVM
    is linear (one against the rest for several classes), the tree bins its
    splits and is limited in depth.
    """
    if name not in DEFAULTS:
        raise ValueError(f"unknown model: {name!r}; use one of {K.MODELS}")
    settings = {**DEFAULTS[name], **params}
    if "C" in settings:
        settings.setdefault("regParam", 1.0 / (settings.pop("C") * max(n_rows, 1)))
    if name == K.LOGISTIC:
        return LogisticRegression(elasticNetParam=0.0, standardization=False, **settings)
    if name == K.TREE:
        return DecisionTreeClassifier(**settings)
    if name == K.SVM:
        svm = LinearSVC(standardization=False, **settings)
        return svm if n_classes == 2 else OneVsRest(classifier=svm, parallelism=min(n_classes, 8))
    raise ValueError("KNN has no estimator; it is fitted by fit_knn")


def check_kind(df: DataFrame, target: str) -> None:
    """``ValueError`` unless the target may hold classes."""
    kind = df.schema[target].dataType
    if class_of(kind) == OTHER and not isinstance(kind, T.BooleanType):
        raise ValueError(f"Target column {target} holds neither numbers, text nor truth values.")
    if isinstance(kind, T.FractionalType) and nan_to_null(df).where(col(target) % 1 != 0).limit(1).count():
        raise ValueError(K.CONTINUOUS_TARGET_ERROR)


def check_target(df: DataFrame, target: str, max_classes: int | None = None) -> list:
    """Sorted classes of a valid target; ``ValueError`` otherwise, or beyond ``max_classes`` if given."""
    check_kind(df, target)
    classes = few_values(nan_to_null(df), target, max_classes)
    if classes is None:
        raise ValueError(f"Target has more than {max_classes} classes.")
    if len(classes) < 2:
        raise ValueError(K.SINGLE_CLASS_ERROR)
    return classes


@dataclass(frozen=True)
class ClassDictionary:
    """Classes of a target as data: any number of them, none in the driver but for a small level table.

    Numbers and truth values are their own labels. Text gets the rank of its level, looked up by
    broadcast or, beyond that, in a join that answers hot levels by broadcast. Both keep the classes' order.
    """

    target: str
    kind: T.DataType
    levels: LevelTable | None  # of a text target

    def attach(self, df: DataFrame, out: str = "label") -> DataFrame:
        """``out``: the label of each row as a double; null for a class not seen in fit."""
        if self.levels is None:
            return df.withColumn(out, col(self.target).cast("double"))
        coded = attach_codes(df, self.target, self.levels, "__label", missing=None, on_unseen="null")
        return coded.withColumn(out, F.col("__label").cast("double")).drop("__label")

    def name(self, df: DataFrame, prediction: str, out: str) -> DataFrame:
        """``out``: the class of each predicted label."""
        if self.levels is None:
            return df.withColumn(out, col(prediction).cast(self.kind))
        return name_codes(df, col(prediction).cast("bigint"), self.levels, out)


def class_dictionary(df: DataFrame, target: str) -> ClassDictionary:
    check_kind(df, target)
    kind = df.schema[target].dataType
    present = nan_to_null(df).where(col(target).isNotNull())
    if present.select(target).distinct().limit(2).count() < 2:
        raise ValueError(K.SINGLE_CLASS_ERROR)
    levels = fit_levels(present, [target])[target] if class_of(kind) == CATEGORICAL else None
    return ClassDictionary(target, kind, levels)


def label_column(target: str, classes: list) -> Column:
    """Class index as a nominal ML column, so that no fit has to count classes."""
    lookup = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, float(i))])
    meta = {"ml_attr": {"type": "nominal", "name": "label", "vals": [str(c) for c in classes]}}
    return F.try_element_at(lookup, col(target)).alias("label", metadata=meta)


def assemble(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """One ``features`` vector; columns are renamed first so any name works."""
    names = [f"f{i}" for i in range(len(features))]
    renamed = df.select(*[col(k) for k in keep], *[col(f).alias(n) for f, n in zip(features, names)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(renamed).drop(*names)


@dataclass(frozen=True)
class Slot:
    """One number of the assembled vector: a column, or a level of a one-hot vector."""

    name: str
    index: int
    column: str  # prepared column
    place: int | None = None  # inside the column's vector


@dataclass
class TrainedModel:
    name: str
    target: str
    classes: list | ClassDictionary
    features: list[str]
    model: object
    prep: FittedPrep | None = None
    projection: FourierMap | None = None

    def score(self, prepared: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Add ``prediction`` (class index) and ``score`` to prepared rows.

        ``score`` is P(second class) for two classes, the largest probability
        for more, and the predicted class as a number for the SVM.
        """
        return self.score_vectors(assemble(prepared, self.features, keep), keep)

    def score_vectors(self, rows: DataFrame, keep: list[str] = ()) -> DataFrame:
        """``score`` of rows that hold the assembled ``features``."""
        keep_cols = [col(k) for k in keep]
        if isinstance(self.model, Neighbours):
            queries = cut_lineage(self.model.queries_of(rows, "features").withColumn("qid", F.monotonically_increasing_id()))
            votes = self.model.vote(queries.select("qid", "x", *([] if self.model.plain is None else ["si", "sv"])))
            joined = queries.join(votes, "qid")
            total = F.aggregate(F.map_values("votes"), F.lit(0).cast("bigint"), lambda a, v: a + v)
            share = F.array_max(F.map_values("votes"))
            if isinstance(self.classes, list) and len(self.classes) == 2:
                share = F.coalesce(F.try_element_at("votes", F.lit(1.0)), F.lit(0))
            return joined.select(*keep_cols, "prediction", (share / total).alias("score"))
        if isinstance(self.model, DeepTree):
            found = self.model.transform(rows, list(keep))
            return found.select(*keep_cols, "prediction", F.col("second" if len(self.classes) == 2 else "top").alias("score"))
        scored = self.model.transform(self.projection.apply(rows) if self.projection else rows)
        if "probability" in scored.columns:
            p = vector_to_array("probability")
            score = p[1] if len(self.classes) == 2 else F.array_max(p)
        else:
            score = self._class_number()
        return scored.select(*keep_cols, "prediction", score.alias("score"))

    def scale_of(self, column: str) -> SlotScale | None:
        return self.prep.slot_scales.get(column) if self.prep else None

    def starts(self) -> dict[str, int]:
        """Where each prepared column begins in the assembled vector."""
        sizes = [scale.slots.size if (scale := self.scale_of(c)) else 1 for c in self.features]
        return dict(zip(self.features, [sum(sizes[:i]) for i in range(len(sizes))]))

    def plain_places(self) -> list[int] | None:
        """Places of the assembled vector that are no one-hot slots; None if it holds vectors of another kind or no slots."""
        if not any(self.scale_of(c) for c in self.features):
            return None
        return [start for c, start in self.starts().items() if not self.scale_of(c)]

    @property
    def width(self) -> int:
        return sum(scale.slots.size if (scale := self.scale_of(c)) else 1 for c in self.features)

    def slot_names(self, indices: list[int]) -> dict[int, str]:
        """Names of places in the assembled vector; levels that were not fetched are looked up."""
        out = {}
        for c, start in self.starts().items():
            scale = self.scale_of(c)
            size = scale.slots.size if scale else 1
            own = [i - start for i in indices if start <= i < start + size]
            out |= {start + i: n for i, n in scale.slots.name_of(own).items()} if scale and own else {start: c for _ in own}
        return out

    def find_slots(self, name: str) -> list[Slot]:
        """The column or slot of that name, else all children of the feature ``name``: the slots or
        indicator columns of its levels, else every prepared column with the name in its own."""
        starts = self.starts()
        scales = {c: scale for c in self.features if (scale := self.scale_of(c))}
        if name in starts and name not in scales:
            return [Slot(name, starts[name], name)]
        for c, scale in scales.items():
            if (place := scale.slots.slot_named(name)) is not None:
                return [Slot(name, starts[c] + place, c, place)]
        for c, scale in scales.items():
            if name in (c, scale.slots.column):
                named = scale.slots.name_of(list(range(scale.slots.size)))
                return [Slot(named[i], starts[c] + i, c, i) for i in range(scale.slots.size)]
        table = self.prep.encoder.tables.get(name) if self.prep else None
        own = {f"{name}_{level}" for level, *_ in table.rows} | {f"{name}_nan_missing"} if table and table.rows else set()
        children = [c for c in self.features if c in own] or [c for c in self.features if name in c and c not in scales]
        return [Slot(c, starts[c], c) for c in children]

    def _class_number(self) -> Column:
        if all(isinstance(c, (int, float)) for c in self.classes):
            return F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]), (F.col("prediction") + 1).cast("int"))
        return F.col("prediction")

    def predict(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Raw rows in, predicted class values out (fitted preparation applied)."""
        prepared = self.prep.apply(df) if self.prep else df
        if isinstance(self.classes, ClassDictionary):
            return self.classes.name(self.score(prepared, keep), "prediction", "predicted_class")
        classes = F.array(*[F.lit(c) for c in self.classes])
        return self.score(prepared, keep).withColumn(
            "predicted_class", F.element_at(classes, (F.col("prediction") + 1).cast("int"))
        )


def fit_model(
    prepared: DataFrame, name: str, target: str, classes: list, features: list[str],
    prep: FittedPrep | None = None, **params,
) -> TrainedModel:
    """Fit on prepared rows (which still hold the raw target column).

    The SVM takes ``kernel="rbf"``: a linear SVM on random Fourier features. The tree takes
    ``maxDepth=None``: grown until its leaves are pure. Nearest neighbours also take a
    ``ClassDictionary`` for ``classes``.
    """
    if isinstance(classes, ClassDictionary) and name != K.KNN:
        raise ValueError(f"{name} needs its classes listed")
    data = assemble(with_labels(prepared, target, classes), features, ["label"])
    if name == K.KNN:
        k = params.get("k", DEFAULTS[K.KNN]["k"])
        fitted = TrainedModel(name, target, classes, features, None, prep)
        fitted.model = fit_vectors(data, "features", F.col("label"), fitted.plain_places(), k)
        return fitted
    if name == K.TREE and params.get("maxDepth", 0) is None:
        settings = {k: v for k, v in {**DEFAULTS[name], **params}.items() if k != "maxDepth"}
        return TrainedModel(name, target, classes, features, fit_deep_tree(data, **settings), prep)
    kernel, projection = params.pop("kernel", "linear"), None
    if kernel not in ("linear", "rbf") or (kernel == "rbf" and name != K.SVM):
        raise ValueError(f"{name} has no kernel {kernel!r}")
    if kernel == "rbf":
        projection = fit_fourier_map(data)
        data = projection.apply(data)  # made for the summary and again for the blocks: cheaper than storing wide rows beside the blocks
    # The estimators keep their own input blocks in memory or on disk while they iterate.
    model = estimator(name, prepared.count(), len(classes), **params).fit(data)
    return TrainedModel(name, target, classes, features, model, prep, projection)


def with_labels(prepared: DataFrame, target: str, classes: list | ClassDictionary) -> DataFrame:
    if isinstance(classes, ClassDictionary):
        return classes.attach(prepared)
    return prepared.withColumn("label", label_column(target, classes))


def usable_features(prepared: DataFrame, prep: FittedPrep) -> list[str]:
    """Prepared feature columns, in fit order, that hold numbers or vectors."""
    kinds = {f.name: f.dataType for f in prepared.schema.fields}
    return [c for c in prep.features if c in kinds and (kinds[c].typeName() != "string" or isinstance(kinds[c], VectorUDT))]


@dataclass
class Experiment:
    """A target, a split and a fitted preparation shared by several models."""

    target: str
    classes: list | ClassDictionary
    prep: FittedPrep
    features: list[str]
    train: DataFrame
    test: DataFrame

    def slot_counts(self) -> tuple[dict[str, np.ndarray], int]:
        """Rows of the training side per slot of each one-hot vector, and all of them; known from the fit."""
        scales = self.prep.slot_scales
        return {c: s.slots.counts for c, s in scales.items()}, next((s.slots.rows for s in scales.values()), 0)

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def prepare_experiment(
    df: DataFrame, target: str, config: PrepConfig, keys: list[str],
    test_share: float = K.TEST_SHARE, features: list[str] | None = None, list_classes: bool = True,
) -> Experiment:
    """Drop rows without target, check it, split, fit the preparation on train.

    Without ``list_classes`` more than two classes stay a ``ClassDictionary``, enough for nearest neighbours.

    ``keys`` name the row for the split and are not features. The two prepared
    sides are persisted: every fit reuses them, and a lost block is recomputed
    from the source.
    """
    df = nan_to_null(df).where(col(target).isNotNull())
    few = list_classes or df.select(col(target)).distinct().limit(3).count() <= 2
    classes = check_target(df, target) if few else class_dictionary(df, target)
    features = features or [c for c in df.columns if c not in keys and c != target]
    train, test = split(df, keys, test_share)
    prep = fit_prep(train, target, config, features)
    used = [*prep.imputer.columns, *prep.encoder.tables]
    order = [c for c in df.columns if c in used]
    sides = [
        prep.apply(side.select(*[col(c) for c in order], col(target))).persist() for side in (train, test)
    ]
    return Experiment(target, classes, prep, usable_features(sides[0], prep), *sides)


def evaluate(model: TrainedModel, prepared: DataFrame) -> DataFrame:
    """``accuracy, f1_score`` of a model on prepared rows."""
    labelled = with_labels(prepared, model.target, model.classes)
    return classification_metrics(model.score(labelled, ["label"]), "label", "prediction")


@dataclass
class TrainResult:
    metrics: DataFrame  # model, accuracy, f1_score
    model: TrainedModel


def train_evaluate(
    df: DataFrame, target: str, model: str, config: PrepConfig = PrepConfig(), keys: list[str] = (),
    test_share: float = K.TEST_SHARE, features: list[str] | None = None, **params,
) -> TrainResult:
    """Split, prepare, fit, predict, judge; metrics as a one-row DataFrame."""
    setup = prepare_experiment(df, target, config, list(keys), test_share, features, list_classes=model != K.KNN)
    try:
        fitted = fit_model(setup.train, model, target, setup.classes, setup.features, setup.prep, **params)
        row = evaluate(fitted, setup.test).first()
    finally:
        setup.release()
    metrics = df.sparkSession.createDataFrame(
        [(model, row["accuracy"], row["f1_score"])], "model string, accuracy double, f1_score double"
    )
    return TrainResult(metrics, fitted)


def importance(trained: TrainedModel) -> list[tuple[str, float]]:
    """(feature, importance) in feature order, every level of a one-hot feature by its name; empty where a model has none."""
    model = trained.model
    if isinstance(model, (Neighbours, DeepTree)) or trained.projection:
        return []
    if isinstance(model, OneVsRestModel):
        rows = [m.coefficients.toArray() for m in model.models]
    elif trained.name == K.TREE:
        rows = [model.featureImportances.toArray()]
    elif trained.name == K.LOGISTIC:
        rows = list(model.coefficientMatrix.toArray())
    else:
        rows = [model.coefficients.toArray()]
    means = np.mean(np.abs(np.array(rows)), axis=0)
    names = trained.slot_names(list(range(len(means))))
    return [(names[i], float(v)) for i, v in enumerate(means)]


def importance_ranking(spark, trained: TrainedModel, top_n: int = K.TOP_IMPORTANCE) -> DataFrame:
    """Top features by mean |coefficient| or tree importance; ``top_n`` is what the ranking is asked for."""
    table = spark.createDataFrame(importance(trained), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top_n)
