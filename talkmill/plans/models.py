"""Catalogue of classifiers over text features, and scoring of rows with a fitted one."""

from __future__ import annotations

import inspect
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.columns import bind, literal_array
from talkmill.functions.numbers import array_sum, softmax
from talkmill.operators.split import k_folds
from talkmill.plans import linear
from talkmill.plans.features import ClassIndex, ClassIndexModel, KeywordFlags, TermVectors, WordList
from talkmill.plans.saved import Saved
from talkmill.plans.tree import SparseTree

FEATURES = {"featuresCol": "features", "labelCol": "label_idx"}
WEIGHTED = {**FEATURES, "weightCol": "weight"}


class LinearSvm(Estimator):
    """One linear SVM per class, balanced, all fitted in the same passes; margins of all classes come from one product."""

    def __init__(self, c: float = 1.0, max_iter: int = 100, classes: int | None = None):
        super().__init__()
        self.c, self.max_iter, self.classes = c, max_iter, classes

    def copy(self, extra=None):
        return LinearSvm(self.c, self.max_iter, self.classes)

    def _fit(self, df: DataFrame) -> "LinearSvmModel":
        packed, width = linear.blocks(df)
        try:
            classes = self.classes or linear.top_label(packed) + 1
            problems = [linear.Problem(i, 0, self.c) for i in lines_of(classes)]
            return LinearSvmModel(linear.solve(packed, width, problems, self.max_iter))
        finally:
            packed.unpersist()


def lines_of(classes: int) -> list[int]:
    """Classes that have a line: with two, the line of the second tells both apart."""
    return list(range(classes)) if classes > 2 else [classes - 1]


def _margins(df: DataFrame, lines: np.ndarray):
    """Margins of all lines, one product per batch; the lines are as many numbers as the model has."""
    shared = df.sparkSession.sparkContext.broadcast(lines)

    def product(vectors: pd.DataFrame) -> pd.Series:
        places = [p if k == 0 else np.arange(len(v)) for k, p, v in zip(vectors["type"], vectors["indices"], vectors["values"])]
        return pd.Series(list(linear.Rows.of(places, list(vectors["values"])).times(shared.value)))

    return F.pandas_udf(product, "array<double>")("features")


class LinearSvmModel(Model, Saved):
    """Adds ``margins``, ``probability`` (softmax of the margins) and ``prediction``."""

    def __init__(self, lines: np.ndarray):
        super().__init__()
        self.lines = np.asarray(lines, float)

    def _state(self) -> dict:
        return {"lines": self.lines.tolist()}

    def copy(self, extra=None):
        return LinearSvmModel(self.lines)

    def margins(self, df: DataFrame, out: str = "margins") -> DataFrame:
        found = _margins(df, self.lines)
        if len(self.lines) > 1:
            return df.withColumn(out, found)
        one = F.element_at(F.col("__one"), 1)
        return df.withColumn("__one", found).withColumn(out, F.array(-one, one)).drop("__one")

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = self.margins(df).withColumn("probability", softmax("margins"))
        best = F.array_position("margins", F.array_max("margins")) - 1
        return scored.withColumn("prediction", best.cast("double"))


class LinesModel(LinearSvmModel):
    """Classes whose scores are lines of the features, one line each, however many classes there are."""

    def copy(self, extra=None):
        return LinesModel(self.lines)

    def margins(self, df: DataFrame, out: str = "margins") -> DataFrame:
        return df.withColumn(out, _margins(df, self.lines))


class CalibratedSvm(Estimator):
    """Linear SVM whose margins are turned into probabilities by a sigmoid per class and fold.

    Each of the folds fits the SVM on the other folds and the sigmoids on its own margins. The
    probabilities are scaled to sum 1 per fold and averaged.
    """

    def __init__(self, c: float = 1.0, folds: int = 3, max_iter: int = 100, text: str = "text", row_id: str = "row_id"):
        super().__init__()
        self.c, self.folds, self.max_iter, self.text, self.row_id = c, folds, max_iter, text, row_id

    def copy(self, extra=None):
        return CalibratedSvm(self.c, self.folds, self.max_iter, self.text, self.row_id)

    def _fit(self, df: DataFrame) -> "CalibratedSvmModel":
        dealt = k_folds(df, "label_idx", self.folds, self.text, self.row_id)
        packed, width = linear.blocks(dealt, fold="fold")
        try:
            # All folds have the classes of the whole table, also those that one of them lacks.
            classes = max(linear.top_label(packed) + 1, 2)
            own = lines_of(classes)
            problems = [linear.Problem(i, f, self.c) for f in range(1, self.folds + 1) for i in own]
            lines = linear.solve(packed, width, problems, self.max_iter)
            held = linear.held_margins(packed, problems, lines, classes).persist(StorageLevel.MEMORY_AND_DISK)
            curves = _sigmoids(held, classes, self.folds)
            held.unpersist()
        finally:
            packed.unpersist()
        parts = lines.reshape(self.folds, len(own), width + 1)
        return CalibratedSvmModel([(LinearSvmModel(part), curve) for part, curve in zip(parts, curves)])


def _sigmoids(held: DataFrame, classes: int, folds: int, rounds: int = 50) -> list[list[tuple[float, float]]]:
    """Slope and shift of the probability of each class given its margin, for every fold.

    Newton steps on the log loss with smoothed targets, as Platt scaling has them. One pass per
    step sums loss, gradient and curvature of all folds and classes; only those sums reach the driver.
    """

    def by_fold(*columns) -> np.ndarray:
        found = held.groupBy("fold").agg(*[c.alias(f"s{n}") for n, c in enumerate(columns)]).collect()  # one row per fold
        out = np.zeros((folds, len(columns)))
        for r in found:
            out[r["fold"] - 1] = r[1:]
        return out

    counts = by_fold(F.count("*"), *[F.count_if(F.col("label_idx") == i) for i in range(classes)])
    total, yes = counts[:, :1], counts[:, 1:]
    no = total - yes
    high, low = (yes + 1) / (yes + 2), 1 / (no + 2)
    place = F.col("fold") - 1

    def sums(slope, shift):
        out = []
        for i in range(classes):
            mine = lambda values: F.get(F.lit(values[:, i].tolist()), place)  # noqa: E731, B023
            m = F.get("margins", F.lit(i))
            z = m * mine(slope) + mine(shift)
            t = F.when(F.col("label_idx") == i, mine(high)).otherwise(mine(low))
            p = 1 / (1 + F.exp(-z))
            loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - t * z
            off, bend = p - t, p * (1 - p)
            out += [loss, off * m, off, bend * m * m, bend * m, bend]
        return by_fold(*[F.sum(c) for c in out]).reshape(folds, classes, 6)

    slope, shift = np.zeros((folds, classes)), np.log((yes + 1) / (no + 1))
    best, step = sums(slope, shift), np.ones((folds, classes))
    for _ in range(rounds):
        _, gm, g, hmm, hm, h = np.moveaxis(best, -1, 0)
        hmm, h = hmm + 1e-12, h + 1e-12
        scale = hmm * h - hm * hm
        move_a, move_b = (h * gm - hm * g) / scale, (hmm * g - hm * gm) / scale
        tried = sums(slope - step * move_a, shift - step * move_b)
        good = tried[..., 0] <= best[..., 0] + 1e-12 * total
        slope = np.where(good, slope - step * move_a, slope)
        shift = np.where(good, shift - step * move_b, shift)
        gain = np.where(good, best[..., 0] - tried[..., 0], np.inf)
        best = np.where(good[..., None], tried, best)
        step = np.where(good, 1.0, step / 2)
        if np.all((gain < 1e-7 * total) | (step < 1e-6)):
            break
    return [list(zip(a.tolist(), b.tolist())) for a, b in zip(slope, shift)]


class CalibratedSvmModel(Model, Saved):
    def __init__(self, members):
        super().__init__()
        self.members = members

    def _state(self) -> dict:
        return {"curves": [curves for _, curves in self.members]}

    def _parts(self) -> list:
        return [svm for svm, _ in self.members]

    @classmethod
    def _rebuilt(cls, state, parts):
        return cls([(svm, [tuple(c) for c in curves]) for svm, curves in zip(parts, state["curves"])])

    def copy(self, extra=None):
        return CalibratedSvmModel(self.members)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Margins of all folds from one product, then sigmoids, scaled to sum 1 per fold, and their mean."""
        lines = np.concatenate([svm.lines for svm, _ in self.members])
        classes, folds = len(self.members[0][1]), len(self.members)
        own = len(lines) // folds
        out = df.withColumn("__m", _margins(df, lines))

        def probabilities(f: int, curves) -> Column:
            raw = []
            for i, (a, b) in enumerate(curves):
                m = F.get("__m", F.lit(f * own + (i if own == classes else 0)))
                z = (m if own == classes or i else -m) * float(a) + float(b)
                raw.append(1 / (1 + F.exp(-z)))
            return bind(F.array(*raw), lambda p: bind(array_sum(p), lambda total: F.transform(p, lambda x: x / total)))

        parts = [f"__p{f}" for f in range(folds)]
        out = out.withColumns({p: probabilities(f, c) for f, (p, (_, c)) in enumerate(zip(parts, self.members))})
        mean = [sum((F.get(p, F.lit(i)) for p in parts), F.lit(0.0)) / folds for i in range(classes)]
        out = out.withColumn("probability", F.array(*mean))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("prediction", best.cast("double")).drop("__m", *parts)


class OneAgainstRest(Estimator):
    """One binary tree model per class; all of them score a row in the JVM."""

    def __init__(self, base):
        super().__init__()
        self.base = base

    def copy(self, extra=None):
        return OneAgainstRest(self.base)

    def _fit(self, df: DataFrame) -> "OneAgainstRestModel":
        rows = df.select("features", "label_idx").persist(StorageLevel.MEMORY_AND_DISK)
        base = self.base
        settings = {base.featuresCol: "features", base.labelCol: "__is"}
        try:
            classes = int(rows.agg(F.max("label_idx")).first()[0]) + 1
            fitted = [
                base.fit(rows.withColumn("__is", (F.col("label_idx") == i).cast("double")), settings)
                for i in range(classes)
            ]
        finally:
            rows.unpersist()
        return OneAgainstRestModel(fitted)


class OneAgainstRestModel(Model, Saved):
    def __init__(self, members):
        super().__init__()
        self.members = members

    def _parts(self) -> list:
        return self.members

    @classmethod
    def _rebuilt(cls, state, parts):
        return cls(parts)

    def copy(self, extra=None):
        return OneAgainstRestModel(self.members)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.members):
            names = {m.predictionCol: "__p", m.probabilityCol: "__q", m.rawPredictionCol: "__raw"}
            scored = m.transform(out, names)
            out = scored.withColumn(f"__m{i}", F.get(vector_to_array("__raw"), F.lit(1)))
            out = out.drop("__p", "__q", "__raw")
        marks = [f"__m{i}" for i in range(len(self.members))]
        out = out.withColumn("margins", F.array(*marks)).drop(*marks)
        best = F.array_position("margins", F.array_max("margins")) - 1
        return out.withColumn("probability", softmax("margins")).withColumn(
            "prediction", best.cast("double")
        )


@dataclass(frozen=True)
class Spec:
    """A named pipeline: features, classifier and their options."""

    features: str  # counts, tfidf, tfidf+keywords, word2vec
    classifier: str
    high: int = 1
    max_features: int = 15_000
    min_df: int = 1
    options: dict = field(default_factory=dict)

    @property
    def calibrated(self) -> bool:
        return self.classifier == "calibrated_svm"


_TFIDF, _NGRAM = {"high": 2}, {"high": 3, "max_features": 20_000}
BASELINES: dict[str, Spec] = {
    "BoW + LogReg": Spec("counts", "logreg"),
    "BoW + SVM": Spec("counts", "svm"),
    "BoW + NaiveBayes": Spec("counts", "multinomial_nb"),
    "BoW + RandomForest": Spec("counts", "random_forest"),
    "BoW + DecisionTree": Spec("counts", "decision_tree"),
    "TF-IDF + LogReg": Spec("tfidf", "logreg", **_TFIDF),
    "TF-IDF + SVM": Spec("tfidf", "calibrated_svm", **_TFIDF),
    "TF-IDF + NaiveBayes": Spec("tfidf", "complement_nb", **_TFIDF),
    "TF-IDF + RandomForest": Spec("tfidf", "random_forest", **_TFIDF),
    "TF-IDF + DecisionTree": Spec("tfidf", "decision_tree", **_TFIDF),
    "N-gram(1-3) + SVM": Spec("tfidf", "calibrated_svm", **_NGRAM),
    "N-gram(1-3) + LogReg": Spec("tfidf", "logreg", **_NGRAM),
    "N-gram(1-3) + DecisionTree": Spec("tfidf", "decision_tree", **_NGRAM),
}
LEGACY: dict[str, Spec] = {
    "Legacy TF-IDF + SVM": Spec("tfidf", "svm", **_TFIDF),
    "Legacy TF-IDF + Keywords + SVM": Spec("tfidf+keywords", "svm", **_TFIDF),
    "Legacy TF-IDF + RandomForest": Spec("tfidf", "random_forest", **_TFIDF),
    "Legacy TF-IDF + KNN": Spec("tfidf", "knn", **_TFIDF),
}
EMBEDDINGS: dict[str, Spec] = {
    "Word2Vec + LogReg": Spec("word2vec", "logreg"),
}
VOTERS: dict[str, Spec] = {
    "TF-IDF + SVM": Spec("tfidf", "calibrated_svm", **_TFIDF),
    "TF-IDF + RandomForest": Spec("tfidf", "random_forest", **_TFIDF),
    "TF-IDF + BoostedTrees": Spec("tfidf", "boosted_trees", **_TFIDF),
}


def non_calibrated(catalogue: dict[str, Spec] = BASELINES, strict_reference: bool = False) -> dict[str, Spec]:
    """Pipelines without a calibrated classifier.

    ``strict_reference`` looks for the word in the name, which no name has, and removes nothing.
    """
    if strict_reference:
        return {n: s for n, s in catalogue.items() if "Calibrated" not in n}
    return {n: s for n, s in catalogue.items() if not s.calibrated}


def classifier(name: str, **options) -> Estimator:
    """Classifier by name with the catalogue's settings; ``options`` override Spark settings."""
    c = options.pop("C", 1.0)
    if name == "svm":
        return LinearSvm(c, **options)
    if name == "calibrated_svm":
        return CalibratedSvm(c, **options)
    if name == "logreg":
        return LogisticRegression(**{**WEIGHTED, "maxIter": 1000, "standardization": False, **options})
    if name == "multinomial_nb":
        return NaiveBayes(**{**FEATURES, "modelType": "multinomial", "smoothing": 0.1, **options})
    if name == "complement_nb":
        return NaiveBayes(**{**FEATURES, "modelType": "complement", "smoothing": 0.1, **options})
    if name == "random_forest":
        return RandomForestClassifier(**{**WEIGHTED, "numTrees": 200, "maxDepth": 30, "seed": 42, **options})
    if name == "decision_tree":
        # Trees stop at depth 30.
        base = DecisionTreeClassifier(
            **{**WEIGHTED, "maxDepth": 30, "minInstancesPerNode": 2, "seed": 42, **options}
        )
        return SparseTree(base)
    if name == "boosted_trees":
        tree = GBTClassifier(**{"maxIter": 200, "stepSize": 0.1, "maxDepth": 6, "seed": 42, **options})
        return OneAgainstRest(tree)
    if name == "mlp":
        return MultilayerPerceptronClassifier(**{**FEATURES, "maxIter": 500, "seed": 42, **options})
    raise ValueError(f"unknown classifier '{name}'")


class _InverseC(Estimator):
    """Logistic regression whose strength is given as ``C``: ``regParam = 1 / (C * rows)``."""

    def __init__(self, base: LogisticRegression, c: float):
        super().__init__()
        self.base, self.c = base, c

    def copy(self, extra=None):
        return _InverseC(self.base, self.c)

    def _fit(self, df: DataFrame):
        return self.base.copy({self.base.regParam: 1.0 / (self.c * max(df.count(), 1))}).fit(df)


def feature_stages(spec: Spec, text: str = "text") -> list:
    if spec.features == "word2vec":
        vectors = {"vectorSize": 150, "windowSize": 5, "minCount": 1, "maxIter": 15, "seed": 42}
        return [
            WordList(inputCol=text, outputCol="words"),
            Word2Vec(inputCol="words", outputCol="features", **vectors),
        ]
    terms = dict(kind="counts" if spec.features == "counts" else "tfidf", high=spec.high,
                 maxFeatures=spec.max_features, minDF=spec.min_df)
    if spec.features in ("counts", "tfidf"):
        return [TermVectors(inputCol=text, outputCol="features", **terms)]
    if spec.features == "tfidf+keywords":
        return [
            TermVectors(inputCol=text, outputCol="terms", **terms),
            KeywordFlags(inputCol=text, outputCol="keywords"),
            VectorAssembler(inputCols=["terms", "keywords"], outputCol="features"),
        ]
    raise ValueError(f"unknown features '{spec.features}'")


_SPARK = {
    "logreg": LogisticRegression, "multinomial_nb": NaiveBayes, "complement_nb": NaiveBayes,
    "random_forest": RandomForestClassifier, "decision_tree": DecisionTreeClassifier,
    "boosted_trees": GBTClassifier, "mlp": MultilayerPerceptronClassifier,
}


def accepted_options(name: str) -> set[str]:
    """Options that a classifier of the catalogue takes."""
    if name in ("svm", "calibrated_svm"):
        return {"C", "max_iter"} | ({"folds"} if name == "calibrated_svm" else set())
    return set(inspect.signature(_SPARK[name].__init__).parameters) - {"self"} | ({"C"} if name == "logreg" else set())


def own_options(name: str, options: dict) -> dict:
    """Those of a flow's options that one classifier takes; an option that none takes is an error.

    A flow hands the same options to all pipelines of its catalogue. ``maxIter`` is also the SVMs' ``max_iter``.
    """
    known = set().union(*map(accepted_options, [*_SPARK, "calibrated_svm"]))
    unknown = set(options) - known
    if unknown:
        raise ValueError(f"no classifier takes the options {sorted(unknown)}")
    own = {n: v for n, v in options.items() if n in accepted_options(name)}
    if name in ("svm", "calibrated_svm") and "maxIter" in options:
        own.setdefault("max_iter", options["maxIter"])
    return own


def build(spec: Spec, text: str = "text", label: str = "label", row_id: str = "row_id", **options) -> Pipeline:
    """Pipeline of class numbers, features and classifier for a table with text and label."""
    if spec.classifier == "knn":
        raise ValueError("nearest neighbours have no pipeline: use plans.train.knn_predictions")
    merged = {**spec.options, **own_options(spec.classifier, options)}
    if spec.classifier == "calibrated_svm":
        merged |= {"text": text, "row_id": row_id}
    if spec.classifier == "logreg" and "regParam" not in merged:
        c = merged.pop("C", 1.0)
        last = _InverseC(classifier("logreg", **merged), c)
    else:
        last = classifier(spec.classifier, **merged)
    return Pipeline(stages=[ClassIndex(labelCol=label), *feature_stages(spec, text), last])


def class_names(model: PipelineModel) -> list:
    return next(s.names for s in model.stages if isinstance(s, ClassIndexModel))


def _names(model: PipelineModel):
    names = class_names(model)
    kind = {str: "string", int: "bigint", float: "double", bool: "boolean"}[type(names[0])] if names else "string"
    return literal_array(names, kind)


def score_rows(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``y_pred``, ``confidence`` and ``probas`` (in class order) to rows."""
    names = _names(model)
    out = model.transform(df)
    kind = dict(out.dtypes)["probability"]
    array = kind.startswith("array")
    out = out.withColumn("probas", F.col("probability") if array else vector_to_array("probability"))
    return out.select(
        *df.columns,
        F.get(names, F.col("prediction").cast("int")).alias("y_pred"),
        F.array_max("probas").alias("confidence"),
        "probas",
    )


def long_probabilities(model: PipelineModel, df: DataFrame, name: str, row_id: str = "row_id") -> DataFrame:
    """Probabilities ``(row_id, model, label, proba)`` of a fitted pipeline."""
    labels = _names(model)
    cells = F.arrays_zip(labels.alias("label"), F.col("probas").alias("proba"))
    return score_rows(model, df).select(row_id, F.lit(name).alias("model"), F.inline(cells))


def stacker(name: str, inputs: int, classes: int, **options) -> Estimator:
    """Second-level classifier over probability features."""
    if name == "mlp":
        return classifier("mlp", layers=[inputs, 128, 64, classes], **options)
    return _InverseC(classifier("logreg", **{"maxIter": 2000, **options}), 1.0)
