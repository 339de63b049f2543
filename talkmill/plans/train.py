"""Training flows: hold-out, cross-validation, stacking, bagging, grid search and length sweep.

Each fit is a distributed job; the loops here run over models, folds and settings, never rows.
"""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.columns import literal_array
from talkmill.functions.text import truncate_tokens
from talkmill.operators.ensemble import all_votes, check_stacker, meta_features, stacker_metadata, vote
from talkmill.operators.labels import only_known_labels
from talkmill.operators.metrics import fold_scores, summary
from talkmill.operators.neighbours import nearest, vote_of_neighbours
from talkmill.operators.report import best_per_model
from talkmill.operators.split import bag_weights, bootstrap, k_folds
from talkmill.plans import bayes, linear
from talkmill.plans.features import TermVectors
from talkmill.plans.models import Spec, build, feature_stages, lines_of, long_probabilities, score_rows, stacker
from talkmill.session import distinct_values, checkpointed


PARALLEL_FOLDS = 2  # of a grid search; each has its blocks of rows on the disk
GRID_TOLERANCE = 1e-3  # of a grid search's solver: settings are compared by labels, not by weights


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def train_and_score(
    train: DataFrame,
    test: DataFrame,
    catalogue: Mapping[str, Spec],
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
    **options,
) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame]:
    """Fit every pipeline, score the test rows.

    Returns the models, predictions ``(model, row_id, y_true, y_pred, confidence)`` of test rows
    whose label occurs in training, and one metrics row per model with its training seconds.
    """
    known = only_known_labels(test, train, label)
    models, scored, seconds = {}, [], []
    for name, spec in catalogue.items():
        begin = time.perf_counter()
        models[name] = build(spec, text, label, row_id, **options).fit(train)
        seconds.append((name, round(time.perf_counter() - begin, 1)))
        rows = score_rows(models[name], known)
        scored.append(
            rows.select(
                F.lit(name).alias("model"), row_id, F.col(label).alias("y_true"), "y_pred", "confidence"
            )
        )
    predictions = _union(scored)
    times = train.sparkSession.createDataFrame(seconds, "model string, train_sec double")
    # ``times`` has one row per pipeline of the catalogue.
    return models, predictions, summary(predictions, ["model"]).join(F.broadcast(times), "model")


def out_of_fold(
    folds: DataFrame,
    catalogue: Mapping[str, Spec],
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
    **options,
) -> DataFrame:
    """Probabilities ``(row_id, model, label, proba)`` of each row from models that did not see it.

    ``folds`` has a ``fold`` column. The result is written to the checkpoint folder, because
    votes, stackers and scores all read it.
    """
    parts = []
    for f in distinct_values(folds, "fold"):
        train, held = folds.where(F.col("fold") != f), folds.where(F.col("fold") == f)
        for name, spec in catalogue.items():
            model = build(spec, text, label, row_id, **options).fit(train)
            parts.append(long_probabilities(model, held, name, row_id))
    return checkpointed(_union(parts))


def cross_validate(probs: DataFrame, folds: DataFrame, label: str = "label", row_id: str = "row_id",
                   methods: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold metrics of base models and votes, and mean and deviation over folds."""
    truth = folds.select(F.col(row_id).alias("row_id"), F.col(label).alias("y_true"), "fold")
    scored = all_votes(probs, methods).join(truth, "row_id")
    return summary(scored, ["model", "method"]), fold_scores(scored, ["model", "method"])


def voting_ensemble(
    train: DataFrame,
    test: DataFrame,
    catalogue: Mapping[str, Spec],
    k: int = 0,
    method: str = "soft",
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
    **options,
) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame | None]:
    """Base models and their vote: metrics on the test rows, and over ``k`` folds if asked for."""
    known = only_known_labels(test, train, label)
    models = {n: build(s, text, label, row_id, **options).fit(train) for n, s in catalogue.items()}
    probs = _union([long_probabilities(m, known, n, row_id) for n, m in models.items()])
    probs = checkpointed(probs.withColumnRenamed(row_id, "row_id"))
    truth = known.select(F.col(row_id).alias("row_id"), F.col(label).alias("y_true"))
    quality = summary(all_votes(probs, [method]).join(truth, "row_id"), ["model", "method"])
    if k < 2:
        return models, quality, None
    folds = checkpointed(k_folds(train, label, k, text, row_id))
    held = out_of_fold(folds, catalogue, text, label, row_id, **options)
    _, spread = cross_validate(held.withColumnRenamed(row_id, "row_id"), folds, label, row_id, [method])
    return models, quality, spread


def fit_stacker(
    probs: DataFrame, truth: DataFrame, models: Sequence[str], labels: Sequence[str],
    name: str = "logreg", **options,
):
    """Fit a second-level classifier on the probabilities of base models."""
    rows = _labelled_meta(_meta(probs, models, labels), truth, labels)
    return stacker(name, len(models) * len(labels), len(labels), **options).fit(rows)


def _meta(probs, models, labels) -> DataFrame:
    return meta_features(probs, models, labels).select("row_id", array_to_vector("meta").alias("features"))


def _labelled_meta(meta, truth, labels) -> DataFrame:
    """Meta features with class numbers in label order and balanced weights."""
    place = F.array_position(literal_array(labels, "string"), F.col("y_true")) - 1
    rows = meta.join(truth.select("row_id", "y_true"), "row_id").withColumn("label_idx", place.cast("double"))
    counts = {r[0]: r[1] for r in truth.groupBy("y_true").count().collect()}  # one row per class
    total = sum(counts.values())
    weights = [total / (len(counts) * counts[x]) if x in counts else 1.0 for x in labels]
    return rows.withColumn("weight", F.get(literal_array(weights, "double"), place.cast("int")))


def save_stacker(fitted, path: str, name: str, models: Sequence[str], labels: Sequence[str]) -> None:
    """Write a fitted second level and what it was fitted on."""
    spark = SparkSession.getActiveSession()
    fitted.write().overwrite().save(f"{path}/model")
    text = json.dumps(stacker_metadata(name, models, labels))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_stacker(path: str, models: Sequence[str], truth: DataFrame | None = None):
    """The fitted second level, its metadata and the model names in its order; an error if they do not fit."""
    spark = SparkSession.getActiveSession()
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    order = check_stacker(metadata, models, truth)
    fitted = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    return fitted, metadata, order


def stack(fitted, probs: DataFrame, models: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Predictions ``(row_id, y_pred, confidence)`` of a fitted stacker."""
    return _stacked(fitted, _meta(probs, models, labels), labels)


def _stacked(fitted, meta: DataFrame, labels: Sequence[str]) -> DataFrame:
    scored = fitted.transform(meta)
    names = literal_array(labels, "string")
    return scored.select(
        "row_id",
        F.get(names, F.col("prediction").cast("int")).alias("y_pred"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def stack_out_of_fold(
    probs: DataFrame, truth: DataFrame, models: Sequence[str], labels: Sequence[str],
    name: str = "logreg", **options,
):
    """Stacker scored on folds it was not fitted on, and a final one fitted on all rows.

    ``truth`` has ``(row_id, y_true, fold)``. Returns predictions and the final stacker. The probabilities of a row are
    brought together once, and written to the checkpoint folder for all the fits.
    """
    meta = checkpointed(_meta(probs, models, labels))

    def fit(seen: DataFrame):
        rows = checkpointed(_labelled_meta(meta, seen, labels))
        return stacker(name, len(models) * len(labels), len(labels), **options).fit(rows)

    parts = []
    for f in distinct_values(truth, "fold"):
        seen, held = truth.where(F.col("fold") != f), truth.where(F.col("fold") == f)
        ids = held.select("row_id")
        parts.append(_stacked(fit(seen), meta.join(ids, "row_id", "left_semi"), labels))
    return _union(parts), fit(truth)


def _drawn(bagged: DataFrame, bag: int) -> DataFrame:
    """Rows of a bag, repeated by their weight."""
    times = F.explode(F.sequence(F.lit(1), F.col("weight")))
    drawn = bagged.where((F.col("bag") == bag) & (F.col("weight") > 0)).withColumn("__copy", times)
    return drawn.drop("__copy", "weight", "bag")


def bagging_cv(
    df: DataFrame,
    catalogue: Mapping[str, Spec],
    k: int = 5,
    bags: int = 3,
    methods: Sequence[str] = ("soft",),
    fraction: float = 1.0,
    seed: int = 42,
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Bagged members per fold, combined by vote: out-of-fold predictions and member scores."""
    folds = checkpointed(k_folds(df, label, k, text, row_id, seed))
    closed = {n: s for n, s in catalogue.items() if bayes.closed_form(s, options)}
    draws = [(bag, seed + f, f) for f in range(1, k + 1) for bag in range(1, bags + 1)]
    parts = []
    for name, spec in closed.items():
        weighted = bag_weights(folds, label, draws, row_id, fraction, "fold")
        fitted = bayes.fit_weighted(weighted, F.col("weights"), len(draws), spec, text, label, **options)
        for (bag, _, f), model in zip(draws, fitted):
            parts.append(long_probabilities(model, folds.where(F.col("fold") == f), f"{name} bag{bag}", row_id))
    rest = {n: s for n, s in catalogue.items() if n not in closed}
    for f in range(1, k + 1) if rest else ():
        train, held = folds.where(F.col("fold") != f), folds.where(F.col("fold") == f)
        bagged = bootstrap(train.drop("fold"), label, bags, row_id, fraction, seed + f)
        for (name, spec), bag in itertools.product(rest.items(), range(1, bags + 1)):
            model = build(spec, text, label, row_id, **options).fit(_drawn(bagged, bag))
            parts.append(long_probabilities(model, held, f"{name} bag{bag}", row_id))
    probs = checkpointed(_union(parts))
    truth = folds.select(F.col(row_id).alias("row_id"), F.col(label).alias("y_true"), "fold")
    probs = probs.withColumnRenamed(row_id, "row_id")
    voted = _union([vote(probs, m).withColumn("method", F.lit(m)) for m in methods])
    members = summary(all_votes(probs, ()).join(truth, "row_id"), ["model", "fold"])
    return voted.join(truth, "row_id"), members


def bagging_final(
    df: DataFrame,
    catalogue: Mapping[str, Spec],
    bags: int = 3,
    fraction: float = 1.0,
    seed: int = 42,
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
    **options,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Members fitted on bootstrap samples of all rows, each scored on its out-of-bag rows."""
    models, predictions = bagging_members(df, catalogue, bags, fraction, seed, text, label, row_id, **options)
    return models, summary(predictions, ["model"])


def bagging_members(
    df: DataFrame,
    catalogue: Mapping[str, Spec],
    bags: int = 3,
    fraction: float = 1.0,
    seed: int = 42,
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
    **options,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Members as ``bagging_final`` has them, and ``(model, row_id, y_true, y_pred)`` of their out-of-bag rows.

    The bags of a closed-form pipeline are fitted by one aggregation.
    """
    draws = [(bag, seed, 0) for bag in range(1, bags + 1)]
    weighted = checkpointed(bag_weights(df, label, draws, row_id, fraction))
    models, scored = {}, []
    for name, spec in catalogue.items():
        if bayes.closed_form(spec, options):
            fitted = bayes.fit_weighted(weighted, F.col("weights"), bags, spec, text, label, **options)
        else:
            own = [weighted.withColumns({"bag": F.lit(b), "weight": F.get("weights", F.lit(b - 1))}) for b, *_ in draws]
            pipeline = build(spec, text, label, row_id, **options)
            fitted = [pipeline.fit(_drawn(rows.drop("weights"), b)) for b, rows in enumerate(own, 1)]
        for bag, model in enumerate(fitted, 1):
            member = f"{name} bag{bag}"
            models[member] = model
            outside = weighted.where(F.get("weights", F.lit(bag - 1)) == 0).drop("weights")
            rows = score_rows(model, outside)
            scored.append(rows.select(F.lit(member).alias("model"), row_id, F.col(label).alias("y_true"), "y_pred"))
    return models, _union(scored)


def grid_search(
    df: DataFrame,
    spec: Spec,
    grid: Mapping[str, Sequence],
    k: int = 5,
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
    seed: int = 42,
    refit: bool = True,
    **options,
) -> tuple[DataFrame, dict, PipelineModel | None]:
    """Mean weighted F1 over folds for each setting, the best setting and, unless ``refit`` is off, its model on all rows.

    ``grid`` keys ``high`` and ``min_df`` change the features, others the classifier.
    """
    folds = checkpointed(k_folds(df, label, k, text, row_id, seed))
    joint = spec.classifier == "svm" and spec.features in ("counts", "tfidf") and set(grid) <= {"C", "high", "min_df", "max_features"}
    if joint:
        tried = _joint_grid(folds, spec, grid, k, text, label, **options)
    else:
        tried = []
        for values in itertools.product(*grid.values()):
            setting = dict(zip(grid, values))
            one = _with(spec, setting)
            scored = []
            for f in range(1, k + 1):
                model = build(one, text, label, row_id, **options).fit(folds.where(F.col("fold") != f))
                rows = score_rows(model, folds.where(F.col("fold") == f))
                scored.append(rows.select("fold", F.col(label).alias("y_true"), "y_pred"))
            mean = fold_scores(_union(scored)).first()["f1_mean"]
            tried.append((setting, mean))
    best = max(tried, key=lambda t: t[1])[0]  # the first among equals
    table = df.sparkSession.createDataFrame(
        [(*[str(v) for v in s.values()], float(m)) for s, m in tried],
        ", ".join(f"`{n}` string" for n in grid) + ", f1_mean double",
    )
    return table, best, build(_with(spec, best), text, label, row_id, **options).fit(df) if refit else None


def _joint_grid(folds: DataFrame, spec: Spec, grid: Mapping[str, Sequence], k: int, text: str, label: str, max_iter: int = 100) -> list:
    """Settings and their mean F1 for linear SVMs.

    The texts are split into words once per order. Each fold and feature setting has one matrix, and one solver fits all classes and
    all values of ``C`` on it in the same passes.
    """
    strengths = list(grid.get("C", [spec.options.get("C", 1.0)]))
    others = {n: v for n, v in grid.items() if n != "C"}
    names = distinct_values(folds, label)
    place = F.array_position(literal_array(names, dict(folds.dtypes)[label]), F.col(label)) - 1
    counts = {(r["fold"], r[label]): r["count"] for r in folds.groupBy("fold", label).count().collect()}  # folds * classes
    lists, scored = {}, []
    for values in itertools.product(*others.values()):
        setting = dict(zip(others, values))
        one = _with(spec, setting)
        stage = feature_stages(one, text)[0]
        if one.high not in lists:
            rows = folds.select("fold", place.cast("int").alias("label_idx"), text)
            lists[one.high] = checkpointed(stage.tokens(rows).select("fold", "label_idx", "__tokens"))

        def fold(f: int) -> list[DataFrame]:
            """Held-out predictions of one fold for every strength."""
            seen = [sum(n for (g, x), n in counts.items() if g != f and x == name) for name in names]  # noqa: B023
            balanced = [sum(seen) / (sum(n > 0 for n in seen) * n) if n else 1.0 for n in seen]
            fitted = stage.fit_tokens(lists[one.high].where(F.col("fold") != f))  # noqa: B023
            weight = F.get(literal_array(balanced, "double"), F.col("label_idx"))
            packed, width = linear.blocks(fitted.vectors(lists[one.high]).withColumn("weight", weight), fold="fold")  # noqa: B023
            own, out = lines_of(len(names)), []
            problems = [linear.Problem(i, f, float(c)) for c in strengths for i in own]
            lines = linear.solve(packed, width, problems, max_iter, GRID_TOLERANCE)
            for n, c in enumerate(strengths):
                part = slice(n * len(own), (n + 1) * len(own))
                held = linear.held_margins(packed, problems[part], lines[part], len(names)).where(F.col("fold") == f)
                best = F.array_position("margins", F.array_max("margins")).cast("int") - 1
                key = F.lit(json.dumps({**setting, "C": c} if "C" in grid else setting)).alias("setting")  # noqa: B023
                out.append(held.select(key, "fold", F.col("label_idx").cast("int").alias("y_true"), best.alias("y_pred")))
            done = checkpointed(_union(out))
            packed.unpersist()
            return [done]

        # Folds run side by side: the jobs of one fill the gaps between those of another.
        with ThreadPool(min(k, PARALLEL_FOLDS)) as pool:
            scored += sum(pool.map(inheritable_thread_target(folds.sparkSession)(fold), range(1, k + 1)), [])
    means = {r["setting"]: r["f1_mean"] for r in fold_scores(_union(scored), ["setting"]).collect()}  # one row per setting
    settings = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]

    def key(setting: dict) -> str:
        return json.dumps({n: setting[n] for n in [*others, *(["C"] if "C" in grid else [])]})

    return [(setting, means[key(setting)]) for setting in settings]


def _with(spec: Spec, setting: Mapping) -> Spec:
    known = {n: v for n, v in setting.items() if n in ("high", "min_df", "max_features")}
    other = {n: v for n, v in setting.items() if n not in known}
    return Spec(
        spec.features, spec.classifier, known.get("high", spec.high),
        known.get("max_features", spec.max_features), known.get("min_df", spec.min_df),
        {**spec.options, **other},
    )


def length_sweep(
    train: DataFrame,
    test: DataFrame,
    catalogue: Mapping[str, Spec],
    lengths: Sequence[int],
    strategy: str = "head",
    text: str = "text",
    label: str = "label",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Train and score on texts cut to several token lengths; all runs, and the best per model.

    A closed-form pipeline is fitted for all lengths by one aggregation over the words of the whole texts.
    """

    def cut(df, n):
        words = F.regexp_extract_all(F.col(text), F.lit(r"((?U)\S+)"), F.lit(1))
        return df.withColumn(text, F.array_join(truncate_tokens(words, n, strategy), " "))

    closed = {n: s for n, s in catalogue.items() if bayes.closed_form(s, options)}
    rest = {n: s for n, s in catalogue.items() if n not in closed}
    runs = []
    for name, spec in closed.items():
        begin = time.perf_counter()
        fitted = bayes.fit_lengths(train, lengths, strategy, spec, text, label, **options)
        seconds = round(time.perf_counter() - begin, 1)  # of all lengths
        known = only_known_labels(test, train, label)
        parts = []
        for n, model in zip(lengths, fitted):
            rows = score_rows(model, cut(known, n))
            parts.append(rows.select(F.lit(n).alias("max_length"), F.col(label).alias("y_true"), "y_pred"))
        scores = summary(_union(parts), ["max_length"])
        runs.append(scores.select(F.lit(name).alias("model"), "*", F.lit(seconds).alias("train_sec")))
    for n in lengths if rest else ():
        _, _, scores = train_and_score(cut(train, n), cut(test, n), rest, text, label, **options)
        runs.append(scores.withColumn("max_length", F.lit(n)))
    table = checkpointed(_union(runs))
    return table, best_per_model(table)


def knn_predictions(
    train: DataFrame,
    test: DataFrame,
    k: int = 5,
    text: str = "text",
    label: str = "label",
    row_id: str = "row_id",
    high: int = 2,
    max_features: int = 15_000,
) -> DataFrame:
    """Label of the nearest training texts by cosine of TF-IDF vectors."""
    vectors = TermVectors(inputCol=text, outputCol="__v", high=high, maxFeatures=max_features).fit(train)

    def rows(df, *more):
        parts = F.unwrap_udt("__v")
        vec = F.struct(parts["indices"].alias("indices"), parts["values"].alias("values")).alias("vec")
        return vectors.transform(df).select(F.col(row_id).alias("id"), *more, vec)

    near = nearest(rows(test), rows(train, F.col(label).alias("label")), k)
    return vote_of_neighbours(near).withColumnRenamed("id", row_id)
