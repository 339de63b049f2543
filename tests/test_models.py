import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from talkmill.operators import metrics, split
from talkmill.functions import text
from talkmill.plans import bayes, features, linear, models, train
from talkmill.plans.models import Spec

WORDS = {
    "license": "лицензия купить цена продление ключ".split(),
    "courses": "курс обучение группа расписание экзамен".split(),
    "support": "ошибка кластер упал лог версия".split(),
}
COMMON = "это мы вы нужно можно завтра сегодня".split()
SMALL = {"max_features": 200}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(150):
        label = rng.choices(list(WORDS), weights=[6, 3, 1])[0]
        body = rng.choices(WORDS[label], k=4) + rng.choices(COMMON, k=6) + rng.choices(WORDS[rng.choice(list(WORDS))], k=1)
        rng.shuffle(body)
        data.append((i, " ".join(body), label))
    return spark.createDataFrame(data, "row_id long, text string, label string").repartition(2).cache()


@pytest.fixture(scope="module")
def parts(rows):
    marked = split.hold_out(rows, "label").cache()
    return marked.where("split = 'train'"), marked.where("split = 'test'")


TEXTS = ["Мой код код лог", "лог ошибка", "", "код ошибка ошибка ошибка"]


def python_tfidf(texts, low, high):
    import re

    docs = []
    for t in texts:
        w = re.findall(r"\b\w\w+\b", t.lower())
        docs.append([" ".join(w[i:i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)])
    out = {}
    for i, d in enumerate(docs):
        row = {}
        for t in set(d):
            df = sum(t in x for x in docs)
            row[t] = (1 + math.log(d.count(t))) * (math.log((1 + len(docs)) / (1 + df)) + 1)
        norm = math.sqrt(sum(v * v for v in row.values()))
        out.update({(i, t): v / norm for t, v in row.items()})
    return out


def test_tfidf(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, text string")
    want = python_tfidf(TEXTS, 1, 2)
    got = {(r.row_id, r.term): r.weight for r in features.tfidf_rows(df, high=2).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    fitted = features.TermVectors(high=2).fit(df)
    wide = {}
    for r in fitted.transform(df).select("row_id", vector_to_array("features").alias("v")).collect():
        wide.update({(r.row_id, t): x for t, x in zip(fitted.terms, r.v) if x})
    assert wide == {k: pytest.approx(v) for k, v in want.items()}
    top = features.vocabulary(df, max_features=2).collect()
    assert [(r.term, r.corpus_count, r.df) for r in top] == [("ошибка", 4, 2), ("код", 3, 2)]
    counted = features.TermVectors(kind="counts").fit(df).transform(df)
    assert counted.where("row_id = 3").select(F.array_max(vector_to_array("features"))).first()[0] == 3.0


FLOORS = {
    "logreg": ({}, "tfidf"), "svm": ({"max_iter": 20}, "tfidf"), "calibrated_svm": ({"max_iter": 20}, "tfidf"),
    "multinomial_nb": ({}, "counts"), "complement_nb": ({}, "tfidf"),
    "random_forest": ({"numTrees": 20, "maxDepth": 10}, "tfidf"), "decision_tree": ({}, "counts"),
    "boosted_trees": ({"maxIter": 5, "maxDepth": 3}, "counts"),
}


@pytest.mark.parametrize("name", sorted(FLOORS))
def test_quality(parts, name):
    options, kind = FLOORS[name]
    fit, test = parts
    fitted, predictions, scores = train.train_and_score(fit, test, {name: Spec(kind, name, **SMALL)}, **options)
    row = scores.first()
    assert row.f1_weighted > 0.8 and row.n == test.count() and row.train_sec > 0
    probs = models.long_probabilities(fitted[name], test.drop("label"), name)
    sums = probs.groupBy("row_id").agg(F.sum("proba").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s == pytest.approx(1.0) and r.n == 3 for r in sums)
    top = {r.row_id: r.y_pred for r in predictions.collect()}
    best = probs.groupBy("row_id").agg(F.max_by("label", "proba").alias("l")).collect()
    assert sum(top[r.row_id] == r.l for r in best) >= len(best) - 1


def test_two_classes(rows):
    two = rows.where("label <> 'support'")
    for name in ("svm", "calibrated_svm"):
        fitted, predictions, scores = train.train_and_score(two, two, {name: Spec("tfidf", name, **SMALL)}, max_iter=20)
        assert scores.first().f1_weighted > 0.9
        probs = models.long_probabilities(fitted[name], two, name)
        assert probs.groupBy("row_id").agg(F.sum("proba").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_platt(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=400) * 2
    y = rng.random(400) < 1 / (1 + np.exp(-(1.3 * m - 0.4)))
    df = spark.createDataFrame([(float(a), 1.0 if b else 0.0) for a, b in zip(m, y)], "m double, label_idx double")
    held = df.select(F.lit(1).alias("fold"), "label_idx", F.array(-F.col("m"), F.col("m")).alias("margins"))
    held = held.unionAll(held.limit(30).withColumn("fold", F.lit(2))).cache()
    (_, (a, b)), _ = models._sigmoids(held, 2, 2)
    n1, n0 = y.sum(), (~y).sum()
    t = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(a, b):
        z = a * m + b
        return (np.logaddexp(0, z) - t * z).sum()

    assert all(loss(a, b) <= loss(a + da, b + db) for da in (-.01, 0, .01) for db in (-.01, 0, .01))


def test_joint_solver(spark):
    """Every fold, class and strength ends where its own gradient, taken by hand, vanishes."""
    rng = np.random.default_rng(5)
    x = np.where(rng.random((90, 12)) < 0.4, rng.normal(size=(90, 12)), 0.0)
    y, w, fold = rng.integers(0, 3, 90), rng.random(90) + 0.5, rng.integers(1, 4, 90)
    rows = [(v.tolist(), float(a), float(b), int(f)) for v, a, b, f in zip(x, y, w, fold)]
    df = spark.createDataFrame(rows, "v array<double>, label_idx double, weight double, fold int").repartition(3)
    from pyspark.ml.functions import array_to_vector

    packed, width = linear.blocks(df.withColumn("features", array_to_vector("v")), fold="fold")
    problems = [linear.Problem(i, f, c) for f in (0, 1, 3) for i in range(3) for c in (0.1, 2.0)]
    lines = linear.solve(packed, width, problems, 400, 1e-9)
    assert width == 12
    wide = np.hstack([x, np.ones((90, 1))])
    for p, line in zip(problems, lines):
        use = (fold != p.fold) | (p.fold == 0)
        sign = np.where(y == p.label, 1.0, -1.0)
        gap = np.maximum(0, 1 - sign * (wide @ line))
        slope = line - 2 * p.c * ((w * gap * sign * use) @ wide)
        assert np.abs(slope).max() < 1e-6 * (1 + np.abs(2 * p.c * ((w * sign * use) @ wide)).max())
    own = [p for p in problems if p.c == 2.0 and p.fold]
    held = linear.held_margins(packed, own, lines[[problems.index(p) for p in own]], 3).collect()
    by_fold = {f: wide @ lines[[problems.index(linear.Problem(i, f, 2.0)) for i in range(3)]].T for f in (1, 3)}
    want = sorted(tuple(np.round(by_fold[f][k] if f in by_fold else np.zeros(3), 6)) for k, f in enumerate(fold))
    assert np.allclose(sorted(tuple(np.round(r.margins, 6)) for r in held), want, atol=2e-6)


def test_catalogues():
    assert len(models.BASELINES) == 13 and len(models.LEGACY) == 4
    assert len(models.non_calibrated()) == 11
    assert models.non_calibrated(strict_reference=True) == models.BASELINES
    with pytest.raises(ValueError):
        models.build(models.LEGACY["Legacy TF-IDF + KNN"])
    with pytest.raises(ValueError):
        models.classifier("other")


def test_word_vectors(rows):
    spec = Spec("word2vec", "logreg")
    scored = models.score_rows(models.build(spec, maxIter=5).fit(rows), rows)
    assert scored.count() == 150 and scored.where("confidence is null").count() == 0


def test_keywords_and_grid(rows):
    spec = Spec("tfidf+keywords", "svm", **SMALL)
    table, best, model = train.grid_search(rows, spec, {"C": [0.001, 1.0], "high": [1]}, k=2, max_iter=5)
    assert table.count() == 2 and set(best) == {"C", "high"}
    assert models.score_rows(model, rows).where("y_pred = label").count() > 100


def test_folds_votes_and_stacking(rows):
    catalogue = {"nb": Spec("counts", "multinomial_nb", **SMALL), "lr": Spec("tfidf", "logreg", **SMALL)}
    folds = split.k_folds(rows, "label", 3).cache()
    probs = train.out_of_fold(folds, catalogue)
    assert probs.count() == 150 * 2 * 3
    quality, spread = train.cross_validate(probs, folds, methods=("soft", "hard"))
    scores = {r.model: r.f1_weighted for r in quality.collect()}
    assert set(scores) == {"nb", "lr", "Ensemble (soft)", "Ensemble (hard)"} and min(scores.values()) > 0.8
    assert all(r.folds == 3 and r.f1_std >= 0 for r in spread.collect())
    truth = folds.select("row_id", F.col("label").alias("y_true"), "fold")
    names = sorted(WORDS)
    predicted, final = train.stack_out_of_fold(probs, truth, ["lr", "nb"], names)
    assert metrics.summary(predicted.join(truth, "row_id")).first().f1_weighted > 0.8
    assert predicted.count() == 150
    again = train.stack(final, probs, ["lr", "nb"], names)
    assert again.count() == 150
    mlp = train.fit_stacker(probs, truth, ["lr", "nb"], names, "mlp", maxIter=40)
    assert metrics.summary(train.stack(mlp, probs, ["lr", "nb"], names).join(truth, "row_id")).first().f1_weighted > 0.7


def test_bagging(rows):
    catalogue = {"nb": Spec("counts", "multinomial_nb", **SMALL)}
    voted, members = train.bagging_cv(rows, catalogue, k=2, bags=2, methods=("soft", "max"))
    assert voted.count() == 300 and members.count() == 4
    assert all(r.f1_weighted > 0.7 for r in metrics.summary(voted, ["method"]).collect())
    fitted, scores = train.bagging_final(rows, catalogue, bags=2)
    assert set(fitted) == {"nb bag1", "nb bag2"}
    assert all(20 < r.n < 90 and r.f1_weighted > 0.7 for r in scores.collect())


def test_sweep_and_knn(parts):
    fit, test = parts
    table, best = train.length_sweep(fit, test, {"nb": Spec("counts", "multinomial_nb", **SMALL)}, [1, 11])
    assert table.count() == 2 and best.first().max_length == 11
    near = train.knn_predictions(fit, test).join(test, "row_id")
    assert near.where("y_pred = label").count() / test.count() > 0.8


def test_many_classes(spark):
    """A target of 30,000 labels is indexed and scored."""
    rows = spark.range(30_000).select(F.concat(F.lit("c"), F.col("id")).alias("label"), F.lit("a b").alias("text"))
    index = features.ClassIndex().fit(rows)
    out = index.transform(rows)
    assert len(index.names) == 30_000 and out.select("label_idx").distinct().count() == 30_000


OTHER_OPTIONS = {"maxIter": 3, "numTrees": 3, "maxDepth": 3, "smoothing": 0.2}


@pytest.mark.parametrize("name", sorted({**models.BASELINES, **models.VOTERS}))
def test_other_column_names_and_saving(rows, name, tmp_path):
    """Every catalogue entry works on other columns, with options meant for others, and comes back from disk."""
    from pyspark.ml import PipelineModel

    spec = {**models.BASELINES, **models.VOTERS}[name]
    small = Spec(spec.features, spec.classifier, spec.high, 100, 1)
    other = rows.select(F.col("row_id").alias("key"), F.col("text").alias("body"), F.col("label").alias("goal"))
    fitted = models.build(small, "body", "goal", "key", **OTHER_OPTIONS).fit(other)
    want = {r.key: r.y_pred for r in models.score_rows(fitted, other).collect()}
    fitted.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    assert {r.key: r.y_pred for r in models.score_rows(again, other).collect()} == want


def test_unknown_option_is_an_error():
    with pytest.raises(ValueError, match="wrong"):
        models.build(Spec("counts", "multinomial_nb"), wrong=1)


def test_word_features_are_saved(rows, tmp_path):
    from pyspark.ml import PipelineModel

    for n, spec in enumerate([Spec("tfidf+keywords", "svm", **SMALL), Spec("word2vec", "logreg")]):
        fitted = models.build(spec, maxIter=2).fit(rows)
        fitted.write().overwrite().save(f"{tmp_path}/{n}")
        a, b = (models.score_rows(m, rows).select("row_id", "y_pred") for m in (fitted, PipelineModel.load(f"{tmp_path}/{n}")))
        assert a.exceptAll(b).count() == 0


def test_class_absent_from_a_fold(spark):
    """Places of a model that never saw a class are 0, and the stacker keeps its columns."""
    from talkmill.operators import ensemble

    cells = [(1, m, x, p) for m, x, p in [("a", "x", .5), ("a", "y", .5), ("b", "y", 1.0)]]
    probs = spark.createDataFrame(cells, "row_id long, model string, label string, proba double")
    assert ensemble.meta_features(probs, ["a", "b"], ["x", "y"]).first().meta == [.5, .5, 0.0, 1.0]
    rows = [(i, "good words here" if i % 2 else "bad things there", "g" if i % 2 else "b", i % 3) for i in range(30)]
    rows += [(100 + i, "rare odd item", "r", 0) for i in range(4)]  # only in fold 0
    folds = spark.createDataFrame(rows, "row_id long, text string, label string, fold int")
    catalogue = {"nb": Spec("counts", "multinomial_nb"), "svm": Spec("counts", "calibrated_svm")}
    probs = train.out_of_fold(folds, catalogue, maxIter=5)
    names = ["b", "g", "r"]
    meta = ensemble.meta_features(probs, ["nb", "svm"], names)
    assert meta.where("size(meta) <> 6").count() == 0 and meta.count() == 34
    truth = folds.select("row_id", F.col("label").alias("y_true"), "fold")
    predicted, _ = train.stack_out_of_fold(probs, truth, ["nb", "svm"], names, maxIter=20)
    right = predicted.join(truth, "row_id").where("y_true <> 'r' and y_pred = y_true").count()
    assert right >= 24  # of 30; the third class is all in one fold


def test_voting_ensemble(parts, tmp_path):
    fit, test = parts
    catalogue = {"nb": Spec("counts", "multinomial_nb", **SMALL), "svm": Spec("tfidf", "calibrated_svm", **SMALL)}
    fitted, quality, spread = train.voting_ensemble(fit, test, catalogue, k=2, maxIter=10, smoothing=0.1)
    scores = {r.model: r.f1_weighted for r in quality.collect()}
    assert set(scores) == {"nb", "svm", "Ensemble (soft)"} and min(scores.values()) > 0.8
    assert set(fitted) == {"nb", "svm"} and all(r.folds == 2 for r in spread.collect())


def test_stacker_is_saved_with_its_metadata(rows, tmp_path):
    folds = split.k_folds(rows, "label", 2).cache()
    probs = train.out_of_fold(folds, {"nb": Spec("counts", "multinomial_nb", **SMALL)})
    truth = folds.select("row_id", F.col("label").alias("y_true"), "fold")
    fitted = train.fit_stacker(probs, truth, ["nb"], sorted(WORDS))
    train.save_stacker(fitted, f"{tmp_path}/stacker", "logreg", ["nb"], sorted(WORDS))
    again, metadata, order = train.load_stacker(f"{tmp_path}/stacker", ["other", "nb"])
    assert order == ["nb"] and metadata["labels"] == sorted(WORDS)
    a, b = (train.stack(m, probs, ["nb"], sorted(WORDS)) for m in (fitted, again))
    assert a.select("row_id", "y_pred").exceptAll(b.select("row_id", "y_pred")).count() == 0
    with pytest.raises(ValueError):
        train.load_stacker(f"{tmp_path}/stacker", ["other"])


def test_bags_and_lengths_in_one_aggregation(rows):
    """Closed-form members have the terms and scores of pipelines fitted on the drawn and on the cut rows."""
    spec = Spec("counts", "multinomial_nb", **SMALL)
    draws = [(1, 42, 0), (2, 42, 0), (1, 43, 2)]
    folds = split.k_folds(rows, "label", 3).cache()
    weighted = split.bag_weights(folds, "label", draws, fold="fold").cache()
    assert weighted.where("fold = 2 and weights[2] > 0").count() == 0
    fitted = bayes.fit_weighted(weighted, F.col("weights"), 3, spec, "text", "label")
    plain = split.bootstrap(folds, "label", 2).select("row_id", "bag", "weight").collect()
    by_row = {r.row_id: r.weights for r in weighted.collect()}
    assert all(by_row[r.row_id][r.bag - 1] == r.weight for r in plain)

    def held_against(model, drawn, seen):
        one = models.build(spec).fit(drawn)
        assert model.stages[1].terms == one.stages[1].terms
        a, b = (models.score_rows(m, seen).orderBy("row_id").collect() for m in (model, one))
        assert all(x.y_pred == y.y_pred and np.allclose(x.probas, y.probas) for x, y in zip(a, b))

    for j, model in enumerate(fitted):
        held_against(model, weighted.withColumn("c", F.explode(F.array_repeat(F.lit(1), F.get("weights", F.lit(j))))).drop("c", "weights"), rows)
    for strategy in ("head", "head_tail"):
        for n, model in zip((2, 5), bayes.fit_lengths(rows, (2, 5), strategy, spec, "text", "label")):
            words = F.split("text", " ")
            cut = rows.withColumn("text", F.array_join(text.truncate_tokens(words, n, strategy), " "))
            held_against(model, cut, cut)


def test_joint_grid(rows):
    """All strengths of a fold in one solver give the scores of a pipeline per fold and strength."""
    spec = Spec("tfidf", "svm", **SMALL)
    table, best, model = train.grid_search(rows, spec, {"min_df": [1, 3], "C": [0.01, 1.0]}, k=2, refit=False)
    got = {(r.min_df, r.C): r.f1_mean for r in table.collect()}
    assert len(got) == 4 and model is None and set(best) == {"min_df", "C"}
    assert got[str(best["min_df"]), str(best["C"])] == max(got.values())
    folds = split.k_folds(rows, "label", 2).cache()
    scored = []
    for f in (1, 2):
        one = models.build(Spec("tfidf", "svm", max_features=200, min_df=3, options={"C": 1.0})).fit(folds.where(F.col("fold") != f))
        scored.append(models.score_rows(one, folds.where(F.col("fold") == f)).select("fold", F.col("label").alias("y_true"), "y_pred"))
    want = metrics.fold_scores(scored[0].unionByName(scored[1])).first().f1_mean
    assert got["3", "1.0"] == pytest.approx(want, abs=0.011)


def test_flat_vectors():
    """Places and values of sparse and dense vectors of one batch, without lists of Python numbers."""
    import pyarrow as pa

    kinds, places, values = [0, 1, 0, 0], [[1, 4], None, [], [2]], [[0.5, 2.0], [1.0, 0.0, 3.0], [], [7.0]]
    column = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.int8()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
        names=["type", "indices", "values"],
    )
    for part, want in ((column, ([2, 3, 0, 1], [1, 4, 0, 1, 2, 2], [0.5, 2, 1, 0, 3, 7])), (column[1:], ([3, 0, 1], [0, 1, 2, 2], [1, 0, 3, 7]))):
        assert [x.tolist() for x in linear.flat(part)] == list(want)


def test_frequent_terms_are_counted_by_number(spark, tmp_path, monkeypatch):
    """Vocabulary and vectors equal those of the long tables, ties included, and no text is cut into strings of n-grams."""
    from talkmill.plans import terms

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, size=n, p=np.arange(40, 0, -1) / 820)) for n in rng.integers(0, 60, 90)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "one", "w1 W1 w1"])], "row_id int, text string")
    filled = rows.fillna({"text": ""})
    for low, high, most, rare in ((1, 1, 15, 1), (1, 2, 60, 1), (1, 3, 200, 2), (1, 3, 5000, 1), (2, 3, 30, 1)):
        vocab = {r["term"]: r["df"] for r in features.vocabulary(filled, "text", low, high, most, rare).collect()}
        with monkeypatch.context() as m:
            if low == 1:
                m.setattr(features, "word_ngrams", None)
            fitted = features.TermVectors(kind="counts", low=low, high=high, maxFeatures=most, minDF=rare).fit(rows)
            got = {r["row_id"]: r["features"] for r in fitted.transform(rows).collect()}
        assert fitted.terms == sorted(vocab)
        assert fitted.idf == [float(np.log((1 + len(got)) / (1 + vocab[t])) + 1) for t in fitted.terms]
        long = features.term_rows(filled, "text", "row_id", low, high).collect()
        want = {(r["row_id"], r["term"]): r["tf"] for r in long if r["term"] in vocab}
        assert {(i, fitted.terms[j]): c for i, v in got.items() for j, c in zip(v.indices, v.values)} == want
    # More parts than can be numbered: the strings are counted instead.
    monkeypatch.setattr(terms, "SLACK", 1)
    monkeypatch.setattr(terms, "MOST", 3)
    fitted = features.TermVectors(high=2, maxFeatures=5000).fit(rows)
    assert fitted.terms == sorted(r["term"] for r in features.vocabulary(filled, "text", 1, 2, 5000).collect())


def test_second_level_brings_probabilities_together_once(spark, monkeypatch):
    """The folds and the final stacker share one table of meta features."""
    ids = [(i, "ab"[i % 2], 1 + i // 2 % 3) for i in range(60)]
    truth = spark.createDataFrame(ids, "row_id long, y_true string, fold int")
    cells = [(i, m, x, 0.5 + (0.1 + i % 7 / 20) * (1 if (x == y) != (i % 11 == 0) else -1)) for i, y, _ in ids for m in ("m1", "m2") for x in "ab"]
    probs = spark.createDataFrame(cells, "row_id long, model string, label string, proba double")
    calls, plain = [], train.meta_features
    monkeypatch.setattr(train, "meta_features", lambda *a: calls.append(a) or plain(*a))
    predicted, final = train.stack_out_of_fold(probs, truth, ["m1", "m2"], ["a", "b"])
    assert len(calls) == 1
    got = {r["row_id"]: (r["y_pred"], round(r["confidence"], 9)) for r in predicted.collect()}
    want = {}
    for f in (1, 2, 3):
        fitted = train.fit_stacker(probs, truth.where(F.col("fold") != f), ["m1", "m2"], ["a", "b"])
        held = probs.join(truth.where(F.col("fold") == f), "row_id", "left_semi")
        want |= {r["row_id"]: (r["y_pred"], round(r["confidence"], 9)) for r in train.stack(fitted, held, ["m1", "m2"], ["a", "b"]).collect()}
    assert got == want and len(got) == 60


def test_words_are_made_into_vectors_in_bounded_runs():
    """The numbers that are in memory together do not follow the size of a batch or the length of its texts."""
    import pyarrow as pa

    from talkmill.plans import terms

    texts = [["a", "b"] * 700, [], ["b"] * 3, None, *[["a"] * 90] * 40, ["b", "c"]]
    words = pa.array(texts, pa.list_(pa.string()))
    runs = list(terms._slices(words, 1000))
    assert pa.concat_arrays(runs).equals(words)
    assert [len(r.flatten()) for r in runs] == [1400, 993, 990, 990, 632]
    out = terms.vectors(words, terms.Levels.of(["a", "a b", "c"], 1, 2), 3, None)
    assert out.slice(0, 3).to_pylist() == [
        {"type": 0, "size": 3, "indices": [0, 1], "values": [700.0, 700.0]},
        {"type": 0, "size": 3, "indices": [], "values": []}, {"type": 0, "size": 3, "indices": [], "values": []},
    ]
    assert out.to_pylist()[-1]["indices"] == [2]


def test_words_of_latin_texts_are_those_of_the_jvm(spark):
    """Every Latin-1 character, in and between words, next to texts that the JVM splits; runs of any size give the same."""
    from talkmill.functions.text import word_tokens
    from talkmill.plans import terms

    rng = np.random.default_rng(1)
    chars = [chr(i) for i in range(256)]
    texts = ["".join(rng.choice(chars, size=n)) for n in rng.integers(0, 60, 200)]
    texts += [f"a{c}b {c}{c} x{c} {c}Y" for c in chars] + ["", "\n", "x", "xy", "Привет мир x", None, "ÀÉÎ ß µm ½ x²", "İstanbul ok", "naïve — 漢字 two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    text = F.coalesce("text", F.lit(""))
    rows = df.select("i", word_tokens(text).alias("want"), terms.words_column(text).alias("t"), terms.word_lists(terms.words_column(text)).alias("lists"))
    found = rows.orderBy("i").toArrow()
    want = found.column("want").to_pylist()
    assert found.column("lists").to_pylist() == want
    assert sum(x is not None for x in found.column("t").combine_chunks().field("text").to_pylist()) == len(texts) - 3
    for most in (1, 50, terms.CHARS):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(terms, "CHARS", most)
            assert [w for run in terms.words_of(found.column("t")) for w in run.to_pylist()] == want


def test_blocks_of_rows_lie_in_files(spark, tmp_path, monkeypatch):
    """The solver keeps no rows in the memory of the JVM, its files hold the rows of any width, and they are gone at the end."""
    import os

    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(linear, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(linear, "BLOCK_CELLS", 4)
    monkeypatch.setattr(linear, "FILE_CELLS", 9)
    data = [(Vectors.sparse(70_000, [i, 69_000 + i], [1.0, 0.5 * i + 0.25]), float(i % 3), 1.5, 1 + i % 2) for i in range(40)]
    data += [(Vectors.sparse(70_000, [], []), 1.0, 1.0, 2)]
    df = spark.createDataFrame(data, ["features", "label_idx", "weight", "fold"])
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    packed, width = linear.blocks(df, fold="fold")
    assert width == 70_000 and linear.top_label(packed) == 2
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    got = []
    for names in packed.files.toArrow().to_batches():
        for rows, label, weight, fold in linear.unpacked(names):
            for r in range(rows.n):
                own = rows.row == r
                got.append((rows.place[own].tolist(), rows.value[own].tolist(), float(label[r]), weight[r], int(fold[r])))
    assert sorted(got) == sorted((v.indices.tolist(), v.values.tolist(), y, w, f) for v, y, w, f in data)
    assert len(os.listdir(packed.folder)) > 4
    packed.unpersist()
    assert not os.path.exists(packed.folder)


def test_ended_problems_take_no_part_in_a_pass(spark, monkeypatch):
    """A pass has only the problems that go on, and rows without a slope add nothing to a gradient."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4))
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(v.tolist(), float(v[0] > 0), 1.0) for v in x], "v array<double>, label_idx double, weight double")
    packed, width = linear.blocks(df.withColumn("features", array_to_vector("v")))
    seen, plain = [], linear._pass
    monkeypatch.setattr(linear, "_pass", lambda packed, width, lines, own: seen.append(len(own)) or plain(packed, width, lines, own))
    problems = [linear.Problem(1, 0, c) for c in (0.0001, 50.0)]
    both = linear.solve(packed, width, problems)
    assert seen[0] == 2 and seen[-1] == 1 and seen == sorted(seen, reverse=True)
    alone = [linear.solve(packed, width, [p])[0] for p in problems]
    assert np.allclose(both, alone, rtol=1e-12, atol=1e-12)
    packed.unpersist()
    rows = linear.Rows.of([[0, 2], [1], [2, 3], [0]], [[1.0, 2.0], [3.0], [4.0, 5.0], [6.0]])
    slopes = np.array([[0.0, 1.0], [2.0, 0.0], [0.0, 3.0], [0.0, 4.0]])
    assert rows.back(slopes, 4).tolist() == [[0.0, 6.0, 0.0, 0.0, 2.0], [25.0, 0.0, 14.0, 15.0, 8.0]]


def test_sparse_tree_equals_that_of_spark(spark, tmp_path):
    """Probabilities and leaves of a tree on stored numbers are those of Spark's, which bins every feature of every row."""
    from pyspark.ml.linalg import Vectors

    from talkmill.plans import tree

    rng = np.random.default_rng(4)
    base = models.classifier("decision_tree").base
    for values in (lambda: rng.integers(1, 6, (300, 20)).astype(float), lambda: rng.normal(size=(300, 20))):
        x = np.where(rng.random((300, 20)) < 0.4, values(), 0.0)
        y = (x[:, 0] + x[:, 1] + rng.normal(size=300) > 1.5).astype(int) + (x[:, 2] > x[:, 3])
        data = [(i, Vectors.sparse(20, np.flatnonzero(r).tolist(), r[r != 0].tolist()), float(k), [0.5, 1.25, 2.0][k]) for i, (r, k) in enumerate(zip(x, y))]
        df = spark.createDataFrame(data, ["i", "features", "label_idx", "weight"]).coalesce(2).cache()
        plain, fitted = base.fit(df), tree.SparseTree(base).fit(df)
        assert isinstance(fitted, tree.SparseTreeModel)
        want = plain.transform(df).select("i", vector_to_array("probability").alias("p"), "prediction").orderBy("i").collect()
        got = fitted.transform(df).select("i", F.col("probability").alias("p"), "prediction").orderBy("i").collect()
        assert np.allclose([r.p for r in got], [r.p for r in want]) and [r.prediction for r in got] == [r.prediction for r in want]
        fitted.write().save(f"{tmp_path}/{fitted.uid}")
        again = tree.SparseTreeModel.load(f"{tmp_path}/{fitted.uid}").transform(df).select("i", F.col("probability").alias("p")).orderBy("i").collect()
        assert [r.p for r in again] == [r.p for r in got]
    # Rows of one class with different weights are left to Spark.
    mixed = df.withColumn("weight", F.col("i") % 3 + 1.0)
    assert not isinstance(tree.SparseTree(base).fit(mixed), tree.SparseTreeModel)


def test_thresholds_of_many_numbers():
    """Few different numbers are parted in their middles, many by their weight; what is not stored counts as zero."""
    from talkmill.plans import tree

    assert tree.thresholds(np.array([1.0, 3.0]), np.array([2.0, 2.0]), 4, 10.0, 32).tolist() == [0.5, 2.0]
    assert tree.thresholds(np.array([-1.0, 3.0]), np.array([5.0, 5.0]), 10, 10.0, 32).tolist() == [1.0]
    found = tree.thresholds(np.arange(1, 101.0), np.ones(100), 100, 100.0, 4)
    assert found.tolist() == [25.5, 50.5, 75.5]
    assert not len(tree.thresholds(np.empty(0), np.empty(0), 0, 10.0, 32))
