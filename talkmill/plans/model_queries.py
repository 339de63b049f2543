"""Queries that fit classifiers on the documents: language is the label, the whole text the input.

Naive Bayes and nearest neighbours are closed forms and have SQL. The other classifiers are iterative. The
queries have the catalogue's settings but for the forest, the boosted trees and the word vectors, whose fits are smaller, so that
a run on test data is short.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from talkmill.operators import split
from talkmill.operators.metrics import summary
from talkmill.plans import models, train
from talkmill.plans.models import BASELINES, LEGACY, Spec
from talkmill.plans.registry import query, round6, texts
from talkmill.plans.score_queries import report_sql
from talkmill.session import checkpointed

VOTING = {"cnb": BASELINES["TF-IDF + NaiveBayes"], "nb": BASELINES["BoW + NaiveBayes"]}


def _labelled(spark, sf_dir):
    return texts(spark, sf_dir, "documents", "doc_id", "text", "source", "lang").select(
        F.col("doc_id").alias("row_id"), "text", F.col("source").alias("grp"), F.col("lang").alias("label")
    )


def _parts(spark, sf_dir):
    rows = checkpointed(split.hold_out(_labelled(spark, sf_dir), "label"))
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def _scores(spark, sf_dir, name, spec, **options):
    fit, test = _parts(spark, sf_dir)
    _, _, scores = train.train_and_score(fit, test, {name: spec}, **options)
    return round6(scores.drop("train_sec"))


# Hold-out by hash rank in each language, and the terms of every text.
_SPLIT_SQL = r"""
keyed AS (SELECT doc_id AS row_id, lang AS label, lower(text) AS text,
                 sha1(concat_ws(chr(31), lang, text, doc_id::VARCHAR, '42')) AS k FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, row_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM keyed),
parts AS (SELECT row_id, label, text, rank <= floor(n * 0.2::DOUBLE + 0.5) AS held FROM ranked),
terms AS (SELECT row_id, term, count(*) AS tf FROM (
    SELECT row_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM parts) GROUP BY ALL)"""


@query(
    f"""
    WITH {_SPLIT_SQL},
    vocab AS (SELECT term FROM terms JOIN parts USING (row_id) WHERE NOT held GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 15000),
    classes AS (SELECT label, count(*) AS n FROM parts WHERE NOT held GROUP BY label),
    counts AS (SELECT label, term, sum(tf) AS c FROM terms JOIN parts USING (row_id) JOIN vocab USING (term) WHERE NOT held GROUP BY ALL),
    totals AS (SELECT label, sum(c) AS t FROM counts GROUP BY label),
    theta AS (SELECT label, term, ln(coalesce(c, 0) + 0.1) - ln(t + 0.1 * (SELECT count(*) FROM vocab)) AS w
              FROM classes CROSS JOIN vocab LEFT JOIN counts USING (label, term) JOIN totals USING (label)),
    scores AS (SELECT p.row_id, p.label AS y_true, k.label AS y_pred,
                      ln(k.n + 0.1) + coalesce((SELECT sum(t.tf * h.w) FROM terms t JOIN theta h USING (term)
                                                WHERE t.row_id = p.row_id AND h.label = k.label), 0) AS s
               FROM parts p CROSS JOIN classes k WHERE held)
    SELECT row_id, y_true, first(y_pred ORDER BY s DESC, y_pred) AS y_pred FROM scores GROUP BY ALL"""
)
def naive_bayes(spark, sf_dir):
    """Predicted language of every held-out text, with the catalogue's settings."""
    fit, test = _parts(spark, sf_dir)
    name = "BoW + NaiveBayes"
    _, predictions, _ = train.train_and_score(fit, test, {name: BASELINES[name]})
    return predictions.select("row_id", "y_true", "y_pred")


@query()
def logistic_regression(spark, sf_dir):
    return _scores(spark, sf_dir, "logreg", BASELINES["TF-IDF + LogReg"])


@query()
def linear_svm(spark, sf_dir):
    return _scores(spark, sf_dir, "svm", LEGACY["Legacy TF-IDF + SVM"])


@query()
def keyword_svm(spark, sf_dir):
    return _scores(spark, sf_dir, "svm", LEGACY["Legacy TF-IDF + Keywords + SVM"])


@query()
def calibrated_svm(spark, sf_dir):
    return _scores(spark, sf_dir, "svm", BASELINES["TF-IDF + SVM"])


@query()
def random_forest(spark, sf_dir):
    small = {"high": 1, "max_features": 400, "min_df": 2}
    return _scores(spark, sf_dir, "forest", Spec("tfidf", "random_forest", **small), numTrees=20, maxDepth=8)


@query()
def decision_tree(spark, sf_dir):
    return _scores(spark, sf_dir, "tree", BASELINES["BoW + DecisionTree"])


@query()
def boosted_trees(spark, sf_dir):
    return _scores(spark, sf_dir, "boosted", Spec("counts", "boosted_trees", max_features=100), maxIter=3, maxDepth=4)


@query()
def word_vectors(spark, sf_dir):
    from pyspark.ml.feature import Word2Vec

    from talkmill.plans.features import WordList

    rows = _labelled(spark, sf_dir)
    words = WordList(inputCol="text", outputCol="words").transform(rows)
    vectors = Word2Vec(inputCol="words", outputCol="v", vectorSize=16, minCount=5, maxIter=1, numPartitions=8, seed=42)
    from pyspark.ml.functions import vector_to_array

    out = vectors.fit(words).transform(words)
    return out.select("row_id", F.size(vector_to_array("v")).alias("width"))


#: Unit vectors of TF-IDF over the 15,000 most frequent words and pairs of words of the training rows.
_VECTORS_SQL = r"""
words AS (SELECT row_id, held, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') AS w FROM parts),
grams AS (SELECT row_id, held, unnest(w) AS term FROM words UNION ALL
          SELECT row_id, held, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
tf AS (SELECT row_id, held, term, count(*) AS tf FROM grams GROUP BY ALL),
known AS (SELECT term, count(*) AS df FROM tf WHERE NOT held GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 15000),
raw AS (SELECT row_id, held, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM parts WHERE NOT held)) / (1 + df)) + 1) AS w
        FROM tf JOIN known USING (term)),
vectors AS (SELECT row_id, held, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM raw)"""


@query(
    f"""
    WITH {_SPLIT_SQL}, {_VECTORS_SQL},
    sums AS (SELECT label, term, sum(w) AS s FROM vectors JOIN parts USING (row_id) WHERE NOT vectors.held GROUP BY ALL),
    whole AS (SELECT term, sum(s) AS s FROM sums GROUP BY term),
    labels AS (SELECT DISTINCT label FROM parts WHERE NOT held),
    rest AS (SELECT l.label, k.term, w.s - coalesce(x.s, 0) + 0.1 AS s FROM labels l CROSS JOIN known k JOIN whole w USING (term)
             LEFT JOIN sums x ON x.label = l.label AND x.term = k.term),
    theta AS (SELECT label, term, ln(sum(s) OVER (PARTITION BY label)) - ln(s) AS w FROM rest),
    scores AS (SELECT v.row_id, t.label, sum(v.w * t.w) AS s FROM vectors v JOIN theta t USING (term) WHERE held GROUP BY ALL)
    SELECT s.row_id, p.label AS y_true, first(s.label ORDER BY round(s.s, 9) DESC, s.label) AS y_pred
    FROM scores s JOIN parts p USING (row_id) GROUP BY ALL"""
)
def complement_naive_bayes(spark, sf_dir):
    """Predicted language of every held-out text, with the catalogue's settings."""
    fit, test = _parts(spark, sf_dir)
    _, predictions, _ = train.train_and_score(fit, test, {"cnb": BASELINES["TF-IDF + NaiveBayes"]})
    return predictions.select("row_id", "y_true", "y_pred")


@query(
    f"""
    WITH {_SPLIT_SQL}, {_VECTORS_SQL},
    sims AS (SELECT q.row_id AS row_id, t.row_id AS near, sum(q.w * t.w) AS s
             FROM vectors q JOIN vectors t USING (term) WHERE q.held AND NOT t.held GROUP BY ALL),
    placed AS (SELECT q.row_id, t.label, row_number() OVER (PARTITION BY q.row_id ORDER BY round(coalesce(s, 0), 9) DESC, t.row_id) AS rank
               FROM parts q JOIN parts t ON q.held AND NOT t.held LEFT JOIN sims ON sims.row_id = q.row_id AND near = t.row_id),
    votes AS (SELECT row_id, label, count(*) AS n FROM placed WHERE rank <= 5 GROUP BY ALL)
    SELECT row_id, first(label ORDER BY n DESC, label) AS y_pred, round(max(n) / sum(n), 6)::DOUBLE AS confidence
    FROM votes GROUP BY row_id"""
)
def knn_text(spark, sf_dir):
    """Label of held-out texts by their nearest training texts."""
    fit, test = _parts(spark, sf_dir)
    return round6(train.knn_predictions(fit, test, 5))


@query()
def out_of_fold_votes(spark, sf_dir):
    """Base models and votes on folds they did not see."""
    folds = checkpointed(split.k_folds(_labelled(spark, sf_dir), "label", 3))
    probs = train.out_of_fold(folds, VOTING)
    quality, _ = train.cross_validate(probs, folds, methods=("soft", "max", "hard"))
    return round6(quality)


@query()
def stacking(spark, sf_dir):
    """A second-level classifier on out-of-fold probabilities."""
    folds = checkpointed(split.k_folds(_labelled(spark, sf_dir), "label", 3))
    probs = train.out_of_fold(folds, VOTING)
    truth = folds.select("row_id", F.col("label").alias("y_true"), "fold")
    names = sorted(r[0] for r in folds.select("label").distinct().collect())
    predicted, _ = train.stack_out_of_fold(probs, truth, sorted(VOTING), names)
    return round6(summary(predicted.join(truth, "row_id")))


@query()
def stacked_perceptron(spark, sf_dir):
    """The second level as a small neural network, fitted on one part and used on the other."""
    fit, test = _parts(spark, sf_dir)
    names = sorted(r[0] for r in fit.select("label").distinct().collect())
    fitted = {n: models.build(s).fit(fit) for n, s in VOTING.items()}

    def probs(rows):
        first, second = (models.long_probabilities(m, rows, n) for n, m in sorted(fitted.items()))
        return first.unionByName(second)

    truth = fit.select("row_id", F.col("label").alias("y_true"))
    stacker = train.fit_stacker(probs(fit), truth, sorted(VOTING), names, "mlp")
    predicted = train.stack(stacker, probs(test), sorted(VOTING), names)
    return round6(summary(predicted.join(test.select("row_id", F.col("label").alias("y_true")), "row_id")))


_POISSON = " ".join(
    f"WHEN u < {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r}::DOUBLE THEN {k}" for k in range(16)
)


def _members_sql(seed: str, left_out: str) -> str:
    """Naive Bayes of the bags ``members(f, bag)``: weights of rows, and scores of every class for every row and member."""
    return f"""
drawn AS (SELECT r.row_id, r.label, r.fold, m.f, m.bag, sha1(concat_ws(chr(31), r.row_id::VARCHAR, m.bag::VARCHAR, ({seed})::VARCHAR)) AS k
          FROM rows r JOIN members m ON {left_out}),
poisson AS (SELECT *, CASE {_POISSON} ELSE 16 END AS w0 FROM (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM drawn)),
forced AS (SELECT *, max(w0) OVER (PARTITION BY f, bag, label) AS top,
                  row_number() OVER (PARTITION BY f, bag, label ORDER BY k, row_id) AS rn FROM poisson),
weights AS (SELECT f, bag, row_id, label, CASE WHEN top = 0 AND rn = 1 THEN 1 ELSE w0 END AS w FROM forced),
counts AS (SELECT f, bag, label, term, sum(tf * w) AS c FROM weights JOIN terms USING (row_id) WHERE w > 0 GROUP BY ALL),
vocab AS (SELECT f, bag, term FROM counts GROUP BY f, bag, term
          QUALIFY row_number() OVER (PARTITION BY f, bag ORDER BY sum(c) DESC, term) <= 15000),
kept AS (SELECT * FROM counts JOIN vocab USING (f, bag, term)),
sizes AS (SELECT f, bag, label, sum(w) AS n FROM weights GROUP BY ALL HAVING sum(w) > 0),
totals AS (SELECT s.f, s.bag, s.label, ln(s.n + 0.1) - ln(sum(s.n) OVER (PARTITION BY s.f, s.bag) + 0.1 * count(*) OVER (PARTITION BY s.f, s.bag)) AS prior,
                  coalesce(t.t, 0) + 0.1 * v.size AS t
           FROM sizes s JOIN (SELECT f, bag, count(*) AS size FROM vocab GROUP BY ALL) v USING (f, bag)
           LEFT JOIN (SELECT f, bag, label, sum(c) AS t FROM kept GROUP BY ALL) t USING (f, bag, label))"""


_ROWS_SQL = r"""
rows AS (SELECT row_id, label, text, (row_number() OVER (PARTITION BY label ORDER BY k, row_id) - 1) % 5 + 1 AS fold FROM (
    SELECT doc_id AS row_id, lang AS label, lower(text) AS text,
           sha1(concat_ws(chr(31), lang, text, doc_id::VARCHAR, '42')) AS k FROM documents)),
terms AS (SELECT row_id, term, count(*) AS tf FROM (
    SELECT row_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) AS term FROM rows) GROUP BY ALL)"""

#: Scores of ``wanted(f, bag, row_id)``: known terms of a row, those of them that the class has, and what a term counts without.
_SCORES_SQL = """
known AS (SELECT w.f, w.bag, w.row_id, sum(tf) AS all_tf FROM wanted w JOIN terms USING (row_id) JOIN vocab v
          ON v.f = w.f AND v.bag = w.bag AND v.term = terms.term GROUP BY ALL),
hits AS (SELECT w.f, w.bag, w.row_id, k.label, sum(tf * (ln(c + 0.1) - ln(0.1::DOUBLE))) AS s FROM wanted w JOIN terms USING (row_id)
         JOIN kept k ON k.f = w.f AND k.bag = w.bag AND k.term = terms.term GROUP BY ALL),
scores AS (SELECT w.f, w.bag, w.row_id, t.label, t.prior + coalesce(h.s, 0) + coalesce(n.all_tf, 0) * (ln(0.1::DOUBLE) - ln(t.t)) AS s
           FROM wanted w JOIN totals t ON t.f = w.f AND t.bag = w.bag
           LEFT JOIN known n ON n.f = w.f AND n.bag = w.bag AND n.row_id = w.row_id
           LEFT JOIN hits h ON h.f = w.f AND h.bag = w.bag AND h.row_id = w.row_id AND h.label = t.label)"""


@query(
    f"""
    WITH {_ROWS_SQL}, members AS (SELECT f, bag FROM range(1, 6) a(f), range(1, 4) b(bag)),
    {_members_sql("42 + m.f", "r.fold <> m.f")},
    wanted AS (SELECT m.f, m.bag, r.row_id FROM rows r JOIN members m ON r.fold = m.f), {_SCORES_SQL},
    shifted AS (SELECT *, exp(s - max(s) OVER (PARTITION BY f, bag, row_id)) AS e FROM scores),
    shares AS (SELECT *, e / sum(e) OVER (PARTITION BY f, bag, row_id) AS p FROM shifted),
    means AS (SELECT row_id, label, round(avg(p), 12) AS p FROM shares GROUP BY ALL)
    SELECT m.row_id, r.fold::INT AS fold, r.label AS y_true, first(m.label ORDER BY p DESC, m.label) AS y_pred,
           round(max(p), 6) AS confidence, 'soft' AS method
    FROM means m JOIN rows r USING (row_id) GROUP BY ALL"""
)
def bagging(spark, sf_dir):
    """Soft vote of three bags of naive Bayes for every row, by members that did not see its fold."""
    voted, _ = train.bagging_cv(_labelled(spark, sf_dir), {"nb": BASELINES["BoW + NaiveBayes"]})
    return round6(voted.select("row_id", "fold", "y_true", "y_pred", "confidence", "method"))


@query(
    f"""
    WITH {_ROWS_SQL}, members AS (SELECT 0 AS f, bag FROM range(1, 4) b(bag)),
    {_members_sql("42", "true")},
    wanted AS (SELECT f, bag, row_id FROM weights WHERE w = 0), {_SCORES_SQL}
    SELECT 'nb bag' || bag AS model, row_id, r.label AS y_true, first(s.label ORDER BY round(s.s, 9) DESC, s.label) AS y_pred
    FROM scores s JOIN rows r USING (row_id) GROUP BY ALL"""
)
def bagging_out_of_bag(spark, sf_dir):
    """Label that each bag's naive Bayes gives its out-of-bag rows."""
    _, predictions = train.bagging_members(_labelled(spark, sf_dir), {"nb": BASELINES["BoW + NaiveBayes"]})
    return predictions


@query()
def grid_search(spark, sf_dir):
    """Strengths of the catalogue's linear SVM over five folds."""
    table_, _, _ = train.grid_search(_labelled(spark, sf_dir), LEGACY["Legacy TF-IDF + SVM"], {"C": [0.1, 1.0, 10.0]}, refit=False)
    return round6(table_)


@query(
    rf"""
    WITH {_SPLIT_SQL}, lengths(n) AS (VALUES (64), (128), (192), (256)),
    words AS (SELECT row_id, label, held, regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x85\p{{Z}}]+') AS w FROM parts),
    cut AS (SELECT row_id, label, held, n, list_concat(w[1:(CASE WHEN len(w) > n THEN n // 2 ELSE len(w) END)],
                   CASE WHEN len(w) > n THEN w[len(w) - n // 2 + 1:] ELSE [] END) AS w FROM words, lengths),
    seen AS (SELECT n, row_id, label, held, unnest(regexp_extract_all(array_to_string(w, ' '), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM cut),
    tfs AS (SELECT n, row_id, label, held, term, count(*) AS tf FROM seen GROUP BY ALL),
    vocab AS (SELECT n, term FROM tfs WHERE NOT held GROUP BY n, term
              QUALIFY row_number() OVER (PARTITION BY n ORDER BY sum(tf) DESC, term) <= 15000),
    counts AS (SELECT n, label, term, sum(tf) AS c FROM tfs JOIN vocab USING (n, term) WHERE NOT held GROUP BY ALL),
    totals AS (SELECT n, label, sum(c) AS t FROM counts GROUP BY ALL),
    sizes AS (SELECT n, count(*) AS v FROM vocab GROUP BY n),
    classes AS (SELECT label, count(*) AS rows FROM parts WHERE NOT held GROUP BY label),
    base AS (SELECT tfs.n, row_id, sum(tf) AS all_tf FROM tfs JOIN vocab USING (n, term) WHERE held GROUP BY ALL),
    hits AS (SELECT t.n, t.row_id, c.label, sum(tf * (ln(c + 0.1) - ln(0.1::DOUBLE))) AS s FROM tfs t JOIN counts c USING (n, term) WHERE held GROUP BY ALL),
    scores AS (SELECT l.n, p.row_id, p.label AS y_true, k.label AS y_pred,
                      ln(k.rows + 0.1) + coalesce(h.s, 0) + coalesce(b.all_tf, 0) * (ln(0.1::DOUBLE) - ln(t.t + 0.1 * z.v)) AS s
               FROM parts p CROSS JOIN lengths l CROSS JOIN classes k JOIN totals t ON t.n = l.n AND t.label = k.label JOIN sizes z ON z.n = l.n
               LEFT JOIN base b ON b.n = l.n AND b.row_id = p.row_id
               LEFT JOIN hits h ON h.n = l.n AND h.row_id = p.row_id AND h.label = k.label WHERE p.held),
    preds AS (SELECT n AS max_length, row_id, y_true, first(y_pred ORDER BY s DESC, y_pred) AS y_pred FROM scores GROUP BY ALL),
    {report_sql('preds', 'max_length')}
    SELECT 'nb' AS model, max_length::INT AS max_length, n, errors, accuracy, f1_weighted, precision_weighted, recall_weighted, f1_macro
    FROM quality"""
)
def length_sweep(spark, sf_dir):
    """Scores of naive Bayes on texts cut to the reference lengths."""
    fit, test = _parts(spark, sf_dir)
    runs, _ = train.length_sweep(fit, test, {"nb": BASELINES["BoW + NaiveBayes"]}, [64, 128, 192, 256], "head_tail")
    return round6(runs.drop("train_sec"))


@query(
    r"""
    WITH t AS (SELECT doc_id AS row_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
    g AS (SELECT row_id, 1 AS n, unnest(w) AS term FROM t
          UNION ALL SELECT row_id, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t
          UNION ALL SELECT row_id, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM t),
    k(name, top, lim) AS (VALUES ('BoW + LogReg', 1, 15000), ('TF-IDF + LogReg', 2, 15000), ('N-gram(1-3) + LogReg', 3, 20000)),
    c AS (SELECT name, lim, term, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, term) AS place
          FROM g JOIN k ON g.n <= k.top GROUP BY name, lim, term),
    v AS (SELECT name, term FROM c WHERE place <= lim),
    f AS (SELECT name, row_id, count(DISTINCT term) AS filled FROM g JOIN k ON g.n <= k.top JOIN v USING (name, term) GROUP BY ALL),
    s AS (SELECT name, count(*) AS width FROM v GROUP BY name)
    SELECT s.name, d.doc_id AS row_id, s.width::INT AS width, coalesce(filled, 0)::INT AS filled
    FROM documents d CROSS JOIN s LEFT JOIN f ON f.name = s.name AND f.row_id = d.doc_id"""
)
def fitted_vocabulary(spark, sf_dir):
    """Vectors of every catalogue feature kind: width and filled places per document."""
    from pyspark.sql.functions import unwrap_udt

    rows = _labelled(spark, sf_dir)
    out = []
    for name in ("BoW + LogReg", "TF-IDF + LogReg", "N-gram(1-3) + LogReg"):
        spec = BASELINES[name]
        stage = models.feature_stages(spec)[0].fit(rows)
        vec = unwrap_udt("features")
        out.append(
            stage.transform(rows).select(
                F.lit(name).alias("name"), "row_id", vec["size"].alias("width"), F.size(vec["indices"]).alias("filled")
            )
        )
    return out[0].unionByName(out[1]).unionByName(out[2])
