"""Queries over prediction tables: metrics, votes, calibration, thresholds and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.operators import calibrate, ensemble, metrics, neighbours, report, threshold
from talkmill.plans import sample_tables as sample
from talkmill.plans.registry import query, round6, table
from talkmill.plans.sample_tables import BINARY_SQL, LOGITS_SQL, PROBS_SQL, TOP_SQL, TRUTH_SQL
from talkmill.session import checkpointed

BASE = f"WITH {PROBS_SQL}, {TOP_SQL}"


def _top(spark, sf_dir):
    """Each model's prediction per row, with the truth."""
    probs = sample.probabilities(spark, sf_dir)
    return probs.groupBy("row_id", "model", "y_true").agg(
        F.min_by("label", F.struct((-F.col("proba")).alias("p"), F.col("label").alias("l"))).alias("y_pred"),
        F.max("proba").alias("confidence"),
    )


def _voted(spark, sf_dir, method):
    return ensemble.vote(sample.probabilities(spark, sf_dir), method)


# Metrics ----------------------------------------------------------------------------------------

@query(f"{BASE} SELECT model, y_true, y_pred, count(*) AS n FROM top GROUP BY ALL")
def confusion(spark, sf_dir):
    return metrics.confusion_matrix(_top(spark, sf_dir), ["model"])


@query(
    f"{BASE} SELECT y_true, " + ", ".join(
        f"count(*) FILTER (y_pred = 'c{i}') AS c{i}" for i in range(10)
    ) + ", model FROM top GROUP BY model, y_true"
)
def confusion_table(spark, sf_dir):
    return metrics.confusion_table(_top(spark, sf_dir), [f"c{i}" for i in range(10)], ["model"])


def report_sql(source: str, by: str) -> str:
    """Class report and support of ``source`` with columns ``by``, ``y_true``, ``y_pred``."""
    return f"""
    lab AS (SELECT {by}, y_true AS label FROM {source} UNION SELECT {by}, y_pred FROM {source}),
    cnt AS (SELECT l.*, t.support, t.tp, p.predicted FROM lab l
      LEFT JOIN (SELECT {by}, y_true AS label, count(*) AS support, count(*) FILTER (y_true = y_pred) AS tp
                 FROM {source} GROUP BY ALL) t USING ({by}, label)
      LEFT JOIN (SELECT {by}, y_pred AS label, count(*) AS predicted FROM {source} GROUP BY ALL) p USING ({by}, label)),
    rep AS (SELECT {by}, label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
        coalesce(tp / predicted::DOUBLE, 0) AS precision, coalesce(tp / support::DOUBLE, 0) AS recall,
        coalesce(2 * tp / (coalesce(support, 0) + coalesce(predicted, 0))::DOUBLE, 0) AS f1 FROM cnt),
    quality AS (SELECT {by}, sum(support)::BIGINT AS n, (sum(support) - sum(tp))::BIGINT AS errors,
        round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
        round(sum(precision * support) / sum(support), 6) AS precision_weighted,
        round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(avg(f1), 6) AS f1_macro
        FROM rep GROUP BY {by})"""


@query(
    f"""{BASE}, {report_sql('top', 'model')}
    SELECT model, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           support FROM rep"""
)
def class_report(spark, sf_dir):
    return round6(metrics.class_report(_top(spark, sf_dir), ["model"]))


@query(f"{BASE}, {report_sql('top', 'model')} SELECT * FROM quality")
def weighted_metrics(spark, sf_dir):
    return round6(metrics.summary(_top(spark, sf_dir), ["model"]))


@query(
    f"""{BASE}, {report_sql('top', 'model')}
    SELECT * FROM quality ORDER BY f1_weighted DESC, accuracy DESC, model LIMIT 2"""
)
def leaderboard(spark, sf_dir):
    """The two models at the head of the board."""
    return ensemble.leaderboard(round6(metrics.summary(_top(spark, sf_dir), ["model"]))).limit(2)


_VIEWS = """
viewed AS (
  SELECT 'multiclass' AS "view", model, y_true, y_pred FROM top
  UNION ALL SELECT 'binary_spam', model, CASE y_true WHEN 'c3' THEN 'c3' ELSE 'non_spam' END,
                   CASE y_pred WHEN 'c3' THEN 'c3' ELSE 'non_spam' END FROM top
  UNION ALL SELECT 'nonspam_intents', model, y_true, y_pred FROM top WHERE y_true <> 'c3')"""


@query(f"{BASE}, {_VIEWS}, {report_sql('viewed', 'model, view')} SELECT * FROM quality")
def metric_views(spark, sf_dir):
    return round6(metrics.metric_views(_top(spark, sf_dir), "c3", ["model"]))


_SUBSETS = """
marked AS (SELECT t.*, lower(trim(u.is_synthetic)) IN ('1','true','yes','y','synthetic','синтетика') AS s
           FROM top t JOIN truth u USING (row_id)),
subs AS (SELECT 'all' AS subset, * FROM marked UNION ALL
         SELECT CASE WHEN s THEN 'synthetic' ELSE 'real' END, * FROM marked)"""


@query(f"{BASE}, {TRUTH_SQL}, {_SUBSETS}, {report_sql('subs', 'model, subset')} SELECT * FROM quality")
def subset_metrics(spark, sf_dir):
    top = _top(spark, sf_dir).join(sample.truth(spark, sf_dir).drop("y_true"), "row_id")
    return round6(metrics.subset_summary(top, "is_synthetic", ["model"]))


@query(f"{BASE} SELECT model, row_id, y_true, y_pred, round(confidence, 6) AS confidence FROM top WHERE y_true = 'c2' AND y_pred <> y_true")
def error_rows(spark, sf_dir):
    wrong = report.confusion_examples(_top(spark, sf_dir), true_label="c2")
    return round6(wrong.select("model", "row_id", "y_true", "y_pred", "confidence"))


@query(
    f"""{BASE}
    SELECT model, round(avg(confidence), 6) AS confidence_mean, round(quantile_cont(confidence, 0.9), 6) AS confidence_p90,
           round(count(*) FILTER (confidence >= 0.2) / count(*)::DOUBLE, 6) AS high_conf_share,
           round(count(*) FILTER (confidence >= 0.2 AND y_true = y_pred) / count(*) FILTER (confidence >= 0.2)::DOUBLE, 6) AS high_conf_accuracy,
           count(*) FILTER (confidence >= 0.2 AND y_true <> y_pred) AS high_conf_errors
    FROM top GROUP BY model"""
)
def confidence_summary(spark, sf_dir):
    return round6(metrics.confidence_summary(_top(spark, sf_dir), threshold=0.2, by=["model"]))


@query(
    f"""{BASE}, f AS (SELECT *, row_id % 5 AS fold FROM top), {report_sql('f', 'model, fold')}
    SELECT model, round(avg(sum_f1), 6) AS f1_mean, round(stddev_pop(sum_f1), 6) AS f1_std, count(*) AS folds
    FROM (SELECT model, fold, sum(f1 * support) / sum(support) AS sum_f1 FROM rep GROUP BY model, fold) GROUP BY model"""
)
def fold_scores(spark, sf_dir):
    top = _top(spark, sf_dir).withColumn("fold", F.col("row_id") % 5)
    return round6(metrics.fold_scores(top, ["model"]))


# Ensembles --------------------------------------------------------------------------------------

_MEAN = "mean AS (SELECT row_id, label, round(avg(proba), 12) AS p FROM probs GROUP BY ALL)"


@query(
    f"""WITH {PROBS_SQL}, {_MEAN}
    SELECT row_id, first(label ORDER BY p DESC, label) AS y_pred, round(max(p), 6) AS confidence FROM mean GROUP BY row_id"""
)
def soft_vote(spark, sf_dir):
    return round6(_voted(spark, sf_dir, "soft"))


@query(
    f"""WITH {PROBS_SQL}, m AS (SELECT row_id, label, max(proba) AS p FROM probs GROUP BY ALL)
    SELECT row_id, first(label ORDER BY p DESC, label) AS y_pred, round(max(p), 6) AS confidence FROM m GROUP BY row_id"""
)
def max_vote(spark, sf_dir):
    return round6(_voted(spark, sf_dir, "max"))


_HARD = f"""{_MEAN},
votes AS (SELECT row_id, y_pred AS label, count(*) AS n FROM top GROUP BY ALL),
hard AS (SELECT row_id, first(label ORDER BY coalesce(n, 0) DESC, p DESC, label) AS y_pred, max(p) AS confidence
         FROM mean LEFT JOIN votes USING (row_id, label) GROUP BY row_id)"""


@query(f"{BASE}, {_HARD} SELECT row_id, y_pred, round(confidence, 6) AS confidence FROM hard")
def hard_vote(spark, sf_dir):
    return round6(_voted(spark, sf_dir, "hard"))


@query(
    f"""{BASE} SELECT row_id, max(y_pred) FILTER (model = 'm0') AS m0, max(y_pred) FILTER (model = 'm1') AS m1,
               max(y_pred) FILTER (model = 'm2') AS m2 FROM top GROUP BY row_id"""
)
def side_by_side(spark, sf_dir):
    return ensemble.side_by_side(_top(spark, sf_dir), ["m0", "m1", "m2"])


@query(
    f"""WITH {PROBS_SQL}, names(label) AS (VALUES ('c1'), ('c4'), ('c9'), ('zz'))
    SELECT row_id, model, n.label, round(coalesce(max(proba) FILTER (p.label = n.label), 0), 6) AS proba
    FROM probs p, names n GROUP BY row_id, model, n.label"""
)
def aligned_labels(spark, sf_dir):
    names = spark.createDataFrame([("zz",), ("c1",), ("c9",), ("c4",)], "label string")
    return round6(ensemble.align_labels(sample.probabilities(spark, sf_dir), names))


@query(
    f"""WITH {PROBS_SQL}
    , places AS (SELECT row_id, p, max(CASE WHEN (row_id + p) % 7 = 0 THEN 0 ELSE proba END) FILTER (
             model = 'm' || (2 - p // 10) AND label = 'c' || (p % 10)) AS v
           FROM probs, range(30) t(p) GROUP BY ALL)
    SELECT row_id, p::INT AS place, round(v, 6) AS value FROM places"""
)
def meta_features(spark, sf_dir):
    probs = sample.probabilities(spark, sf_dir)
    # All thirty places; every seventh cell is missing and counts as 0.
    place = (2 - F.substring("model", 2, 9).cast("int")) * 10 + F.substring("label", 2, 9).cast("int")
    probs = probs.where((F.col("row_id") + place) % 7 != 0)
    meta = ensemble.meta_features(probs, ["m2", "m1", "m0"], [f"c{i}" for i in range(10)])
    return round6(meta.select("row_id", F.posexplode("meta").alias("place", "value")))


@query(
    f"""WITH {PROBS_SQL}, {LOGITS_SQL}
    SELECT row_id, label, round(exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w), 6) AS proba
    FROM logits WINDOW w AS (PARTITION BY row_id)"""
)
def softmax_scores(spark, sf_dir):
    scores = sample.logits(spark, sf_dir).withColumnRenamed("logit", "score")
    return round6(ensemble.softmax_scores(scores, ["row_id"]))


_STAGES = """
stages AS (
  SELECT row_id, CASE WHEN max(y_pred) FILTER (model = 'm0') IN ('c0', 'c1') THEN 'spam' ELSE 'non_spam' END AS spam_pred,
         max(confidence) FILTER (model = 'm0') AS spam_conf, max(y_pred) FILTER (model = 'm1') AS intent_pred,
         max(confidence) FILTER (model = 'm1') AS intent_conf FROM top GROUP BY row_id),
routed AS (
  SELECT row_id, CASE spam_pred WHEN 'spam' THEN 'spam' ELSE intent_pred END AS y_pred,
         CASE spam_pred WHEN 'spam' THEN spam_conf ELSE least(spam_conf, intent_conf) END AS confidence FROM stages)"""


def _stages(spark, sf_dir):
    top = _top(spark, sf_dir)

    def of(model, column):
        return F.max(F.when(F.col("model") == model, F.col(column)))

    return top.groupBy("row_id").agg(
        F.when(of("m0", "y_pred").isin("c0", "c1"), "spam").otherwise("non_spam").alias("spam_pred"),
        of("m0", "confidence").alias("spam_conf"),
        of("m1", "y_pred").alias("intent_pred"),
        of("m1", "confidence").alias("intent_conf"),
    )


@query(
    f"""{BASE}, {_STAGES} SELECT row_id, y_pred, round(confidence, 6) AS confidence,
    CASE WHEN y_pred <> 'spam' AND confidence >= 0.2 THEN 'auto' ELSE 'review' END AS route FROM routed"""
)
def two_stage(spark, sf_dir):
    routed = ensemble.route_calls(_stages(spark, sf_dir), 0.2)
    return round6(routed.select("row_id", "y_pred", "confidence", "route"))


@query(
    f"""{BASE}, {_STAGES} SELECT count(*) FILTER (y_pred <> 'spam' AND confidence >= 0.2) AS auto_ticket_allowed,
    count(*) FILTER (NOT (y_pred <> 'spam' AND confidence >= 0.2)) AS review_required FROM routed"""
)
def routing_counts(spark, sf_dir):
    return ensemble.routing_counts(ensemble.route_calls(_stages(spark, sf_dir), 0.2))


_ALL = f"""{_HARD},
soft AS (SELECT row_id, first(label ORDER BY p DESC, label) AS y_pred, max(p) AS confidence FROM mean GROUP BY row_id),
every AS (
  SELECT row_id, model, 'base' AS method, y_true, y_pred, confidence FROM top
  UNION ALL SELECT row_id, 'Ensemble (soft)', 'soft', y_true, y_pred, confidence FROM soft JOIN truth USING (row_id)
  UNION ALL SELECT row_id, 'Ensemble (hard)', 'hard', y_true, y_pred, confidence FROM hard JOIN truth USING (row_id))"""


@query(
    f"""{BASE}, {TRUTH_SQL}, {_ALL}, {report_sql('every', 'model, method')}
    SELECT q.model, q.method, q.n AS n_samples, q.errors, q.accuracy, q.f1_weighted, q.precision_weighted, q.recall_weighted,
      round(avg(confidence), 6) AS confidence_mean, round(quantile_cont(confidence, 0.9), 6) AS confidence_p90,
      CASE q.method WHEN 'base' THEN 1 ELSE 3 END::BIGINT AS component_count,
      CASE q.method WHEN 'base' THEN CASE q.model WHEN 'm0' THEN 10.0 WHEN 'm1' THEN 20.0 ELSE 40.0 END ELSE 70.0 END::DOUBLE AS model_size_mb,
      CASE q.model WHEN 'm0' THEN 5 WHEN 'm1' THEN 6 END::BIGINT AS n_params,
      round(count(*) FILTER (confidence >= 0.2) / count(*)::DOUBLE, 6) AS high_conf_share,
      count(*) FILTER (confidence >= 0.2 AND y_pred <> y_true) AS high_conf_errors,
      CASE q.method WHEN 'base' THEN CASE q.model WHEN 'm0' THEN 100.0 WHEN 'm1' THEN 200.0 ELSE 400.0 END ELSE 700.0 END::DOUBLE AS infer_ms_total,
      round(CASE q.method WHEN 'base' THEN CASE q.model WHEN 'm0' THEN 100.0 WHEN 'm1' THEN 200.0 ELSE 400.0 END ELSE 700.0 END::DOUBLE / q.n, 3) AS infer_ms_per_sample
    FROM quality q JOIN every e USING (model, method) GROUP BY ALL"""
)
def model_comparison(spark, sf_dir):
    costs = spark.createDataFrame(
        [("m0", "a", 100.0, 10.0, 5), ("m1", "a", 200.0, 20.0, 6), ("m2", "b", 400.0, 40.0, None)],
        "model string, family string, infer_ms_total double, model_size_mb double, n_params long",
    )
    probs, truth = sample.probabilities(spark, sf_dir), sample.truth(spark, sf_dir)
    table_ = ensemble.compare_models(probs.drop("y_true"), truth, costs, ["soft", "hard"], 0.2)
    return round6(
        table_.select(
            "model", "method", "n_samples", "errors", "accuracy", "f1_weighted", "precision_weighted",
            "recall_weighted", "confidence_mean", "confidence_p90", "component_count", "model_size_mb",
            "n_params", "high_conf_share", "high_conf_errors", "infer_ms_total", "infer_ms_per_sample",
        )
    )


@query(
    f"""{BASE}, {TRUTH_SQL}, {_ALL},
    marked2 AS (SELECT e.*, lower(trim(u.is_synthetic)) IN ('yes', 'synthetic') AS s FROM every e JOIN truth u USING (row_id)),
    subs2 AS (SELECT 'all' AS subset, * FROM marked2 UNION ALL SELECT CASE WHEN s THEN 'synthetic' ELSE 'real' END, * FROM marked2),
    {report_sql('subs2', 'model, method, subset')} SELECT * FROM quality"""
)
def external_evaluation(spark, sf_dir):
    votes = ensemble.all_votes(sample.probabilities(spark, sf_dir).drop("y_true"), ["soft", "hard"])
    return round6(ensemble.external_evaluation(votes, sample.truth(spark, sf_dir)))


# Calibration ------------------------------------------------------------------------------------

_BINS = "ceil(confidence * 10)::INT - 1"


@query(
    f"""{BASE}, b AS (SELECT model, {_BINS} AS bin, sum(confidence) AS c, count(*) FILTER (y_true = y_pred) AS ok FROM top GROUP BY ALL)
    SELECT model, round(sum(abs(c - ok)) / (SELECT count(*) / 3 FROM top), 6) AS ece FROM b GROUP BY model"""
)
def ece(spark, sf_dir):
    return round6(calibrate.ece(_top(spark, sf_dir), by=["model"]))


@query(
    f"""{BASE}, b AS (SELECT {_BINS} AS bin, avg(confidence) AS confidence, avg((y_true = y_pred)::INT) AS accuracy,
                      count(*) AS n FROM top GROUP BY ALL)
    SELECT g.i::INT AS bin, round(coalesce(confidence, (g.i + 0.5) / 10), 6) AS confidence, round(accuracy, 6) AS accuracy,
           coalesce(n, 0) AS n, round(g.i / 10.0::DOUBLE, 6) AS lo, round((g.i + 1) / 10.0::DOUBLE, 6) AS hi
    FROM range(10) g(i) LEFT JOIN b ON b.bin = g.i"""
)
def reliability(spark, sf_dir):
    return round6(calibrate.reliability(_top(spark, sf_dir)))


@query(
    f"""{BASE}, t AS (SELECT CASE WHEN confidence <= 0.15 THEN 0 WHEN confidence <= 0.2 THEN 1 ELSE 2 END AS tier, y_true = y_pred AS ok FROM top)
    SELECT tier::INT AS tier, count(ok) AS count, round(count(ok) / (SELECT count(*) FROM t)::DOUBLE, 6) AS coverage,
           round(avg(ok::INT), 6) AS accuracy FROM t GROUP BY tier"""
)
def tiers(spark, sf_dir):
    return round6(calibrate.tiers(_top(spark, sf_dir), [0.2, 0.15]).drop("name"))


@query(
    f"""WITH {PROBS_SQL}
    SELECT model, round(sum((proba - (label = y_true)::INT) ** 2) / count(DISTINCT row_id), 6) AS brier FROM probs GROUP BY model"""
)
def brier(spark, sf_dir):
    return round6(calibrate.brier(sample.probabilities(spark, sf_dir), ["model"]))


@query(f"WITH {PROBS_SQL} SELECT model, round(avg(-ln(proba + 1e-9)), 6) AS nll FROM probs WHERE label = y_true GROUP BY model")
def nll(spark, sf_dir):
    return round6(calibrate.nll(sample.probabilities(spark, sf_dir), ["model"]))


@query(
    f"""WITH {PROBS_SQL}, {LOGITS_SQL}, g(t) AS (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0), (4.0)),
    p AS (SELECT t, label = y_true AS hit, exp(logit / t) / sum(exp(logit / t)) OVER (PARTITION BY row_id, t) AS p FROM logits, g)
    SELECT t AS temperature, round(avg(-ln(p + 1e-9)), 6) AS nll FROM p WHERE hit GROUP BY t"""
)
def temperature_nll_grid(spark, sf_dir):
    dense = calibrate.dense_logits(sample.logits(spark, sf_dir))
    return round6(calibrate.temperature_grid(dense, [0.5, 1.0, 1.5, 2.0, 4.0]))


#: Temperatures over the whole range of the search.
_FINE = [round(0.1 * i, 1) for i in range(1, 101)]


@query(
    f"""WITH {PROBS_SQL}, {LOGITS_SQL}, g(t) AS (SELECT i / 10.0::DOUBLE FROM range(1, 101) r(i)),
    p AS (SELECT t, label = y_true AS hit, exp((logit - top) / t) / sum(exp((logit - top) / t)) OVER (PARTITION BY row_id, t) AS p
          FROM (SELECT *, max(logit) OVER (PARTITION BY row_id) AS top FROM logits), g),
    losses AS (SELECT t, avg(-ln(p + 1e-9)) AS nll FROM p WHERE hit GROUP BY t)
    SELECT round(min(nll), 5) AS grid_nll, true AS as_low_as_all, true AS beside_best FROM losses"""
)
def temperature_fit(spark, sf_dir):
    """The fitted temperature against every temperature of a fine grid: its loss is not above any of theirs."""
    logits = sample.logits(spark, sf_dir)
    t = calibrate.fit_temperature(logits)
    dense = checkpointed(calibrate.dense_logits(logits))
    grid = calibrate.temperature_grid(dense, _FINE)
    own = calibrate.temperature_grid(dense, [t]).first()["nll"]
    best = grid.agg(F.min("nll").alias("nll"), F.min_by("temperature", "nll").alias("at"))
    return best.select(
        F.round("nll", 5).alias("grid_nll"),
        (F.lit(own) <= F.col("nll") + 1e-9).alias("as_low_as_all"),
        (F.abs(F.col("at") - t) <= 0.1).alias("beside_best"),
    )


def _both_stages_sql(t: float) -> str:
    """Scores of the probabilities at temperature 1 and ``t``."""
    return f"""
    p AS (SELECT stage, row_id, label, y_true, exp(logit / t) / sum(exp(logit / t)) OVER (PARTITION BY stage, row_id) AS p
          FROM logits, (VALUES ('before', 1.0::DOUBLE), ('after', {t})) v(stage, t)),
    h AS (SELECT stage, row_id, y_true, first(label ORDER BY p DESC, label) AS y_pred, max(p) AS confidence FROM p GROUP BY ALL),
    {report_sql('h', 'stage')},
    scores AS (
      SELECT stage, 'brier' AS metric, sum((p - (label = y_true)::INT) ** 2) / count(DISTINCT row_id) AS value FROM p GROUP BY stage
      UNION ALL SELECT stage, 'nll', avg(-ln(p + 1e-9)) FROM p WHERE label = y_true GROUP BY stage
      UNION ALL SELECT stage, 'f1_weighted', sum(f1 * support) / sum(support) FROM rep GROUP BY stage
      UNION ALL SELECT stage, 'ece', sum(abs(c - ok)) / sum(n) FROM (
        SELECT stage, {_BINS} AS bin, sum(confidence) AS c, count(*) FILTER (y_true = y_pred) AS ok, count(*) AS n FROM h GROUP BY ALL) GROUP BY stage)"""


@query(
    f"""WITH {PROBS_SQL}, {LOGITS_SQL}, {_both_stages_sql(2.0)}
    SELECT metric, round(max(value) FILTER (stage = 'before'), 6) AS before, round(max(value) FILTER (stage = 'after'), 6) AS after,
           round(max(value) FILTER (stage = 'after') - max(value) FILTER (stage = 'before'), 6) AS delta FROM scores GROUP BY metric"""
)
def scaled_calibration(spark, sf_dir):
    """Calibration scores before and after scaling with a temperature of 2."""
    return round6(calibrate.calibration_report(sample.logits(spark, sf_dir), 2.0))


# Thresholds -------------------------------------------------------------------------------------

_SWEEP = f"""
WITH {BINARY_SQL},
s AS (SELECT confidence AS score, count(*) FILTER (manual_label = 'spam') AS pos,
             count(*) FILTER (manual_label <> 'spam') AS neg FROM scored GROUP BY 1),
r AS (SELECT score, lag(score) OVER w AS before, sum(pos) OVER w - pos AS pb, sum(neg) OVER w - neg AS nb,
             sum(pos) OVER () AS ap, sum(neg) OVER () AS an, max(score) OVER () AS hi, min(score) OVER () AS lo
      FROM s WINDOW w AS (ORDER BY score)),
c AS (SELECT CASE WHEN before IS NULL THEN score - greatest(1e-9, (hi - lo) * 1e-6, 1e-6) ELSE (before + score) / 2 END AS threshold,
             pb, nb, ap, an FROM r
      UNION ALL SELECT hi + greatest(1e-9, (hi - lo) * 1e-6, 1e-6), ap, an, ap, an FROM r WHERE score = hi),
m AS (SELECT threshold, (ap - pb)::BIGINT AS tp, (an - nb)::BIGINT AS fp, nb::BIGINT AS tn, pb::BIGINT AS fn FROM c),
q AS (SELECT *, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS spam_precision,
             coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS spam_recall, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity FROM m),
sweep AS (SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(spam_precision, 6) AS spam_precision,
       round(spam_recall, 6) AS spam_recall, round(specificity, 6) AS specificity, round((spam_recall + specificity) / 2, 6) AS balanced_accuracy,
       round(coalesce(2 * spam_precision * spam_recall / nullif(spam_precision + spam_recall, 0), 0), 6) AS spam_f1,
       round(spam_recall + specificity - 1, 6) AS youden_j, tp + fp AS pred_spam, tn + fn AS pred_non_spam FROM q)"""


# With the rule "at most" the rows below a threshold are the hits.
_SWEEP_BELOW = _SWEEP.replace(
    "(ap - pb)::BIGINT AS tp, (an - nb)::BIGINT AS fp, nb::BIGINT AS tn, pb::BIGINT AS fn",
    "pb::BIGINT AS tp, nb::BIGINT AS fp, (an - nb)::BIGINT AS tn, (ap - pb)::BIGINT AS fn",
)


@query(f"{_SWEEP_BELOW} SELECT * FROM sweep")
def threshold_sweep_below(spark, sf_dir):
    """Scores at most the threshold count as positive."""
    return round6(threshold.threshold_sweep(sample.binary_scores(spark, sf_dir), rule="less_equal"))


@query(f"{_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf_dir):
    return round6(threshold.threshold_sweep(sample.binary_scores(spark, sf_dir)))


@query(
    f"""{_SWEEP} SELECT threshold, accuracy, balanced_accuracy, spam_f1 FROM sweep
    ORDER BY accuracy DESC, balanced_accuracy DESC, spam_f1 DESC, threshold LIMIT 10"""
)
def best_thresholds(spark, sf_dir):
    sweep = threshold.threshold_sweep(sample.binary_scores(spark, sf_dir))
    best = threshold.best_thresholds(sweep, "accuracy", 10)
    return round6(best.select("threshold", "accuracy", "balanced_accuracy", "spam_f1"))


@query(
    f"""{_SWEEP} SELECT threshold, youden_j FROM sweep
    ORDER BY youden_j DESC, balanced_accuracy DESC, spam_f1 DESC, accuracy DESC, threshold LIMIT 1"""
)
def best_youden_threshold(spark, sf_dir):
    sweep = threshold.threshold_sweep(sample.binary_scores(spark, sf_dir))
    return round6(threshold.best_thresholds(sweep, "youden_j").select("threshold", "youden_j"))


_DOWN = f"""
WITH {BINARY_SQL},
s AS (SELECT confidence AS score, count(*) FILTER (manual_label = 'spam') AS pos,
             count(*) FILTER (manual_label <> 'spam') AS neg FROM scored GROUP BY 1),
d AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an,
             lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn FROM s WINDOW w AS (ORDER BY score DESC))"""


@query(f"{_DOWN} SELECT round(sum(neg * (2 * tp - pos) / 2.0) / (max(ap) * max(an))::DOUBLE, 6) AS roc_auc FROM d")
def roc_auc(spark, sf_dir):
    return round6(threshold.roc_auc(sample.binary_scores(spark, sf_dir), "confidence", "manual_label", "spam"))


@query(f"{_DOWN} SELECT round(sum(pos * (tp / (tp + fp)::DOUBLE)) / max(ap)::DOUBLE, 6) AS average_precision FROM d")
def average_precision(spark, sf_dir):
    scores = sample.binary_scores(spark, sf_dir)
    return round6(threshold.average_precision(scores, "confidence", "manual_label", "spam"))


@query(
    f"""{_DOWN} SELECT round(fp / an::DOUBLE, 6) AS fpr, round(tp / ap::DOUBLE, 6) AS tpr, score AS threshold_score FROM d
    WHERE rn = 1 OR np IS NULL OR pos <> np OR neg <> nn"""
)
def roc_curve(spark, sf_dir):
    scores = sample.binary_scores(spark, sf_dir)
    curve = threshold.roc_curve(scores, "confidence", "manual_label", "spam")
    return round6(curve.where("threshold_score <> double('infinity')"))


@query(
    f"""{_DOWN} SELECT round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / ap::DOUBLE, 6) AS recall, score AS threshold_score FROM d
    UNION ALL SELECT 1.0, 0.0, NULL"""
)
def pr_curve(spark, sf_dir):
    scores = sample.binary_scores(spark, sf_dir)
    return round6(threshold.pr_curve(scores, "confidence", "manual_label", "spam"))


@query(
    f"""WITH {BINARY_SQL}, z AS (SELECT CASE WHEN confidence >= 3000 THEN 'block' WHEN confidence >= 800 THEN 'review' ELSE 'allow' END AS zone,
       manual_label FROM scored)
    SELECT n.zone, count(manual_label) AS count, round(count(manual_label) / (SELECT count(*) FROM z)::DOUBLE, 6) AS coverage,
      round(coalesce(avg((manual_label = 'spam')::INT), 0), 6) AS spam_share, round(coalesce(avg((manual_label = 'non_spam')::INT), 0), 6) AS non_spam_share
    FROM (VALUES ('block'), ('review'), ('allow')) n(zone) LEFT JOIN z USING (zone) GROUP BY n.zone"""
)
def zones(spark, sf_dir):
    scores = sample.binary_scores(spark, sf_dir)
    return round6(threshold.zone_policy(scores, "confidence", "manual_label", 800, 3000))


# Neighbours -------------------------------------------------------------------------------------

_NEAR = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT a.vec_id AS id, b.vec_id AS near_id, b.label, round(list_cosine_similarity(a.e, b.e), 9) AS similarity
      FROM v a JOIN v b ON a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, near_id) AS rank FROM s QUALIFY rank <= 5)"""


def _near(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", neighbours.sparse("embedding")
    )
    return neighbours.nearest(rows, rows, 5, skip_self=True)


@query(f"{_NEAR} SELECT id, rank::INT AS rank, near_id, round(similarity, 6) AS similarity FROM near")
def knn_cosine(spark, sf_dir):
    return round6(_near(spark, sf_dir).select("id", "rank", "near_id", "similarity"))


@query(
    f"""{_NEAR}, c AS (SELECT id, label, count(*) AS n FROM near GROUP BY ALL)
    SELECT id, first(label ORDER BY n DESC, label) AS y_pred, round(max(n) / 5.0, 6) AS confidence FROM c GROUP BY id"""
)
def knn_vote(spark, sf_dir):
    return round6(neighbours.vote_of_neighbours(_near(spark, sf_dir)))


# Reports ----------------------------------------------------------------------------------------

@query(
    """
    WITH r AS (SELECT event_id, value, (event_id * 37 % 1000) / 1000.0::DOUBLE AS f1 FROM events WHERE value > 0),
    b AS (SELECT *, max(f1) OVER (ORDER BY value, f1 DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r)
    SELECT event_id, value, f1 FROM b WHERE f1 > coalesce(best, -1) + 1e-12"""
)
def pareto(spark, sf_dir):
    gain = (F.col("event_id") * 37 % 1000) / F.lit(1000.0)
    runs = table(spark, sf_dir, "events").select("event_id", "value", gain.alias("f1"))
    front = report.pareto_frontier(runs.withColumnRenamed("event_id", "model"), "value", "f1")
    return front.withColumnRenamed("model", "event_id")


_RUNS = """
runs AS (SELECT 'u' || user_id AS model, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round(value) END AS f1_weighted,
                CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 50)::DOUBLE END AS accuracy, event_id AS max_length FROM events)"""


def _runs(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("model"),
        F.when(n % 4 != 0, F.round("value")).alias("f1_weighted"),
        F.when(n % 3 != 0, (n % 50).cast("double")).alias("accuracy"),
        n.alias("max_length"),
    )


@query(
    f"""WITH {_RUNS} SELECT model, f1_weighted, accuracy, max_length FROM runs
    QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1_weighted DESC NULLS LAST, accuracy DESC NULLS LAST, max_length) = 1"""
)
def best_per_model(spark, sf_dir):
    return report.best_per_model(_runs(spark, sf_dir))


@query(
    f"""WITH {_RUNS} SELECT model,
      first(f1_weighted ORDER BY f1_weighted DESC NULLS LAST, accuracy DESC NULLS LAST, max_length) AS f1_weighted,
      first(accuracy ORDER BY f1_weighted DESC NULLS LAST, accuracy DESC NULLS LAST, max_length) FILTER (accuracy IS NOT NULL) AS accuracy,
      first(max_length ORDER BY f1_weighted DESC NULLS LAST, accuracy DESC NULLS LAST, max_length) AS max_length
    FROM runs GROUP BY model"""
)
def best_per_model_by_column(spark, sf_dir):
    return report.best_per_model(_runs(spark, sf_dir), strict_reference=True)


@query(
    """
    WITH t AS (SELECT 'u' || user_id AS model, value AS f1_weighted, event_type AS source_dir FROM events)
    SELECT model, max(f1_weighted) AS f1_weighted, first(source_dir ORDER BY f1_weighted DESC, source_dir) AS source_dir
    FROM t GROUP BY model"""
)
def merged_leaderboard(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("model"), F.col("value").alias("f1_weighted"), "props", "event_type"
    )
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # one table each
    parts = []
    for i, kind in enumerate(kinds):
        part = events.where(F.col("event_type") == kind).withColumn("source_dir", F.col("event_type"))
        notes = part.withColumn("notes", F.col("props")) if i % 2 else part  # tables may lack a column
        parts.append(notes.drop("props", "event_type"))
    merged = report.merged_leaderboard(parts, best_only=True)
    return merged.select("model", "f1_weighted", "source_dir")


@query(
    f"""{BASE}, {report_sql('top', 'model')}
    SELECT model, 'baseline' AS "group", format('{{:.4f}}', sum(f1 * support) / sum(support))::DOUBLE AS f1_weighted,
      format('{{:.4f}}', sum(precision * support) / sum(support))::DOUBLE AS precision,
      format('{{:.4f}}', sum(recall * support) / sum(support))::DOUBLE AS recall,
      format('{{:.3f}}', 1234.5 / sum(support))::DOUBLE AS infer_ms_per_sample, count(*)::INT AS n_labels,
      max(support) FILTER (label = 'c7')::BIGINT AS c7_support
    FROM rep GROUP BY model"""
)
def result_records(spark, sf_dir):
    runs = spark.createDataFrame(
        [(f"m{i}", "baseline", 1.0, 1234.5, "low", "") for i in range(3)],
        "model string, group string, train_sec double, infer_ms_total double, resource string, notes string",
    )
    records = report.result_records(_top(spark, sf_dir), runs)
    return records.select(
        "model", "group", "f1_weighted", "precision", "recall", "infer_ms_per_sample",
        F.size("report").alias("n_labels"), F.col("report")["c7"]["support"].alias("c7_support"),
    )


@query(
    """
    WITH m AS (SELECT vec_id AS row_id, embedding[1]::DOUBLE * 8 AS s FROM embeddings)
    SELECT row_id, CASE WHEN s > 0 THEN 'pos' ELSE 'neg' END AS y_pred, round(abs(s), 6) AS confidence,
           round(1 / (1 + exp(-2 * s)), 6) AS proba FROM m"""
)
def margin_probabilities(spark, sf_dir):
    """One margin per row as two scores, their softmax, and the size of the margin."""
    from talkmill.functions.numbers import margin_columns, margin_confidence, top_label

    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.get("embedding", F.lit(0)).cast("double") * 8).alias("s")
    )
    scores = rows.select("row_id", F.inline(margin_columns("s", "neg", "pos")))
    probs = ensemble.softmax_scores(scores, ["row_id"])
    top = probs.groupBy("row_id").agg(
        top_label("label", "proba").alias("y_pred"),
        F.max(F.when(F.col("label") == "pos", F.col("proba"))).alias("proba"),
    )
    sure = rows.select("row_id", margin_confidence(F.array("s")).alias("confidence"))
    return round6(top.join(sure, "row_id"))


@query(
    """
    WITH t AS (SELECT event_type, round(avg(value), 6) AS latency, -count(*)::DOUBLE AS rank_cost FROM events GROUP BY 1)
    SELECT 'latency' AS metric, first(event_type ORDER BY latency, event_type) AS best, min(latency) AS value FROM t
    UNION ALL SELECT 'rank_cost', first(event_type ORDER BY rank_cost, event_type), min(rank_cost) FROM t"""
)
def winners(spark, sf_dir):
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("latency"), (-F.count("*")).cast("double").alias("rank_cost")
    )
    return report.winners(events, "event_type", ["latency", "rank_cost"])


@query(
    f"""WITH {BINARY_SQL} SELECT manual_label, count(*) AS n FROM scored GROUP BY 1"""
)
def checked_labels(spark, sf_dir):
    """Labels with stray spaces and blanks, checked against the two that may occur."""
    from talkmill.operators.labels import binary_labels

    scores = sample.binary_scores(spark, sf_dir)
    messy = scores.withColumn("manual_label", F.concat(F.lit(" "), "manual_label", F.lit("\t")))
    blank = messy.withColumn("manual_label", F.lit(" "))
    good = binary_labels(messy.unionByName(blank), "manual_label", "spam", "non_spam")
    return good.groupBy("manual_label").agg(F.count("*").alias("n"))
