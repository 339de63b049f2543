"""Voting, stacking features, two-stage routing and model comparison on probability tables.

Probabilities are long: ``(row_id, model, label, proba)``. The rows are placed by ``row_id``
once, and every step of a vote works on that placement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.functions.columns import ColumnLike, col, literal_array
from talkmill.functions.numbers import softmax
from talkmill.operators.labels import unseen_labels
from talkmill.operators.metrics import confidence_summary, subset_summary, summary
from talkmill.session import checked_broadcast, checkpointed

# Means of the same numbers in another order may differ in the last bits; votes compare this many
# decimals, so a tie is a tie on every run.
TIE_DIGITS = 12


def softmax_scores(scores: DataFrame, by: Sequence[str] = ("row_id", "model")) -> DataFrame:
    """Probabilities from long scores ``(row_id, model, label, score)``."""
    cell = F.struct("label", F.col("score").cast("double").alias("score"))
    grouped = scores.groupBy(*by).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    names = F.transform("cells", lambda c: c["label"])
    values = F.transform("cells", lambda c: c["score"])
    pairs = F.arrays_zip(names.alias("label"), softmax(values).alias("proba"))
    return grouped.select(*by, F.inline(pairs))


def align_labels(probs: DataFrame, labels: DataFrame) -> DataFrame:
    """Give every row and model each label of ``labels``: missing ones 0, others left out.

    Probabilities are not scaled again. ``labels`` is a table of class names; the labels of one
    row and model meet in one map.
    """
    one = labels.select("label").distinct()
    names = one.agg(F.sort_array(F.collect_set("label"))).scalar()
    maps = probs.groupBy("row_id", "model").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "proba"))).alias("__p")
    )
    cells = F.transform(
        F.col("__names"),
        lambda n: F.struct(
            n.alias("label"), F.coalesce(F.try_element_at("__p", n), F.lit(0.0)).alias("proba")
        ),
    )
    return maps.withColumn("__names", names).select("row_id", "model", F.inline(cells))


def _by_row(probs: DataFrame) -> DataFrame:
    return probs.repartition("row_id")


def _pick(scored: DataFrame, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.min_by("label", F.struct((-F.col("proba")).alias("p"), F.col("label").alias("l"))).alias("y_pred"),
        F.max("proba").alias("confidence"),
    )


def base_predictions(probs: DataFrame) -> DataFrame:
    """Each model's own label and confidence per row."""
    return all_votes(probs, ()).drop("method")


def _mean_proba(probs: DataFrame) -> DataFrame:
    mean = F.round(F.avg("proba"), TIE_DIGITS)
    return probs.groupBy("row_id", "label").agg(mean.alias("proba"))


def soft_vote(probs: DataFrame) -> DataFrame:
    """Label with the largest mean probability."""
    return _pick(_mean_proba(_by_row(probs)))


def max_vote(probs: DataFrame) -> DataFrame:
    """Label with the largest probability of any model."""
    return _pick(_by_row(probs).groupBy("row_id", "label").agg(F.max("proba").alias("proba")))


def _marked(probs: DataFrame) -> DataFrame:
    """Placed rows with ``vote`` 1 on the best label of each model."""
    best = W.partitionBy("row_id", "model").orderBy(F.desc("proba"), "label")
    return _by_row(probs).withColumn("vote", (F.row_number().over(best) == 1).cast("int"))


def _order(*values: str) -> Column:
    """Sort key: larger values first, then label order."""
    return F.struct(*[(-F.col(v)).alias(v) for v in values], F.col("label").alias("label"))


def hard_vote(probs: DataFrame) -> DataFrame:
    """Label most models choose; ties by mean probability, then by label order.

    The confidence is the largest mean probability, which may belong to another label.
    """
    scored = _marked(probs).groupBy("row_id", "label").agg(
        F.sum("vote").alias("votes"), F.round(F.avg("proba"), TIE_DIGITS).alias("proba")
    )
    return scored.groupBy("row_id").agg(
        F.min_by("label", _order("votes", "proba")).alias("y_pred"), F.max("proba").alias("confidence")
    )


VOTES = {"soft": soft_vote, "max": max_vote, "hard": hard_vote}


def vote(probs: DataFrame, method: str) -> DataFrame:
    if method not in VOTES:
        raise ValueError(f"unsupported method '{method}': use one of {sorted(VOTES)}")
    return VOTES[method](probs)


def all_votes(probs: DataFrame, methods: Sequence[str] = ("soft", "max", "hard")) -> DataFrame:
    """Predictions of the base models and the votes: ``(model, method, row_id, y_pred, confidence)``.

    All of them work on one placement of the rows, and all votes on one pass over it.
    """
    unknown = [m for m in methods if m not in VOTES]
    if unknown:
        raise ValueError(f"unsupported methods {unknown}: use some of {sorted(VOTES)}")
    marked = _marked(probs)
    base = marked.where("vote = 1").select(
        "row_id", F.col("label").alias("y_pred"), F.col("proba").alias("confidence"), "model",
        F.lit("base").alias("method"),
    )
    if not methods:
        return base
    scored = marked.groupBy("row_id", "label").agg(
        F.sum("vote").alias("votes"),
        F.round(F.avg("proba"), TIE_DIGITS).alias("mean"),
        F.max("proba").alias("top"),
    )
    order = {"soft": ["mean"], "max": ["top"], "hard": ["votes", "mean"]}
    sure = {"soft": "mean", "max": "top", "hard": "mean"}
    picks = [
        F.struct(
            F.min_by("label", _order(*order[m])).alias("y_pred"),
            F.max(sure[m]).alias("confidence"),
            F.lit(f"Ensemble ({m})").alias("model"),
            F.lit(m).alias("method"),
        ).alias(m)
        for m in methods
    ]
    voted = scored.groupBy("row_id").agg(*picks).select("row_id", F.inline(F.array(*methods)))
    return base.unionByName(voted)


def meta_features(
    probs: DataFrame, models: Sequence[str], labels: Sequence[str], out: str = "meta"
) -> DataFrame:
    """One array per row: probabilities of the first model in label order, then of the next, ...

    A place whose model or label a row lacks is 0, so every array has ``models`` times ``labels`` places:
    a model that never saw a class has no probability for it.
    """
    m = F.array_position(literal_array(models, "string"), F.col("model"))
    x = F.array_position(literal_array(labels, "string"), F.col("label").cast("string"))
    place = ((m - 1) * len(labels) + x - 1).cast("int")
    rows = probs.where((m > 0) & (x > 0)).select("row_id", place.alias("place"), "proba")
    cells = F.map_from_entries(F.collect_list(F.struct("place", "proba")))
    wide = F.sequence(F.lit(0), F.lit(len(models) * len(labels) - 1))
    return rows.groupBy("row_id").agg(cells.alias("__cells")).select(
        "row_id",
        F.transform(wide, lambda i: F.coalesce(F.try_element_at("__cells", i), F.lit(0.0))).alias(out),
    )


def side_by_side(predictions: DataFrame, models: Sequence[str], value: str = "y_pred") -> DataFrame:
    """One row per sample with a column per model."""
    return predictions.groupBy("row_id").pivot("model", list(models)).agg(F.first(value))


def stacker_metadata(name: str, models: Sequence[str], labels: Sequence[str]) -> dict:
    return {
        "stacker": name,
        "models": [{"name": m} for m in models],
        "labels": list(labels),
        "feature_columns": [f"{m}:{x}" for m in models for x in labels],
    }


def check_stacker(metadata: dict, models: Sequence[str], truth: DataFrame | None = None) -> list[str]:
    """Model names in the order the stacker was fitted with; an error if it does not fit."""
    expected = [m["name"] for m in metadata.get("models", [])] or list(models)
    missing = [m for m in expected if m not in models]
    if missing:
        raise ValueError(f"stacker expects models {missing}, which are not among {sorted(models)}")
    labels = metadata.get("labels") or []
    columns = metadata.get("feature_columns") or []
    if columns and labels and len(columns) != len(expected) * len(labels):
        raise ValueError(f"stacker expects {len(columns)} features, got {len(expected) * len(labels)}")
    if truth is not None and labels:
        known = truth.sparkSession.createDataFrame([(x,) for x in labels], "y_true string")
        unseen = unseen_labels(truth, known, "y_true").orderBy("y_true").limit(50).collect()
        if unseen:
            raise ValueError(f"labels the stacker has not seen: {[r[0] for r in unseen]}")
    return expected


def two_stage(
    spam_pred: ColumnLike,
    spam_conf: ColumnLike,
    intent_pred: ColumnLike,
    intent_conf: ColumnLike,
    spam_label: str = "spam",
) -> tuple[Column, Column]:
    """Label and confidence of the spam gate with the intent model behind it."""
    gate = col(spam_pred) == spam_label
    label = F.when(gate, F.lit(spam_label)).otherwise(col(intent_pred))
    sure = F.when(gate, col(spam_conf)).otherwise(F.least(col(spam_conf), col(intent_conf)))
    return label, sure


def is_auto(label: ColumnLike, confidence: ColumnLike, threshold: float, spam_label: str = "spam") -> Column:
    """Whether a call may be handled without review."""
    return (col(label) != spam_label) & (col(confidence) >= threshold)


def route_calls(
    stages: DataFrame, threshold: float = 0.8, spam_label: str = "spam"
) -> DataFrame:
    """Add the two-stage result and ``route`` to ``(spam_pred, spam_conf, intent_pred, intent_conf)``."""
    label, sure = two_stage("spam_pred", "spam_conf", "intent_pred", "intent_conf", spam_label)
    routed = stages.withColumn("y_pred", label).withColumn("confidence", sure)
    auto = is_auto("y_pred", "confidence", threshold, spam_label)
    return routed.withColumn("route", F.when(auto, "auto").otherwise("review"))


def routing_counts(routed: DataFrame) -> DataFrame:
    return routed.agg(
        F.count_if(F.col("route") == "auto").alias("auto_ticket_allowed"),
        F.count_if(F.col("route") != "auto").alias("review_required"),
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """Best first: weighted F1, accuracy, then the faster model."""
    keys = [F.desc("f1_weighted"), F.desc("accuracy")]
    if "infer_ms_per_sample" in scores.columns:
        keys.append(F.asc("infer_ms_per_sample"))
    return scores.orderBy(*keys, "model")


def compare_models(
    probs: DataFrame,
    truth: DataFrame,
    costs: DataFrame,
    methods: Sequence[str] = ("soft", "max", "hard"),
    threshold: float = 0.8,
) -> DataFrame:
    """Comparison of base models and votes: metrics, confidence, size and time.

    ``costs`` holds ``(model, family, infer_ms_total, model_size_mb, n_params)``; a vote costs
    the sum of its members, and has no parameter count if a member has none.
    """
    # Written once: metrics, confidence and quantiles all read it.
    scored = checkpointed(all_votes(probs, methods).join(truth.select("row_id", "y_true"), "row_id"))
    keys = ["model", "method"]
    quality = summary(scored, keys).withColumnRenamed("n", "n_samples").drop("f1_macro")
    sure = confidence_summary(scored, threshold=threshold, by=keys)
    base = costs.withColumn("component_count", F.lit(1).cast("long"))
    names = F.array(*[F.lit(f"Ensemble ({m})") for m in methods])
    whole = costs.agg(
        F.lit("ensemble").alias("family"),
        F.sum("infer_ms_total").alias("infer_ms_total"),
        F.sum("model_size_mb").alias("model_size_mb"),
        F.when(F.count("n_params") == F.count("*"), F.sum("n_params")).alias("n_params"),
        F.count("*").alias("component_count"),
    ).withColumn("model", F.explode(names))
    cost = base.unionByName(whole)
    per_row = F.round(F.col("infer_ms_total") / F.greatest("n_samples", F.lit(1)), 3)
    joined = quality.join(sure, keys).join(checked_broadcast(cost), "model")
    return joined.withColumn("infer_ms_per_sample", per_row)


def external_evaluation(
    predictions: DataFrame, truth: DataFrame, flag: str = "is_synthetic"
) -> DataFrame:
    """Metrics per model, method and subset of rows; empty subsets do not appear."""
    columns = ["row_id", "y_true"] + ([flag] if flag in truth.columns else [])
    scored = predictions.join(truth.select(*columns), "row_id")
    if flag not in truth.columns:
        return summary(scored, ["model", "method"]).withColumn("subset", F.lit("all"))
    return subset_summary(scored, flag, ["model", "method"])
