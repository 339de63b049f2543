"""Exact threshold search, ROC and precision-recall curves, and zone policies for binary scores.

Rows are counted per distinct score once. All curves are running sums over that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.functions.numbers import safe_divide
from talkmill.operators.scan import SLICE, sliced, with_running

RULES = ("greater_equal", "less_equal")
METRICS = (
    "accuracy", "balanced_accuracy", "spam_f1", "spam_precision", "spam_recall", "youden_j",
)


def _sign(rule: str) -> int:
    if rule not in RULES:
        raise ValueError(f"unknown rule '{rule}'")
    return 1 if rule == "greater_equal" else -1


def predict(
    score: Column, threshold: Column | float, rule: str, positive: str = "spam", negative: str = "non_spam"
) -> Column:
    hit = score >= threshold if _sign(rule) > 0 else score <= threshold
    return F.when(hit, positive).otherwise(negative)


def score_counts(df: DataFrame, score: str, label: str, positive: str) -> DataFrame:
    """Positive and negative rows per distinct score."""
    yes = F.col(label) == positive
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg")
    )


def _ranked_scores(counts: DataFrame) -> DataFrame:
    """Distinct scores with running counts up to each, the score before it, and totals."""
    base = sliced(counts, ["score"])
    sums = {"cum_pos": "pos", "cum_neg": "neg"}
    rows = with_running(base, ["score"], sums, {"before": "score"})
    totals = {
        "all_pos": F.sum("pos"),
        "all_neg": F.sum("neg"),
        "lowest": F.min("score"),
        "highest": F.max("score"),
    }
    one = base.agg(F.struct(*[c.alias(n) for n, c in totals.items()])).scalar()
    return rows.withColumn("__all", one).select("*", "__all.*").drop("__all")


def _threshold_rows(ranked: DataFrame) -> DataFrame:
    """One threshold below each distinct score, and one above the highest.

    ``pos_below`` and ``neg_below`` count the rows with a score under the threshold.
    """
    span = F.col("highest") - F.col("lowest")
    eps = F.greatest(F.lit(1e-9), span * 1e-6, F.lit(1e-6))
    below = F.struct(
        F.when(F.col("before").isNull(), F.col("score") - eps)
        .otherwise((F.col("before") + F.col("score")) / 2)
        .alias("threshold"),
        (F.col("cum_pos") - F.col("pos")).alias("pos_below"),
        (F.col("cum_neg") - F.col("neg")).alias("neg_below"),
    )
    above = F.struct(
        (F.col("highest") + eps).alias("threshold"),
        F.col("all_pos").alias("pos_below"),
        F.col("all_neg").alias("neg_below"),
    )
    rows = F.when(F.col("score") == F.col("highest"), F.array(below, above)).otherwise(F.array(below))
    return ranked.select("all_pos", "all_neg", F.inline(rows))


def threshold_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    precision, recall = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    specificity = safe_divide(tn, tn + fp)
    return {
        "tp": tp,
        "fp": fp,
        "tn": tn,
        "fn": fn,
        "accuracy": safe_divide(tp + tn, tp + fp + tn + fn),
        "spam_precision": precision,
        "spam_recall": recall,
        "specificity": specificity,
        "balanced_accuracy": (recall + specificity) / 2.0,
        "spam_f1": safe_divide(2 * precision * recall, precision + recall),
        "youden_j": recall + specificity - 1.0,
        "pred_spam": tp + fp,
        "pred_non_spam": tn + fn,
    }


def threshold_sweep(
    df: DataFrame,
    score: str = "confidence",
    label: str = "manual_label",
    positive: str = "spam",
    rule: str = "greater_equal",
) -> DataFrame:
    """All metrics for every threshold that can change a decision."""
    rows = _threshold_rows(_ranked_scores(score_counts(df, score, label, positive)))
    pos_above = F.col("all_pos") - F.col("pos_below")
    neg_above = F.col("all_neg") - F.col("neg_below")
    if _sign(rule) > 0:
        tp, fp, tn, fn = pos_above, neg_above, F.col("neg_below"), F.col("pos_below")
    else:
        tp, fp, tn, fn = F.col("pos_below"), F.col("neg_below"), neg_above, pos_above
    named = [c.alias(n) for n, c in threshold_metrics(tp, fp, tn, fn).items()]
    return rows.select("threshold", *named)


def best_thresholds(sweep: DataFrame, metric: str = "accuracy", k: int = 1) -> DataFrame:
    """Best ``k`` thresholds; ties by balanced accuracy, F1, accuracy, then the lower threshold."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric '{metric}'")
    # Equal ratios of different counts may differ in the last bit; compare 12 decimals.
    keys = [F.round(c, 12).desc() for c in (metric, "balanced_accuracy", "spam_f1", "accuracy")]
    return sweep.orderBy(*keys, F.col("threshold")).limit(k)


def _descending_counts(df: DataFrame, score: str, label: str, positive: str, rule: str) -> DataFrame:
    """Running counts from the strongest score down. ``depth`` is the negated oriented score."""
    counts = score_counts(df, score, label, positive)
    depth = F.col("score") * -_sign(rule)
    base = sliced(counts.withColumn("depth", depth), ["depth"])
    rows = with_running(base, ["depth"], {"tp": "pos", "fp": "neg"})
    one = base.agg(F.struct(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))).scalar()
    whole = rows.withColumn("__all", one).select("*", "__all.*").drop("__all")
    return whole.withColumn("score", -F.col("depth"))


def roc_auc(df: DataFrame, score: str, label: str, positive: str, rule: str = "greater_equal") -> DataFrame:
    """Area under the ROC curve: the trapezoid of each distinct score, summed."""
    rows = _descending_counts(df, score, label, positive, rule)
    # A step of ``neg`` to the right under the mean of true positives before and after it.
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")).cast("double") / 2)
    total = F.max("all_pos").cast("double") * F.max("all_neg")
    return rows.agg(F.try_divide(area, total).alias("roc_auc"))


def average_precision(
    df: DataFrame, score: str, label: str, positive: str, rule: str = "greater_equal"
) -> DataFrame:
    """Precision at each score, weighted by the recall it adds."""
    rows = _descending_counts(df, score, label, positive, rule)
    gained = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return rows.agg(F.try_divide(gained, F.max("all_pos").cast("double")).alias("average_precision"))


def roc_curve(
    df: DataFrame, score: str, label: str, positive: str, rule: str = "greater_equal"
) -> DataFrame:
    """ROC points from (0, 0) on; points on a straight line between neighbours are left out.

    A point is kept if the step before it and the step after it differ, or if it is the first or
    the last one.
    """
    rows = _descending_counts(df, score, label, positive, rule)
    # The step after a point belongs to the next score; one row per slice carries it over borders.
    local = W.partitionBy(SLICE).orderBy("depth")
    by_slice = W.orderBy(SLICE)
    ahead = rows.groupBy(SLICE).agg(
        F.min_by("pos", "depth").alias("__pos"), F.min_by("neg", "depth").alias("__neg")
    )
    ahead = ahead.select(
        SLICE,
        F.lead("__pos").over(by_slice).alias("__pos"),
        F.lead("__neg").over(by_slice).alias("__neg"),
    )
    rows = rows.join(F.broadcast(ahead), SLICE)
    rows = rows.withColumn("next_pos", F.coalesce(F.lead("pos").over(local), F.col("__pos")))
    rows = rows.withColumn("next_neg", F.coalesce(F.lead("neg").over(local), F.col("__neg")))
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    turn = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    corner = first | F.col("next_pos").isNull() | turn
    points = rows.where(corner).select(
        F.try_divide(F.col("fp").cast("double"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("all_pos")).alias("tpr"),
        F.col("score").alias("threshold_score"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold_score")
    )
    return start.unionByName(points)


def pr_curve(
    df: DataFrame, score: str, label: str, positive: str, rule: str = "greater_equal"
) -> DataFrame:
    """Precision and recall per distinct score, and the end point (1, 0) without a threshold."""
    rows = _descending_counts(df, score, label, positive, rule)
    points = rows.select(
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("all_pos") == 0, 1.0)
        .otherwise(F.try_divide(F.col("tp").cast("double"), F.col("all_pos")))
        .alias("recall"),
        F.col("score").alias("threshold_score"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold_score"),
    )
    return points.unionByName(end)


def zone_of(score: Column, review: float, block: float, rule: str = "greater_equal") -> Column:
    if _sign(rule) > 0:
        if block < review:
            raise ValueError("greater_equal needs block >= review")
        return F.when(score >= block, "block").when(score >= review, "review").otherwise("allow")
    if block > review:
        raise ValueError("less_equal needs block <= review")
    return F.when(score <= block, "block").when(score <= review, "review").otherwise("allow")


def zone_policy(
    df: DataFrame,
    score: str,
    label: str,
    review: float,
    block: float,
    positive: str = "spam",
    negative: str = "non_spam",
    rule: str = "greater_equal",
) -> DataFrame:
    """Rows, coverage and label shares of the block, review and allow zones; empty zones too."""
    zone = zone_of(F.col(score).cast("double"), review, block, rule)
    hits = F.col(label) == positive
    others = F.col(label) == negative
    names = ("block", "review", "allow")
    per_zone = [
        F.struct(
            F.lit(z).alias("zone"),
            F.count_if(zone == z).alias("count"),
            F.count_if((zone == z) & hits).alias("pos"),
            F.count_if((zone == z) & others).alias("neg"),
        ).alias(z)
        for z in names
    ]
    one = df.agg(F.count("*").alias("rows"), *per_zone)
    return one.select("rows", F.inline(F.array(*names))).select(
        "zone",
        "count",
        safe_divide(F.col("count"), F.col("rows")).alias("coverage"),
        safe_divide(F.col("pos"), F.col("count")).alias("spam_share"),
        safe_divide(F.col("neg"), F.col("count")).alias("non_spam_share"),
    )
