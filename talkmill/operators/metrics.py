"""Classification metrics from tables with ``y_true`` and ``y_pred``.

All of them start from one count per (group, true, predicted) label, which is combined inside
each task, so the shuffle carries label pairs and not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.columns import ColumnLike, col
from talkmill.functions.numbers import exact_round, safe_divide
from talkmill.operators.labels import collapse_spam, is_synthetic
from talkmill.operators.scan import exact_quantile


def pair_counts(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    n = F.sum(weight) if weight else F.count("*")
    return df.groupBy(*by, "y_true", "y_pred").agg(n.alias("n"))


def confusion_matrix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per true and predicted label; predictions of labels that are never true are left out."""
    pairs = pair_counts(df, by)
    labels = pairs.select(*by, F.col("y_true").alias("y_pred")).distinct()
    return pairs.join(labels, [*by, "y_pred"], "left_semi").select(*by, "y_true", "y_pred", "n")


def confusion_table(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix with one column per predicted label, missing cells 0, for each group."""
    wide = confusion_matrix(df, by).groupBy(*by, "y_true").pivot("y_pred", list(labels)).sum("n")
    return wide.na.fill(0)


def _label_counts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    hit = F.col("y_true") == F.col("y_pred")
    n, zero = F.col("n"), F.lit(0).cast("long")
    as_true = F.struct(
        F.col("y_true").alias("label"),
        F.when(hit, n).otherwise(zero).alias("tp"),
        zero.alias("fp"),
        F.when(hit, zero).otherwise(n).alias("fn"),
    )
    as_pred = F.struct(F.col("y_pred").alias("label"), zero.alias("tp"), n.alias("fp"), zero.alias("fn"))
    sides = F.when(hit, F.array(as_true)).otherwise(F.array(as_true, as_pred))
    return (
        pairs.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))
    )


def _with_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "support": F.col("tp") + F.col("fn"),
            "precision": safe_divide(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": safe_divide(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": safe_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def class_report(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label, over true and predicted labels."""
    scored = _with_scores(_label_counts(pair_counts(df, by, weight), by))
    return scored.select(*by, "label", "precision", "recall", "f1", "support")


def summary(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Errors, accuracy, support-weighted precision, recall and F1, and macro F1 per group."""
    scored = _with_scores(_label_counts(pair_counts(df, by, weight), by))
    share = F.sum("support")

    def weighted(name):
        return safe_divide(F.sum(F.col(name) * F.col("support")), share)

    return scored.groupBy(*by).agg(
        share.alias("n"),
        F.sum("fn").alias("errors"),
        safe_divide(F.sum("tp"), share).alias("accuracy"),
        weighted("f1").alias("f1_weighted"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        F.avg("f1").alias("f1_macro"),
    )


def weighted_roll_up(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted and macro F1 from a class report."""
    return report.groupBy(*by).agg(
        safe_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        F.sum("support").alias("support"),
    )


def _views(df: DataFrame, spam_label: str, column: str = "view") -> DataFrame:
    """Repeat label pairs for three views: as they are, spam or not, rows whose truth is not spam."""
    row = [F.col("y_true"), F.col("y_pred")]
    two = [collapse_spam("y_true", spam_label), collapse_spam("y_pred", spam_label)]

    def view(name, pair):
        return F.struct(F.lit(name).alias(column), pair[0].alias("t"), pair[1].alias("p"))

    plain = [view("multiclass", row), view("binary_spam", two)]
    extra = F.when(F.col("y_true") != spam_label, F.array(*plain, view("nonspam_intents", row)))
    rest = [c for c in df.columns if c not in ("y_true", "y_pred")]
    return df.select(*rest, F.explode(F.coalesce(extra, F.array(*plain))).alias("v")).select(
        *rest, f"v.{column}", F.col("v.t").alias("y_true"), F.col("v.p").alias("y_pred")
    )


def metric_views(df: DataFrame, spam_label: str = "spam", by: Sequence[str] = ()) -> DataFrame:
    """Summary for the three views, from one count of the rows."""
    pairs = pair_counts(df, by)
    return summary(_views(pairs, spam_label), [*by, "view"], weight="n")


def subset_summary(df: DataFrame, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """Summary for all, real and synthetic rows, from one count of the rows."""
    pairs = pair_counts(df.withColumn("__synth", is_synthetic(flag)), [*by, "__synth"])
    names = F.array(F.lit("all"), F.when(F.col("__synth"), "synthetic").otherwise("real"))
    return summary(pairs.withColumn("subset", F.explode(names)), [*by, "subset"], weight="n")


def errors_only(
    df: DataFrame, true_label: str | None = None, predicted_label: str | None = None
) -> DataFrame:
    """Wrong predictions, optionally of one true and one predicted label."""
    out = df.where(F.col("y_true") != F.col("y_pred"))
    if true_label is not None:
        out = out.where(F.col("y_true") == true_label)
    if predicted_label is not None:
        out = out.where(F.col("y_pred") == predicted_label)
    return out


def length_summary(df: DataFrame, length: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, mean, exact percentiles and maximum of a whole-number column.

    Lengths are counted first. ``d`` different lengths need at least ``d*d/2`` tokens of text, so
    10 trillion tokens give at most a few million counted lengths for the percentile step.
    """
    counted = df.groupBy(*by, F.col(length).alias("__len")).agg(F.count("*").alias("__n"))

    def pct(q):
        return F.percentile("__len", F.lit(q), F.col("__n"))

    return counted.groupBy(*by).agg(
        F.sum("__n").alias("n"),
        (F.sum(F.col("__len") * F.col("__n")) / F.sum("__n")).alias("mean"),
        pct(0.5).alias("median"),
        pct(0.9).alias("p90"),
        pct(0.95).alias("p95"),
        pct(0.99).alias("p99"),
        F.max("__len").alias("max"),
    )


def length_coverage(df: DataFrame, length: str, thresholds: Sequence[int] = (128, 256, 512)) -> DataFrame:
    """Rows longer than each threshold and their share."""
    if not thresholds:
        raise ValueError("at least one threshold is needed")
    counts = df.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(length) > t).alias(f"t{t}") for t in thresholds]
    )
    pairs = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("longer")) for t in thresholds]
    )
    return counts.select("n", F.inline(pairs)).select(
        "threshold", "longer", safe_divide(F.col("longer"), F.col("n")).alias("share")
    )


def confidence_summary(
    df: DataFrame, confidence: str = "confidence", threshold: float = 0.8, by: Sequence[str] = ()
) -> DataFrame:
    """Mean and exact 90th percentile of confidence; share, accuracy and errors of confident rows."""
    right = F.col("y_true") == F.col("y_pred")
    sure = F.col(confidence) >= threshold
    n = F.count("*")
    one = F.lit(1).alias("__one")
    stats = df.groupBy(*by, one).agg(
        F.avg(confidence).alias("confidence_mean"),
        safe_divide(F.count_if(sure), n).alias("high_conf_share"),
        F.try_divide(F.count_if(sure & right).cast("double"), F.count_if(sure)).alias(
            "high_conf_accuracy"
        ),
        F.count_if(sure & ~right).alias("high_conf_errors"),
    )
    p90 = exact_quantile(df, confidence, 0.9, "confidence_p90", by).withColumn("__one", F.lit(1))
    return stats.join(p90, [*by, "__one"]).drop("__one")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``n / (k * n_class)`` per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    mean = counts.agg(F.sum("n") / F.count("*")).scalar()
    return counts.select("label", "n", (mean / F.col("n")).alias("weight"))


def fold_scores(folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of the weighted F1 over folds."""
    per_fold = summary(folds, [*by, "fold"])
    return per_fold.groupBy(*by).agg(
        F.avg("f1_weighted").alias("f1_mean"),
        F.stddev_pop("f1_weighted").alias("f1_std"),
        F.count("*").alias("folds"),
    )


def rounded(df: DataFrame, digits: int = 4, skip: Sequence[str] = ()) -> DataFrame:
    """Round all double columns as reports show them."""
    names = [n for n, t in df.dtypes if t == "double" and n not in skip]
    return df.withColumns({n: exact_round(n, digits) for n in names})


def is_error(y_true: ColumnLike = "y_true", y_pred: ColumnLike = "y_pred") -> Column:
    return col(y_true) != col(y_pred)
