"""Result records, merged comparison tables, Pareto frontier and confusion examples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.functions import fixed
from talkmill.functions.numbers import exact_round
from talkmill.operators.metrics import class_report, errors_only, summary
from talkmill.operators.scan import running_max_before
from talkmill.session import checked_broadcast


def result_records(predictions: DataFrame, runs: DataFrame) -> DataFrame:
    """One record per model: rounded metrics, run facts and the report as a nested map.

    ``predictions`` has ``(model, y_true, y_pred)``; ``runs`` has ``(model, group, train_sec,
    infer_ms_total, resource, notes)``.
    """
    quality = summary(predictions, ["model"])
    cell = F.struct("precision", "recall", "f1", "support")
    # One entry per label of one model.
    report = class_report(predictions, ["model"]).groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("label", cell))).alias("report")
    )
    per_row = F.col("infer_ms_total") / F.greatest("n", F.lit(1))
    return (
        quality.join(report, "model")
        .join(checked_broadcast(runs), "model")
        .select(
            "model",
            "group",
            exact_round("f1_weighted", 4).alias("f1_weighted"),
            exact_round("precision_weighted", 4).alias("precision"),
            exact_round("recall_weighted", 4).alias("recall"),
            exact_round("train_sec", 1).alias("train_sec"),
            exact_round(per_row, 3).alias("infer_ms_per_sample"),
            "resource",
            "notes",
            "report",
        )
    )


def summary_table(records: DataFrame) -> DataFrame:
    return records.drop("report").orderBy(F.desc("f1_weighted"), "model")


def is_descending(metric: str, descending: bool = False) -> bool:
    return descending or metric.lower() in fixed.HIGH_IS_GOOD


def merged_leaderboard(
    tables: Sequence[DataFrame],
    sort_by: str = "f1_weighted",
    descending: bool = False,
    best_only: bool = False,
) -> DataFrame:
    """Comparison tables in one, sorted by a metric in its natural direction.

    ``best_only`` keeps the first row per model in that order.
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if sort_by not in merged.columns:
        return merged.dropDuplicates(["model"]) if best_only and "model" in merged.columns else merged
    down = is_descending(sort_by, descending)
    key = F.desc_nulls_last(sort_by) if down else F.asc_nulls_last(sort_by)
    ties = [c for c in ("source_dir",) if c in merged.columns]
    if best_only and "model" in merged.columns:
        best = W.partitionBy("model").orderBy(key, *ties)
        merged = merged.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn")
    return merged.orderBy(key, *[c for c in ("model",) if c in merged.columns], *ties)


def best_per_model(
    runs: DataFrame, length: str = "max_length", strict_reference: bool = False
) -> DataFrame:
    """Best run of each model: highest metrics, then the smaller length.

    ``strict_reference`` takes the first value that is not null of each column on its own, which
    may mix runs.
    """
    metrics = [c for c in ("f1_weighted", "accuracy", "precision_weighted", "recall_weighted") if c in runs.columns]
    order = [F.desc_nulls_last(c) for c in metrics] + [F.asc(length)]
    if not strict_reference:
        best = W.partitionBy("model").orderBy(*order)
        return runs.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn")
    place = F.struct(
        *[F.coalesce(-F.col(c), F.lit(float("inf"))).alias(f"k{i}") for i, c in enumerate(metrics)],
        F.col(length).alias("l"),
    )
    rest = [c for c in runs.columns if c != "model"]
    return runs.groupBy("model").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest]
    )


def pareto_frontier(
    records: DataFrame, cost: str = "infer_ms_per_sample", gain: str = "f1_weighted", step: float = 1e-12
) -> DataFrame:
    """Records whose gain beats every cheaper one by more than ``step``."""
    # Only the best record of a cost can be on the frontier, so costs are unique from here on.
    best = F.min_by(
        F.struct(*records.columns), F.struct((-F.col(gain)).alias("g"), F.col("model").alias("m"))
    )
    unique = records.where(F.col(cost) > 0).groupBy(F.col(cost).alias("__cost")).agg(best.alias("r"))
    ranked = running_max_before(unique.select("r.*"), [cost], gain, "__best")
    return ranked.where(F.col(gain) > F.coalesce("__best", F.lit(-1.0)) + step).drop("__best")


def winners(table: DataFrame, name: str, metrics: Sequence[str]) -> DataFrame:
    """System with the lowest value of each metric; metrics without values give nulls."""
    cells = [
        F.struct(
            F.lit(m).alias("metric"),
            F.min_by(name, F.when(F.col(m).isNotNull(), F.struct(m, name))).alias("best"),
            F.min(m).cast("double").alias("value"),
        ).alias(m)
        for m in metrics
    ]
    return table.agg(*cells).select(F.inline(F.array(*metrics)))


def confusion_examples(
    predictions: DataFrame,
    true_label: str | None = None,
    predicted_label: str | None = None,
) -> DataFrame:
    """Wrongly predicted rows with their text, for review, surest first within a label pair."""
    return (
        errors_only(predictions, true_label, predicted_label)
        .withColumn("is_error", F.lit(True))
        .orderBy("y_true", "y_pred", F.desc("confidence"), "row_id")
    )
