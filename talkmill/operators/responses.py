"""Scores of model answers: JSON validity, completeness, expected keywords and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.jsonx import completeness, extract_json_object, keywords_match
from talkmill.functions.numbers import exact_round, safe_divide


def score_responses(
    responses: DataFrame,
    references: DataFrame | None,
    required: Sequence[str],
    problem_field: str = "problem",
) -> DataFrame:
    """One scored row per answer.

    ``responses`` has ``(model, bucket, case_id, raw_response, elapsed_sec, completion_tokens)``,
    ``references`` has ``(case_id, keywords)``. A case without keywords passes if the field is
    filled.
    """
    rows = responses
    if references is None:
        rows = rows.withColumn("keywords", F.lit(None).cast("array<string>"))
    else:
        rows = rows.join(references.select("case_id", "keywords"), "case_id", "left")
    fields = rows.withColumn("__fields", extract_json_object("raw_response"))
    found = F.col("__fields").isNotNull()
    problem = F.try_element_at("__fields", F.lit(problem_field))
    speed = safe_divide(F.col("completion_tokens"), F.greatest("elapsed_sec", F.lit(0.0)))
    return fields.select(
        "model",
        "bucket",
        "case_id",
        "elapsed_sec",
        "completion_tokens",
        speed.alias("tokens_per_sec"),
        found.cast("int").alias("json_ok"),
        (found & keywords_match(problem, "keywords")).cast("int").alias("problem_ok"),
        completeness("__fields", required).alias("completeness"),
    )


def detail_table(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {
            "elapsed_sec": exact_round("elapsed_sec", 6),
            "tokens_per_sec": exact_round("tokens_per_sec", 4),
            "completeness": exact_round("completeness", 6),
        }
    )


def model_summary(scored: DataFrame) -> DataFrame:
    """Mean latency, tokens per second, completeness and ``ok/total`` counts per model."""
    time = F.sum("elapsed_sec")

    def ratio(c):
        return F.format_string("%d/%d", F.sum(F.col(c).cast("long")), F.count("*"))

    return scored.groupBy("model").agg(
        exact_round(F.avg("elapsed_sec"), 3).alias("avg_response_sec"),
        exact_round(
            F.when(time > 0, F.sum("completion_tokens") / time).otherwise(0.0), 2
        ).alias("tokens_per_sec"),
        exact_round(F.avg("completeness"), 3).alias("completeness"),
        ratio("json_ok").alias("json_ok"),
        ratio("problem_ok").alias("problem_ok"),
    )


def bucket_latency(scored: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Mean latency per model with a column per bucket; no answers give null."""
    return (
        scored.groupBy("model")
        .pivot("bucket", list(buckets))
        .agg(exact_round(F.avg("elapsed_sec"), 3))
    )
