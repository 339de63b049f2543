"""Preparation of a transcript table: cleaning, noise removal, flags and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions import fixed
from talkmill.functions.columns import strip
from talkmill.functions.text import (
    ERROR_PREFIX,
    clean_table,
    flag_text,
    remove_noise,
    token_count,
    too_short,
)
from talkmill.operators.labels import require_columns
from talkmill.operators.split import dry_run_sample


def clean_transcripts(
    df: DataFrame,
    source_column: str = "text",
    row_id: str = "row_id",
    start_row: int | None = None,
    min_tokens: int = 3,
    spans: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Clean ``source_column`` into ``text``, keep it as ``text_original``, flag short texts.

    With ``start_row``, rows with a smaller id keep their ``text``, ``text_original`` and
    ``too_short`` (empty where there were none), and only later rows are processed.
    """
    require_columns(df, source_column, *([row_id] if start_row is not None else []))
    done = df.withColumn("__source", F.col(source_column))
    done = clean_table(done.withColumn("__text", F.col(source_column)), "__text", row_id, spans, lemmas, **options)
    new = {
        "text": F.col("__text"),
        "text_original": F.col("__source"),
        "too_short": flag_text(too_short("__text", min_tokens)),
    }
    if start_row is not None:
        kept = F.col(row_id) < start_row
        old = {n: F.col(n) if n in df.columns else F.lit("") for n in new}
        new = {n: F.when(kept, old[n]).otherwise(c) for n, c in new.items()}
    return done.withColumns(new).drop("__source", "__text")


def clean_noise(
    df: DataFrame,
    source_column: str = "text",
    min_tokens: int = 3,
    phrases: Sequence[str] = tuple(fixed.NOISE_PHRASES),
) -> DataFrame:
    """Remove filler phrases, keep the text before as ``text_before_noise_clean``, flag short ones.

    Rows that report a failed transcription are edited as well; only their flag is guarded.
    """
    require_columns(df, source_column)
    work = df.withColumn("text_before_noise_clean", F.col(source_column))
    work = work.withColumn(source_column, remove_noise(source_column, phrases))
    return work.withColumn("too_short", flag_text(too_short(source_column, min_tokens)))


def noise_preview(df: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """A few texts before and after noise removal."""
    rows = dry_run_sample(df, text, row_id)
    return rows.select(
        row_id,
        F.substring(text, 1, 200).alias("before"),
        F.substring(remove_noise(text), 1, 200).alias("after"),
    )


def preparation_report(df: DataFrame, text: str = "text", min_tokens: int = 3) -> DataFrame:
    """Rows, short, empty, failed and usable ones, in one pass.

    An empty text also counts as short. ``ok_reference`` subtracts both and so takes empty rows
    off twice; ``ok`` counts the rows that are none of the three.
    """
    c = F.col(text)
    failed = c.startswith(ERROR_PREFIX)
    short = ~failed & (token_count(c) < min_tokens)
    empty = strip(c) == ""
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(short).alias("short"),
        F.count_if(empty).alias("empty"),
        F.count_if(failed).alias("errors"),
        F.count_if(~short & ~empty & ~failed).alias("ok"),
    )
    taken = F.col("short") + F.col("empty") + F.col("errors")
    return counts.withColumn("ok_reference", F.col("total") - taken)
