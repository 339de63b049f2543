"""Incremental preparation of arriving transcripts and routing of classified calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from talkmill.functions.text import clean_filename, clean_table, remove_noise, too_short
from talkmill.operators.ensemble import route_calls


def arriving(
    spark: SparkSession, path: str, schema: StructType | str, parts: int | None = None, **options
) -> DataFrame:
    """Stream over the columnar files of a folder; each file is read once.

    ``parts`` spreads batches of few files over more tasks; batches of many files need none.
    """
    calls = spark.readStream.schema(schema).options(**options).parquet(path)
    return calls.repartition(parts) if parts else calls


def prepare_calls(calls: DataFrame, min_tokens: int = 3, phrases: bool = True) -> DataFrame:
    """Redact, normalise, remove filler, flag short texts and shorten names, row by row."""
    cleaned = clean_table(calls.withColumn("text_original", F.col("text")))
    if phrases:
        cleaned = cleaned.withColumn("text", remove_noise("text"))
    cleaned = cleaned.withColumn("too_short", too_short("text", min_tokens))
    if "filename" in cleaned.columns:
        cleaned = cleaned.withColumn("filename", clean_filename("filename"))
    return cleaned


def write_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    once_per: str | None = None,
    within: tuple[str, str] | None = None,
    partition_by: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append a stream to columnar files, each input file once.

    ``once_per`` names a key that may arrive in two files. ``within`` is a time column and a delay such as
    ``"1 day"``: seen keys are forgotten after it. Without it every key stays as state, which is for
    streams that end; leave ``once_per`` off where keys are unique.
    """
    if once_per and within:
        rows = rows.withWatermark(*within).dropDuplicatesWithinWatermark([once_per])
    elif once_per:
        rows = rows.dropDuplicates([once_per])
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def route_stream(
    stages: DataFrame, path: str, checkpoint: str, threshold: float = 0.8, spam_label: str = "spam"
) -> StreamingQuery:
    """Route classified calls; automatic and review calls go to the folders of their route.

    One write serves both, so no batch is computed twice and none is half written.
    """
    return write_stream(route_calls(stages, threshold, spam_label), path, checkpoint, partition_by="route")
