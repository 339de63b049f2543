"""All-string transcript tables: delimited files, snapshots and a resuming append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions import fixed
from talkmill.operators.labels import new_rows

CSV_QUOTES = {"quote": '"', "escape": '"'}


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    na_strings: Sequence[str] = tuple(fixed.NA_STRINGS),
    multi_line: bool = True,
) -> DataFrame:
    """Delimited file with a header; every column is text, missing cells and NA words are "".

    Quoted line breaks need ``multi_line``, which reads each file in one task; large tables
    without line breaks are read in parts with ``multi_line=False``.
    """
    raw = (
        spark.read.options(**CSV_QUOTES)
        .option("header", True)
        .option("inferSchema", False)
        .option("sep", sep)
        .option("multiLine", multi_line)
        .csv(path)
    )
    words = [w for w in na_strings if w]
    cells = []
    for name in raw.columns:
        c = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        cells.append((F.when(c.isin(words), "").otherwise(c) if words else c).alias(name))
    return raw.select(*cells)


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    (
        df.write.mode(mode)
        .options(**CSV_QUOTES)
        .option("header", True)
        .option("sep", sep)
        .option("emptyValue", "")
        .csv(path)
    )


def save_snapshot(df: DataFrame, path: str) -> None:
    """Prepared rows as columnar files, so that later filters and projections reach the scan."""
    df.write.mode("overwrite").parquet(path)


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Add an id that is unique but not dense. Write the table to keep the ids."""
    return df.withColumn(out, F.monotonically_increasing_id())


def append_new(df: DataFrame, path: str, key: str = "filename") -> None:
    """Append rows whose key the table at ``path`` lacks; one row per key."""
    rows = df.dropDuplicates([key])
    try:
        rows = new_rows(rows, df.sparkSession.read.parquet(path), key)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("append").parquet(path)


def transcript_rows(df: DataFrame, filename: str = "filename", text: str = "text") -> DataFrame:
    """Base transcript columns with empty labels."""
    empty = {c: F.lit("") for c in fixed.TRANSCRIPT_COLUMNS}
    empty.update({"filename": F.col(filename), "text": F.col(text)})
    return df.select(*[c.alias(n) for n, c in empty.items()])


def write_summary(df: DataFrame, path: str) -> None:
    """Nested summary rows as JSON."""
    df.write.mode("overwrite").json(path)
