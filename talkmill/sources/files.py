"""Case files, reference manifests, speech ground truth, RTTM and comparison reports."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.functions import fixed
from talkmill.functions.columns import collapse_spaces, strip, unicode_re
from talkmill.functions.jsonx import expected_keywords, json_fields, strict_json, text_field
from talkmill.functions.numbers import fixed_text
from talkmill.sources import shared

TRUTH = "map<string,struct<file:string,start_ms:bigint,duration_ms:bigint,text:string>>"


def _whole(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name")
    )


def read_cases(spark: SparkSession, root: str, buckets: Sequence[str], check: bool = True) -> DataFrame:
    """One case per text or JSON file: ``(bucket, path, case_id, text)``; blank cases are dropped.

    ``check`` raises for a JSON file without a text field, a repeated id, or no case at all.
    """
    files = _whole(spark, [f"{root.rstrip('/')}/{b}" for b in buckets])
    kind = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    bucket = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_extract("name", r"^(.*)\.[^.]+$", 1)
    text = F.when(kind == "json", text_field("value")).otherwise(collapse_spaces("value"))
    cases = files.where(kind.isin(fixed.CASE_SUFFIXES)).select(
        bucket.alias("bucket"),
        "path",
        F.concat_ws("/", bucket, stem).alias("case_id"),
        text.alias("text"),
    )
    if check:
        bad = cases.where("text is null").select("path").limit(20).collect()
        if bad:
            raise ValueError(f"JSON cases without a text field: {[r[0] for r in bad]}")
        filled = cases.where("text <> ''")
        twice = filled.groupBy("case_id").count().where("count > 1").limit(20).collect()
        if twice:
            raise ValueError(f"repeated case ids: {[r[0] for r in twice]}")
        if filled.isEmpty():
            raise ValueError(f"no cases under {root}")
    return cases.where("text <> ''")


def read_references(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Reference manifest as ``(case_id, keywords)``."""
    fields = json_fields(strict_json("value"))
    entries = _whole(spark, path).select(F.explode(fields).alias("case_id", "entry"))
    return entries.select("case_id", expected_keywords("entry").alias("keywords")).where(
        "keywords is not null"
    )


def read_truth(spark: SparkSession, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Speech ground truth as ``(seg_id, file, start_ms, duration_ms, text)``, rows with text.

    A file is one JSON object, or with ``lines`` one object per line, which is read in parts.
    """
    source = spark.read.text(path) if lines else _whole(spark, path)
    entries = source.select(F.explode(F.from_json("value", TRUTH)).alias("seg_id", "entry"))
    return entries.select("seg_id", "entry.*").where("text <> ''")


def write_truth(truth: DataFrame, path: str) -> None:
    """Ground truth as one JSON object per line, each with one segment."""
    entry = F.struct("file", "start_ms", "duration_ms", "text")
    line = F.to_json(F.create_map(F.col("seg_id"), entry))
    truth.select(line.alias("value")).write.mode("overwrite").text(path)


def read_rttm(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Speaker turns ``(file_id, start, dur, end, speaker)`` of RTTM lines."""
    lines = spark.read.text(path).select(F.split(strip("value"), r"\s+").alias("f"))
    start, dur = F.col("f")[3].cast("double"), F.col("f")[4].cast("double")
    return lines.where(F.col("f")[0] == "SPEAKER").select(
        F.col("f")[1].alias("file_id"),
        start.alias("start"),
        dur.alias("dur"),
        (start + dur).alias("end"),
        F.col("f")[7].alias("speaker"),
    )


def rttm_lines(turns: DataFrame) -> DataFrame:
    """RTTM line per turn, with the columns to sort by."""
    line = F.concat(
        F.lit("SPEAKER "),
        F.col("file_id"),
        F.lit(" 1 "),
        fixed_text("start", 3),
        F.lit(" "),
        fixed_text("dur", 3),
        F.lit(" <NA> <NA> "),
        F.col("speaker"),
        F.lit(" <NA> <NA>"),
    )
    return turns.select("file_id", "start", line.alias("value"))


def write_rttm(turns: DataFrame, path: str) -> None:
    """One folder per file, lines sorted by start.

    Turns are range-partitioned on file and start, so a long file is spread over several parts. The tasks write the parts
    themselves: a job that moves every folder in the driver at its end takes as long as there are files. A task that is
    repeated writes the same names again; ``_SUCCESS`` comes last.
    """
    place = shared.emptied(turns.sparkSession, path)
    lines = rttm_lines(turns).repartitionByRange("file_id", "start").sortWithinPartitions("file_id", "start")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}.txt"
        rows = ((_folder_name(f), line) for b in batches for f, line in zip(*(c.to_pylist() for c in b.columns)))
        written = 0
        for folder, own in groupby(rows, key=itemgetter(0)):
            shared.write_lines(f"{place}/{folder}/{name}", (line for _, line in own))
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["files"])

    parts = lines.select(F.col("file_id").cast("string"), F.coalesce("value", F.lit("")).alias("value"))
    parts.mapInArrow(write, "files long").agg(F.sum("files")).collect()  # one row
    shared.write_lines(f"{place}/_SUCCESS", [])


def _folder_name(value: str | None) -> str:
    """A file's name as Spark names a partition folder."""
    plain = re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value or "")
    return f"file_id={plain or '__HIVE_DEFAULT_PARTITION__'}"


def parse_intervals(lines: DataFrame) -> DataFrame:
    """Dictated turns such as ``0-5.2:A 5.5-12:B`` as ``(file_id, start, dur, end, speaker)``.

    ``lines`` has ``(file_id, line_no, offset_sec, line)``. Turns that do not end after their
    start are dropped. Letters become ``SPEAKER_00``, ``SPEAKER_01``, ... by first use in a file.
    """
    pattern = unicode_re(r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*[:=]\s*([A-Za-z]\w*)")
    groups = [F.regexp_extract_all("line", F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    found = lines.select(
        "file_id", "line_no", "offset_sec", F.posexplode(F.arrays_zip(*groups)).alias("pos", "g")
    )
    turns = found.select(
        "file_id",
        F.struct("line_no", "pos").alias("place"),
        (F.col("g.0").cast("double") + F.col("offset_sec")).alias("start"),
        (F.col("g.1").cast("double") + F.col("offset_sec")).alias("end"),
        F.upper("g.2").alias("letter"),
    ).where("end > start")
    first = turns.groupBy("file_id", "letter").agg(F.min("place").alias("first"))
    # One row per speaker of a file.
    number = F.row_number().over(W.partitionBy("file_id").orderBy("first")) - 1
    names = first.select("file_id", "letter", F.format_string("SPEAKER_%02d", number).alias("speaker"))
    return turns.join(names, ["file_id", "letter"]).select(
        "file_id", "start", (F.col("end") - F.col("start")).alias("dur"), "end", "speaker"
    )


def _comparison(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"')
    inferred = reader.option("inferSchema", True).csv(path).schema
    fields = [
        T.StructField(f.name, T.StringType() if f.name == "notes" else f.dataType) for f in inferred
    ]
    rows = reader.schema(T.StructType(fields)).csv(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1)
    table = rows.withColumn("source_dir", folder)
    return table.na.fill("", ["notes"]) if "notes" in table.columns else table


def read_comparisons(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Comparison tables with numbers inferred, notes as text and the folder as ``source_dir``.

    Tables may differ in columns; missing ones are null.
    """
    full = [p if p.endswith(".csv") else p.rstrip("/") + "/comparison.csv" for p in paths]
    tables = [_comparison(spark, p) for p in full]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_run_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Models of run logs ``(source_dir, model, group, ..., record)``.

    A log is a list of records, or an object that holds them under ``models``.
    """
    log = strict_json("value")
    listed = F.try_variant_get(log, "$", "array<variant>")
    inside = F.try_variant_get(log, "$.models", "array<variant>")
    items = _whole(spark, paths).select(
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("source_dir"),
        F.explode(F.coalesce(listed, inside)).alias("record"),
    )

    def field(name, kind):
        return F.try_variant_get("record", f"$.{name}", kind).alias(name)

    numbers = ("f1_weighted", "precision", "recall", "train_sec", "infer_ms_per_sample")
    return items.select(
        "source_dir",
        field("model", "string"),
        field("group", "string"),
        *[field(n, "double") for n in numbers],
        "record",
    )


def run_log_reports(logs: DataFrame) -> DataFrame:
    """Per-class rows ``(source_dir, model, label, precision, recall, f1, support)`` of run logs."""
    report = F.coalesce(
        *[json_fields(F.try_variant_get("record", f"$.{n}", "variant")) for n in ("_report", "report")]
    )
    rows = logs.select("source_dir", "model", F.explode(report).alias("label", "entry"))

    def number(name):
        return F.try_variant_get("entry", f"$['{name}']", "double")

    support = number("support")
    return rows.where(support.isNotNull() & ~F.col("label").isin("macro avg", "weighted avg")).select(
        "source_dir",
        "model",
        "label",
        number("precision").alias("precision"),
        number("recall").alias("recall"),
        number("f1-score").alias("f1"),
        support.cast("long").alias("support"),
    )
