"""Clean training documents in five stages, each written as Parquet and read again by the next one.

``run(spark, sf_dir)`` takes the ``documents`` table of ``sf_dir``. All stages but the last return the columns of
documents; every stage works on all rows that the one before kept. Rows that repeat an id, null ids and texts, empty
tables and extra columns go through every stage: they are kept or dropped by what their text says, as the docstrings of the
operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm import jaccard_join, merge_dropout, secret_scan, source_mixing, toxicity
from talkmill.llm.queries import VOCABULARY
from talkmill.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance model does not find toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out("doc_id"))
    scored = toxicity.score(docs, model, out="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id, a null id before all.

    A row is known by its id and the hash of its text, so rows that agree in both are copies of each other and different
    texts that share an id are not mixed up.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    near = jaccard_join.near_texts(docs.select(key.alias("key"), "text"), id="key")
    # Most rows have no links and need no look at their class.
    linked = near.where("n_links > 0").groupBy("id").agg(F.first(F.expr("class_id <=> id")).alias("__first"))
    linked = linked.select(F.col("id.doc_id").alias("__id"), F.col("id.hash").alias("__hash"), "__first")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__hash"))
    marked = docs.join(linked, same, "left")
    alone = marked.where("__first IS NULL").select(docs.columns)
    first = marked.where("__first").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return alone.unionByName(first)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by ``[SECRET]`` and ``n_chars`` counted again where one was."""
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    # Every text is scanned once: the model and the spans both read what was found.
    folder = f"{shared_folder(spark).rstrip('/')}/scanned-{uuid.uuid4().hex}"
    secret_scan.scanned(body).write.parquet(folder)
    rows = spark.read.parquet(folder)
    model = secret_scan.fit(secret_scan.samples(rows))
    rows = rows.withColumn("spans", secret_scan.all_spans(model))
    rows = rows.withColumn("masked", secret_scan.redacted(F.col("text"), F.col("spans")))
    hit = F.size("spans") > 0
    new = {
        "text": F.col("masked"),
        "n_chars": F.when(hit, F.length("masked")).otherwise(F.col("row.n_chars")).cast("long"),
    }
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the weights of temperature mixing: at 0.98 of the full entropy, none more than 1.5 times.

    The largest source is used once, so no document is dropped; smaller sources repeat some of theirs.
    """
    return source_mixing.mixed(docs, entropy=0.98, repeats=1.5)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and the pieces of their texts, a tenth of the merges dropped."""
    return merge_dropout.encode(docs, VOCABULARY, dropout=0.1, seed=1, out="ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Compression, hashing and merges have no form in SQL; ``tests/llm/test_pipeline.py`` holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written to the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
