"""Transcript, prediction and segment tables derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.plans.registry import table

MODELS, LABELS = 3, 10

# Probabilities of three models over ten labels for every embedding; integer weights, so that the
# quotient is the same double everywhere.
PROBS_SQL = """
weights AS (
  SELECT vec_id, label, m, l,
         1 + (vec_id * 31 + l * 17 + m * 7) % 97
           + CASE WHEN l = label AND (vec_id + m) % 3 <> 0 THEN 60 ELSE 0 END AS w
  FROM embeddings, range(3) t(m), range(10) s(l)),
probs AS (
  SELECT vec_id AS row_id, 'm' || m AS model, 'c' || l AS label, 'c' || label AS y_true,
         w::DOUBLE / (sum(w) OVER (PARTITION BY vec_id, m))::DOUBLE AS proba
  FROM weights)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, m = F.col("vec_id"), F.col("m")
    base = table(spark, sf_dir, "embeddings").select("vec_id", "label").withColumn(
        "m", F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1)))
    )

    def weight(i):
        known = (i == F.col("label")) & ((vec + m) % 3 != 0)
        return 1 + (vec * 31 + i * 17 + m * 7) % 97 + F.when(known, 60).otherwise(0)

    cells = F.transform(F.sequence(F.lit(0), F.lit(LABELS - 1)), weight)
    return base.withColumn("w", cells)


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, model, label, proba, y_true)``."""
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    cells = F.transform(
        F.col("w"),
        lambda x, i: F.struct(
            F.concat(F.lit("c"), i).alias("label"),
            (x.cast("double") / F.col("total").cast("double")).alias("proba"),
        ),
    )
    return (
        _weights(spark, sf_dir)
        .withColumn("total", total)
        .select(
            F.col("vec_id").alias("row_id"),
            F.concat(F.lit("m"), "m").alias("model"),
            F.concat(F.lit("c"), "label").alias("y_true"),
            F.inline(cells),
        )
        .select("row_id", "model", "label", "proba", "y_true")
    )


TRUTH_SQL = """
truth AS (
  SELECT vec_id AS row_id, 'c' || label AS y_true,
         CASE vec_id % 3 WHEN 0 THEN ' YES' WHEN 1 THEN '0' ELSE 'synthetic' END AS is_synthetic
  FROM embeddings)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("vec_id") % 3
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("c"), "label").alias("y_true"),
        F.when(third == 0, " YES").when(third == 1, "0").otherwise("synthetic").alias("is_synthetic"),
    )


TOP_SQL = """
top AS (
  SELECT row_id, model, y_true,
         first(label ORDER BY proba DESC, label) AS y_pred, max(proba) AS confidence
  FROM probs GROUP BY ALL)"""

LOGITS_SQL = """
logits AS (
  SELECT vec_id AS row_id, 'c' || l AS label, 'c' || label AS y_true, w / 16.0 AS logit
  FROM weights WHERE m = 0)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform(
        F.col("w"),
        lambda x, i: F.struct(F.concat(F.lit("c"), i).alias("label"), (x / F.lit(16.0)).alias("logit")),
    )
    rows = _weights(spark, sf_dir).where("m = 0")
    return rows.select(
        F.col("vec_id").alias("row_id"), F.concat(F.lit("c"), "label").alias("y_true"), F.inline(cells)
    )


# Text lengths as scores, with many ties, and quality as the class.
BINARY_SQL = """
scored AS (
  SELECT doc_id AS row_id, n_chars::DOUBLE AS confidence,
         CASE quality WHEN 1 THEN 'spam' ELSE 'non_spam' END AS manual_label
  FROM documents JOIN labels USING (doc_id))"""


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    marked = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return marked.select(
        F.col("doc_id").alias("row_id"),
        F.col("n_chars").cast("double").alias("confidence"),
        F.when(F.col("quality") == 1, "spam").otherwise("non_spam").alias("manual_label"),
    )


# Turns four seconds apart that last a second per 50 characters.
TURNS_SQL = """
turns AS (
  SELECT conv_id AS file_id, turn AS seg_idx, turn * 4.0::DOUBLE AS "start",
         turn * 4.0::DOUBLE + length(text) / 50.0::DOUBLE AS "end", role AS speaker, text
  FROM conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("turn") * F.lit(4.0)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file_id"),
        F.col("turn").alias("seg_idx"),
        start.alias("start"),
        (start + F.length("text") / F.lit(50.0)).alias("end"),
        F.col("role").alias("speaker"),
        "text",
    )


# Two systems: one is late by half a second and renames speakers, one mixes them up.
HYPOTHESES_SQL = """
found AS (
  SELECT 's1' AS system, file_id, "start" + 0.5 AS "start", "end" + 0.5 AS "end",
         'x_' || speaker AS speaker FROM turns
  UNION ALL
  SELECT 's2', file_id, "start", "end" - 0.25, 'y' || (seg_idx % 3)::VARCHAR FROM turns)"""


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = turns(spark, sf_dir)
    late = base.select(
        F.lit("s1").alias("system"), "file_id", (F.col("start") + 0.5).alias("start"),
        (F.col("end") + 0.5).alias("end"), F.concat(F.lit("x_"), "speaker").alias("speaker"),
    )
    mixed = base.select(
        F.lit("s2").alias("system"), "file_id", "start", (F.col("end") - 0.25).alias("end"),
        F.concat(F.lit("y"), (F.col("seg_idx") % 3).cast("string")).alias("speaker"),
    )
    return late.unionByName(mixed)


# Documents as a transcript table. Source stands for the group, language for the purpose.
CALLS_SQL = """
calls AS (
  SELECT d.doc_id AS row_id,
         CASE d.doc_id % 3 WHEN 0 THEN '2024-0' || (1 + d.doc_id % 9) || '-1' || (d.doc_id % 10)
              || '__0' || (d.doc_id % 8) || '-30-00_call.mp3' ELSE 'call' || d.doc_id || '.mp3' END AS filename,
         d.text,
         CASE WHEN l.doc_id IS NULL THEN '0' ELSE ' 1 ' END AS is_training_sample,
         CASE WHEN d.doc_id % 7 = 0 THEN ' ' WHEN d.lang = 'de' THEN ' SPAM' ELSE d.lang END AS call_purpose,
         CASE l.quality WHEN 1 THEN ' High' WHEN 0 THEN '?' ELSE '' END AS priority,
         d.source AS assigned_group
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("marked"))
    docs = table(spark, sf_dir, "documents").join(marks, "doc_id", "left")
    stamp = F.concat(
        F.lit("2024-0"), 1 + n % 9, F.lit("-1"), n % 10, F.lit("__0"), n % 8, F.lit("-30-00_call.mp3")
    )
    purpose = F.when(n % 7 == 0, " ").when(F.col("lang") == "de", " SPAM").otherwise(F.col("lang"))
    priority = F.when(F.col("quality") == 1, " High").when(F.col("quality") == 0, "?").otherwise("")
    return docs.select(
        n.alias("row_id"),
        F.when(n % 3 == 0, stamp).otherwise(F.concat(F.lit("call"), n, F.lit(".mp3"))).alias("filename"),
        "text",
        F.when(F.col("marked"), " 1 ").otherwise("0").alias("is_training_sample"),
        purpose.alias("call_purpose"),
        priority.alias("priority"),
        F.col("source").alias("assigned_group"),
    )
