"""Plans and skew: what keeps the operators usable when the data is a thousand times larger."""

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from talkmill.operators import diarize, ensemble, metrics, split, threshold
from talkmill.plans import sample_tables
from talkmill.plans.registry import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NO_MODELS = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", NO_MODELS)
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_and_filters_reach_the_scan(spark):
    docs = table(spark, SF, "documents")
    text = plan(metrics.length_summary(docs.where("lang = 'en'"), "n_chars"))
    assert "ReadSchema: struct<lang:string,n_chars:bigint>" in text
    assert "EqualTo(lang,en)" in text


def test_per_row_work_needs_no_shuffle(spark):
    from talkmill.functions.text import clean_text

    assert "Exchange" not in plan(table(spark, SF, "documents").select(clean_text("text").alias("t")))


def test_hold_out_marks_rows_without_a_shuffle(spark):
    docs = table(spark, SF, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")
    text = plan(split.hold_out(docs, "lang"))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_votes_place_rows_once(spark):
    probs = sample_tables.probabilities(spark, SF).drop("y_true")
    for method in ("soft", "max", "hard"):
        assert plan(ensemble.vote(probs, method)).count("Exchange") == 1


def test_metrics_combine_before_the_shuffle(spark):
    df = spark.createDataFrame([("m", "a", "b")], "model string, y_true string, y_pred string")
    assert "partial_count" in plan(metrics.summary(df, ["model"]))


def test_review_samples_limit_before_the_shuffle(spark):
    docs = table(spark, SF, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")
    assert "WindowGroupLimit" in plan(split.class_samples(docs, "lang"))


def test_hot_class_is_spread(spark):
    """A class with almost all rows, all of them copies of one text, falls into many buckets."""
    rows = spark.range(20_000).select(
        F.col("id").alias("row_id"), F.lit("same").alias("text"),
        F.when(F.col("id") < 19_990, "hot").otherwise("cold").alias("label"),
    )
    keyed = split._keyed(rows, "label", "text", "row_id", 42)
    top = keyed.groupBy("label", "__bucket").count().agg(F.max("count")).first()[0]
    assert top < 30
    folds = split.k_folds(rows, "label", 5).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r.label == "hot"} == {3998}


def test_hot_score_and_hot_file(spark):
    scores = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 30_000).alias("confidence"),
        F.when(F.col("id") % 2 == 0, "spam").otherwise("non_spam").alias("manual_label"),
    )
    sweep = threshold.threshold_sweep(scores)
    assert sweep.where("tp + fp + tn + fn <> 30000").count() == 0
    turns = spark.range(20_000).select(
        F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 50)).alias("file_id"),
        F.col("id").alias("seg_idx"),
        (F.col("id") * 1.0).alias("start"),
        (F.col("id") + 0.6).alias("end"),
        F.when(F.col("id") % 100 < 90, "A").otherwise("B").alias("speaker"),
    )
    begin = time.time()
    merged = diarize.merge_turns(turns, 0.5).where("file_id = 'hot'")
    assert merged.groupBy("speaker").count().collect() and merged.count() == 300
    errors = diarize.diarization_errors(turns, turns.withColumn("speaker", F.lower("speaker")), collar=0.0)
    hot = errors.where("file_id = 'hot'").first()
    assert hot.total == pytest.approx(9000) and hot.confusion == pytest.approx(0, abs=1e-6)
    assert time.time() - begin < 120


def test_neighbours_shuffle_rows_once(spark):
    """Training rows are dealt once by id; neither side is repeated for the blocks of the other."""
    text = plan(entry.queries()["knn_cosine"](spark, SF))
    assert "Generate" not in text and "Exchange" not in text and "MapInArrow" in text
