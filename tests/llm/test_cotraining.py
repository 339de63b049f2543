import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.llm import cotraining as co
from talkmill.llm.arrays import text_bytes
from talkmill.llm.queries import op5_cotraining
from talkmill.llm.registry import table


def accuracy(rows, known):
    pairs = [(r.predicted, known[r.doc_id]) for r in rows if r.doc_id in known]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_held_out_accuracy(spark, tmp_path):
    """Labels of half of the rows are hidden from training; the other rows carry them."""
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    held = {i for i in known if zlib.crc32(f"x{i}".encode()) % 2}
    seen = [(i, q) for i, q in known.items() if i not in held]
    labels = spark.createDataFrame(seen, "doc_id long, quality int")
    rows = co.score_quality(table(spark, sf, "documents"), labels).withColumnRenamed("id", "doc_id")
    rows = rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert accuracy(rows, {i: known[i] for i in held}) > 0.95
    bad = [r.predicted for r in rows if r.doc_id in held and known[r.doc_id] == 0]
    assert sum(bad) / len(bad) < 0.2
    # Calibrated: the mean score is the share of good labels.
    mean = np.mean([r.score for r in rows if r.doc_id in held])
    assert mean == pytest.approx(np.mean([known[i] for i in held]), abs=0.03)


def test_newton_step_as_in_numpy():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 3))])
    y = (x @ [0.3, 1, -2, 0] + rng.normal(size=300) > 0).astype(float)
    w = np.zeros(4)
    for _ in range(12):
        halves = sum(co._newton_sums(x[s], y[s], np.ones(150), w) for s in (slice(0, 150), slice(150, 300)))
        w = co._step(halves, w)
    ridge = np.array([1e-6, 1, 1, 1])
    assert np.abs(x.T @ (y - co._sigmoid(x @ w)) - ridge * w).max() < 1e-6


def test_views_by_hand():
    data, offsets = text_bytes(__import__("pyarrow").array(["AA bb bb\n", "", "a|b! 1"]))
    view = co.text_view(data, offsets)
    assert view[0][:5].tolist() == pytest.approx([2 / 9, 4 / 9, 0, 2 / 9, 1 / 9])
    assert view[0][-5:].tolist() == pytest.approx([2 / 3, 2 / 3, 1 / 3, np.log1p(3), 0])
    assert view[1].sum() == pytest.approx(1) and view[2][5] == pytest.approx(1 / 6)
    page = co.page_view(data, offsets, np.arange(3), np.arange(3), np.array([9.0, 0.0, 5.0]))
    assert page[0][:24].sum() == 2 and page[0][-1] == pytest.approx(np.log(2)) and page[0][-4:-1].tolist() == [1, 1, 0]


def test_pages_teach_the_text_view():
    """Rows that only one view can tell become training rows of the other."""
    assert co.SURE > 0.9 and 0 < co.PSEUDO_WEIGHT <= 1


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(300):
        good = i % 3 > 0
        words = [rng.choice(["the", "lamp", "over", "river", "stone", "walks"]) for _ in range(60)]
        text = " ".join(words) + "." if good else "BUY!! NOW!! " * 30
        rows.append((i, text, rng.choice(["en", None]), "hot" if i % 2 else None, len(text)))
        if i % 4 < 2:
            marks.append((i, int(good)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "x" * 100_000, "en", "s", 5), (None, "a b", "en", "s", 3)]
    rows += [rows[0]] * 3
    marks += [(0, 1), (5, None), (None, 1), (10**7, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumn("label", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = op5_cotraining(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= x <= 1 for r in out for x in (r.text_score, r.page_score, r.score))
    truth = {i: int(i % 3 > 0) for i in range(300)}
    assert accuracy(out, truth) > 0.95


def test_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert co.score_quality(docs, none).first().score == 0.5
    assert co.score_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).first().score == 1.0
    assert co.score_quality(docs.limit(0), none).count() == 0
