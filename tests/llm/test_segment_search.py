import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from talkmill.llm import segment_search
from talkmill.llm.queries import op3_segment_search
from talkmill.llm.registry import table


def brute(rows, k=10):
    good = [
        (i, [math.floor(1024 * Fraction(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    queries = {(i, tuple(v)) for i, v in good if i % 100 == 0}
    out = []
    for i, q in queries:
        score = lambda v: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v))))  # noqa: E731, B023
        near = sorted((-score(v), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, j, -s) for s, j in near[:k]]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.vec_id, r.score) for r in df.collect())


def test_query(spark):
    for sf in ("sf0.001", "sf0.1"):
        rows = [(r.vec_id, list(r.embedding)) for r in table(spark, f"/root/testdata/{sf}", "embeddings").collect()]
        df = op3_segment_search(spark, f"/root/testdata/{sf}")
        assert got(df) == brute(rows)
        ranks = {}
        for r in df.collect():
            ranks.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
        assert all(sorted(x) == sorted(x, key=lambda y: y[1:]) for x in ranks.values())


def test_blocks_and_ties(spark, monkeypatch):
    """Small blocks, a vector that a third of the rows share, odd dimensions."""
    monkeypatch.setattr(segment_search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(segment_search, "QUERY_ROWS", 4)
    rng = random.Random(2)
    same = [rng.gauss(0, 1) for _ in range(13)]
    rows = [(i * 10, same if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(13)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert got(segment_search.top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, None), (200, []), (300, [float("nan"), 1.0]), (400, [None, 1.0]),
        (None, [1.0, 1.0]), (1, []), (2, [float("inf"), 0.0]), (3, [3.0, -0.0]), (3, [3.0, 0.0]), (500, [1.0]),
        (600, [1e9, 1e9]), (7, [3e12, 1e9]), (8, [-3e12, -3e12]), (9, [1e30, 1e30]), (10, [0.1] * 40), (700, [0.2] * 40),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query_id", F.lit("x"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(op3_segment_search(spark, str(tmp_path))) == brute(rows)


def test_large_components(spark, monkeypatch):
    """Any finite vector takes part: norms, bounds and whole numbers beyond doubles lose no row."""
    monkeypatch.setattr(segment_search, "BLOCK_ROWS", 8)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    for i, size in ((7, 1e306), (20, 1e155), (31, -1e155), (100, 1e150), (101, 2.0**40), (102, -1.7e308), (103, 1e160)):
        rows[i] = (i, [size, 1.0, 0.0, -size, 2.0, 1e-300])
    rows[130] = (130, [-1e155, 0.0, 0.0, 0.0, 0.0, 0.0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(segment_search.top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows)
    best = segment_search._Best(np.array([0]), np.array([[1.0, 1.0]]), 1)
    best.meet(np.array([1]), np.array([[5.0, 5.0]]))
    best.meet(np.array([2, 3]), np.array([[1e306, 1.0], [1e155, 0.0]]))
    assert best.found.tolist() == [2] and best.score.tolist() == [2**63 - 1]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op3_segment_search(spark, str(tmp_path)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = np.floor(rng.normal(size=(30, 37)) * 1024), np.floor(rng.normal(size=(40, 37)) * 1024)
    true = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    before = np.zeros_like(true)
    for n in segment_search._levels(37):
        x, y = segment_search._statistics(a, n), segment_search._statistics(b, n)
        low = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
        assert (low <= true * (1 + 1e-9)).all() and low.mean() > before.mean()
        before = low
