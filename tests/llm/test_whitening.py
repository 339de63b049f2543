import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.llm import whitening as wh
from talkmill.llm.queries import op11_whitening
from talkmill.llm.registry import table

SF = "/root/testdata/sf0.01"


def frame(spark, vectors, ids=None):
    rows = list(zip(ids or range(len(vectors)), vectors))
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def exact(vectors):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors])
    c = (len(x) * x - x.sum(axis=0)) / len(x)
    values, turn = np.linalg.eigh(c.T @ c / len(x))
    return x, c, values[::-1], turn[:, ::-1]


def held_against_numpy(rows, vectors, ids):
    x, c, values, turn = exact(vectors)
    n, by = len(x), {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by) == sorted(ids)
    signs = {}
    for row, i in enumerate(ids):
        assert {r.n for r in by[i].values()} == {n}
        off = [n * int(v) - int(s) for v, s in zip(x[row], x.sum(axis=0))]
        assert {r.deviation for r in by[i].values()} == {sum(v * v for v in off)}
        for k, r in by[i].items():
            want = c[row] @ turn[:, k - 1] / math.sqrt(values[k - 1])
            sign = signs.setdefault(k, 1 if abs(r.whitened - want) < abs(r.whitened + want) else -1)
            assert r.whitened == pytest.approx(sign * want, abs=1e-8)
            assert r.explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
            assert 0 <= r.identity_error < 1e-9
    return by


def test_query(spark):
    """All rows against the eigenvectors that numpy finds, components and signs alike."""
    rows = op11_whitening(spark, SF).collect()
    held = table(spark, SF, "embeddings").collect()
    by = held_against_numpy(rows, [r.embedding for r in held], [r.vec_id for r in held])
    assert all(sorted(k) == list(range(1, 9)) for k in by.values())


def test_certificate_and_passes(spark):
    """A flat spectrum in many dimensions: residuals at rounding, and far fewer passes than one per dimension."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((900, 300)).round(4).tolist()
    model = wh.fit(frame(spark, vectors))
    _, c, values, turn = exact(vectors)
    assert np.allclose(model.values, values[:8], rtol=1e-12)
    assert (np.abs(np.sum(model.vectors * turn[:, :8], axis=0)) > 1 - 1e-12).all()
    assert model.residuals.max() <= wh.LOOSE * values[0] and model.passes < 90
    v = c.T @ c / len(c)
    true = np.linalg.norm(v @ model.vectors - model.vectors * model.values, axis=0)
    assert true.max() <= 1e-11 * values[0]


def test_filter_is_the_polynomial():
    """The recurrence against the closed form cosh(m acosh x), scaled by its value at the top."""
    values = np.linspace(0.5, 9.0, 40)
    got = wh._filtered(lambda b: values[:, None] * b, np.ones((40, 1)), np.array([9.0, 4.0]), 0.5, 7, None)[:, 0]
    x = (values - 2.25) / 1.75
    top = (9.0 - 2.25) / 1.75
    want = np.polynomial.chebyshev.Chebyshev.basis(7)(x) / np.polynomial.chebyshev.Chebyshev.basis(7)(top)
    assert np.allclose(got, want)
    lanczos = wh._Lanczos(np.ones(40))
    for _ in range(8):
        lanczos.step(values * lanczos.basis[-1])
    assert 0 <= lanczos.bound() <= 0.5


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = rng.standard_normal((40, 5)).tolist()
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1e306] * 5, [1.0] * 4, [2.0] * 6]
    df = frame(spark, good + odd + good[:2]).withColumn("whitened", F.lit("x"))
    model = wh.fit(df)
    out = wh.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "deviation", "whitened"]
    rows = out.collect()
    assert model.n == 42 and sorted(r.vec_id for r in rows) == [*range(40), 48, 49]
    assert all(len(r.whitened) == 5 for r in rows)
    _, c, values, _ = exact(good + good[:2])
    assert np.allclose(model.values, values, rtol=1e-12)


def test_few_directions(spark, tmp_path):
    """Directions without variance are left out; equal vectors and no vectors give no rows."""
    line = [[float(k), 2.0 * k, 7.0] for k in range(9)]
    frame(spark, line).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    rows = op11_whitening(spark, f"{tmp_path}/a").collect()
    assert {r.component for r in rows} == {1} and len(rows) == 9 and rows[0].explained == pytest.approx(1)
    for name, vectors in (("b", [[1.0, 2.0]] * 3), ("c", []), ("d", [None, [math.nan]])):
        frame(spark, vectors).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert op11_whitening(spark, f"{tmp_path}/{name}").count() == 0


def test_deviation_of_any_size():
    model = wh.Whitening(10**6, np.zeros(2, np.int64), 1.0, np.ones(1), np.ones((2, 1)), np.zeros(1), 0)
    got = wh._deviations(model, np.array([[1 << 20, 3], [2000, 1], [1100, 2000]])).to_pylist()
    assert got == [None, (2000**2 + 1) * 10**12, (1100**2 + 2000**2) * 10**12]
