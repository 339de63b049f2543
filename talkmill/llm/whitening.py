"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Every entry c becomes the whole number floor(1024 * c) + 100000. The leading eigenvectors of the covariance V of those vectors are
found without V itself: a block of ``WANTED + GUARD`` directions is all that is ever multiplied.

- **Pass.** One Spark job gives V Q for a block Q: tasks sum the products of centred vectors, Spark adds up one row per
  dimension, the driver gets as many numbers as Q has. Vectors are centred exactly, as n * x - S in whole numbers.
- **Filter.** A Chebyshev polynomial in V, by its three-term recurrence, one pass a degree, damps the part of the spectrum between a
  lower bound and the smallest Ritz value of the block, and lets the wanted end grow.
- **Bound.** A Lanczos vector rides along in the passes of the first filter; its smallest Ritz value less the last residual bounds the
  spectrum from below.
- **Certificate.** After each filter a QR step and Rayleigh-Ritz give eigenvalues, vectors and residuals |V u - e u|. The
  iteration ends when all wanted residuals are down to rounding (``RESIDUAL`` times the largest eigenvalue), or have stopped falling
  below ``LOOSE`` times it. Otherwise it is an error, never a silent answer.

Rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do entries whose whole number exceeds
``LARGEST``. Vectors of different lengths cannot share a covariance: those of the commonest length, the longest among equals, take part.
Repeated rows and ids count each, a null id stays null. Components whose eigenvalue is below ``NONE`` times the largest have no
direction and are left out; without any, and for an empty table, the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 40  # of a whole number; n times it must stay a 64-bit number
WANTED, GUARD, DEGREE = 8, 24, 8
RESIDUAL, LOOSE, ROUNDS = 2e-14, 1e-11, 60
NONE = 1e-9


def whole(column, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(taken, x)``: which vectors of an Arrow list column take part, and their whole numbers, a row each.

    Without ``size`` all lengths take part and ``x`` has no rows.
    """
    column = column.cast(pa.list_(pa.float64()))
    places = column.offsets.to_numpy().astype(np.int64)
    values = column.values  # of the whole buffer; the offsets point into it
    with np.errstate(all="ignore"):
        numbers = np.floor(SCALE * values.fill_null(np.nan).to_numpy(zero_copy_only=False)) + SHIFT
        bad = np.append(0, np.cumsum(~(np.abs(numbers) <= LARGEST)))
    length = np.diff(places)
    taken = column.is_valid().to_numpy(zero_copy_only=False) & (length > 0)
    taken &= bad[places[1:]] == bad[places[:-1]]
    if size is None:
        return taken, np.zeros((0, 0), np.int64)
    taken &= length == size
    if not taken.any():
        return taken, np.zeros((0, size), np.int64)
    return taken, numbers[places[:-1][taken][:, None] + np.arange(size)].astype(np.int64)


@dataclass
class Whitening:
    """Size, sums and leading eigenpairs of the fitted vectors; ``residuals`` is the certificate, ``passes`` the jobs."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n


def _summed(df: DataFrame, vector: str, rows_of, width: int) -> np.ndarray:
    """Sum over all batches of the matrices ``rows_of`` makes of them; as many rows as it has reach the driver."""
    names = [f"c{k}" for k in range(width)]

    def run(batches):
        total = None
        for batch in batches:
            part = rows_of(batch.column(0))
            if part is not None:
                total = part if total is None else total + part
        if total is not None:
            numbers = [pa.array(total[:, k]) for k in range(width)]
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), *numbers], names=["i", *names])

    parts = df.select(F.col(f"`{vector}`")).mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = np.zeros((len(found), width))
    for r in found:
        out[r.i] = [r[c] for c in names]
    return out


def _start(df: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """Number of the vectors that take part and their exact sums per dimension."""

    def lengths(batches):
        for batch in batches:
            taken, _ = whole(batch.column(0))
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)[taken]
            size, times = np.unique(sizes.astype(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(size), pa.array(times.astype(np.int64))], names=["size", "n"])

    only = df.select(F.col(f"`{vector}`"))
    counts = only.mapInArrow(lengths, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), F.desc("size")).first()
    if top is None:
        return 0, np.zeros(0, np.int64)
    size = top["size"]

    def sums(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += whole(batch.column(0), size)[1].sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    found = only.mapInArrow(sums, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()  # one row per dimension
    out = np.zeros(size, np.int64)
    for r in found:
        out[r.i] = r.s
    return top["n"], out


def fit(df: DataFrame, vector: str = "embedding", wanted: int = WANTED, guard: int = GUARD, degree: int = DEGREE) -> Whitening | None:
    """Leading eigenpairs of the covariance of all vectors that take part; None if there are none."""
    n, sums = _start(df, vector)
    if not n:
        return None
    d = len(sums)
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0)

    def times(block: np.ndarray) -> np.ndarray:
        """V times the block, and the trace of V on the way."""

        def part(column):
            _, x = whole(column, d)
            if not len(x):
                return None
            c = model.centred(x)
            return np.column_stack([c.T @ (c @ block), (c * c).sum(axis=0)])

        out = _summed(df, vector, part, block.shape[1] + 1) / n
        model.trace = float(out[:, -1].sum())
        model.passes += 1
        return out[:, :-1]

    k = min(d, wanted + guard)
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    low, worst = None, np.inf
    for _ in range(ROUNDS):
        product = times(q)
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        order = np.argsort(values)[::-1]
        values, q, product = values[order], q @ turn[:, order], product @ turn[:, order]
        residuals = np.linalg.norm(product - q * values, axis=0)[:wanted]
        size = max(float(values[0]), 0.0)
        if not size or k == d or residuals.max() <= RESIDUAL * size:
            break
        if residuals.max() <= LOOSE * size and residuals.max() > worst / 4:
            break  # rounding holds it
        worst = residuals.max()
        lanczos = None if low is not None else _Lanczos(rng.standard_normal(d))
        q = _filtered(times, q, values, low or 0.0, degree, lanczos)
        if lanczos:
            low = lanczos.bound()
        q = np.linalg.qr(q)[0]
    else:
        raise RuntimeError(f"residuals {residuals / size} after {model.passes} passes")
    real = int((values[:wanted] > NONE * size).sum()) if size else 0
    model.values, model.vectors, model.residuals = values[:real], q[:, :real], residuals[:real]
    if real:
        model.identity_error = _identity_error(df, vector, model)
    return model


class _Lanczos:
    """Lanczos steps whose products come from the filter's passes."""

    def __init__(self, start: np.ndarray):
        self.basis = [start / np.linalg.norm(start)]
        self.diagonal, self.beside = [], []
        self.done = False

    def step(self, product: np.ndarray) -> None:
        if self.done:
            return
        self.diagonal.append(float(self.basis[-1] @ product))
        basis = np.array(self.basis)
        for _ in range(2):  # against all directions so far, twice
            product = product - basis.T @ (basis @ product)
        size = float(np.linalg.norm(product))
        self.beside.append(size)
        self.done = size <= 1e-12 * max(map(abs, self.diagonal)) or len(self.basis) == len(product)
        if not self.done:
            self.basis.append(product / size)

    def bound(self) -> float:
        """No eigenvalue is likely to lie below this, nor below 0."""
        inner = self.beside[:-1]
        values = np.linalg.eigvalsh(np.diag(self.diagonal) + np.diag(inner, 1) + np.diag(inner, -1))
        return max(0.0, float(values[0]) - self.beside[-1])


def _filtered(times, q: np.ndarray, values: np.ndarray, low: float, degree: int, lanczos: _Lanczos | None) -> np.ndarray:
    """A Chebyshev polynomial of V on ``q``: small between ``low`` and the block's last value, scaled to stay in range."""
    high, top = float(values[-1]), float(values[0])
    low = min(low, high)
    middle = (high + low) / 2
    half = max((high - low) / 2, 1e-12 * top)
    sigma = half / (top - middle) if top > middle else 1.0
    first = sigma

    def product(block: np.ndarray) -> np.ndarray:
        if lanczos is None or lanczos.done:
            return times(block)
        out = times(np.column_stack([block, lanczos.basis[-1]]))
        lanczos.step(out[:, -1])
        return out[:, :-1]

    before, now = q, (product(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (product(now) - middle * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    return model.centred(x) @ model.vectors / np.sqrt(model.values)


def _identity_error(df: DataFrame, vector: str, model: Whitening) -> float:
    d, k = len(model.sums), len(model.values)

    def part(column):
        _, x = whole(column, d)
        if not len(x):
            return None
        w = _whitened(model, x)
        return np.column_stack([w.T @ w, w.sum(axis=0)])

    sums = _summed(df, vector, part, k + 1) / model.n
    mean = sums[:, -1]
    return float(np.abs(sums[:, :-1] - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(model: Whitening, x: np.ndarray) -> pa.Array:
    """Exact sums of (n * x - S)^2; null where they exceed 64 bits."""
    off = model.n * x - model.sums
    size = (off.astype(np.float64) ** 2).sum(axis=1)
    if len(off) and size.max() >= 2.0**62:
        exact = [sum(v * v for v in row) for row in off.tolist()]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
    return pa.array((off * off).sum(axis=1))


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Each vector that takes part, with ``whitened`` (a value per component) and ``deviation``, next to the columns ``keep``."""
    new = ["deviation", "whitened"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    rows = df.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{vector}`").alias("v"))
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, deviation long, whitened array<double>"

    def run(batches):
        for batch in batches:
            if model is None or not len(model.values):
                continue
            taken, x = whole(batch.column("v"), len(model.sums))
            if not len(x):
                continue
            w = _whitened(model, x)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(w.ravel()))
            own = batch.column("row").filter(pa.array(taken))
            yield pa.record_batch([own, _deviations(model, x), lists], names=["row", *new])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *new)
