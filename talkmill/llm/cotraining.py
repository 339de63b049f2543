"""Quality by co-training: one classifier reads the text, one the page around it, and they teach each other.

The text view holds what the words and characters are: shares of character classes and of byte pairs, word lengths,
repetition of words. The page view holds what surrounds them: source, language, declared length, number, length and
repetition of lines. Both are logistic regressions.

Both start from the labelled rows. In every round each view scores all rows without a label, those it is sure of become training rows of
the *other* view, with less weight than labelled ones, and both are fitted again. A fifth of the labelled
rows is kept from training; on it a logistic function of both views' log-odds calibrates their combination, and one
of each view alone.

Features are written once to the checkpoint folder. A Newton step is one pass over them in which every task returns the sums of its
rows, a matrix as wide as the view; no row reaches the driver, and labelled and pseudo-labelled rows of all
documents count, not a sample.

Null texts count as empty; a null source or language is a value of its own. A label that differs between rows of one id is dropped.
Without labels of both kinds every score is the share of good labels, one half if there are none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.arrays import mix, slices, sums, text_bytes, words
from talkmill.session import checkpointed

ROUNDS = 3
STEPS = 4  # Newton steps per round; each round starts from the weights of the last one
SURE = 0.98  # probability from which a pseudo-label is given
PSEUDO_WEIGHT = 0.25
RIDGE = 1.0
PAIR_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 32, 16, 8
CHUNK_BYTES = 2 << 20
MERGE_GROUPS = 16  # tasks that add up the sums of the others

_CLASSES = np.full(256, 6, np.int8)  # other signs
for _number, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", b"|")):
    _CLASSES[list(_bytes)] = _number
_CLASSES[list(b"!?")] = 7
_CLASSES[list(b"%&*$#@^~=<>")] = 8
_CLASSES[128:] = 9
_N_CLASSES = 10
_LINES = np.arange(256, dtype=np.uint8)  # makes lines what words are: only line ends separate
_LINES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 1


def _repeats(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: share of different items, share of the most frequent one, share equal to the item before."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = np.maximum(np.diff(first), 1)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))[: len(h)]
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(h)))
    top = np.zeros(len(n))
    np.maximum.at(top, r[starts], runs)
    again = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])))[: len(hashes)]
    return np.bincount(r[starts], minlength=len(n)) / n, top / n, sums(again.astype(float), first) / n


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    row = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(row * _N_CLASSES + _CLASSES[data], minlength=n * _N_CLASSES).reshape(n, -1) / size[:, None]
    pair = (mix(data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]) % np.uint64(PAIR_BUCKETS)).astype(np.int64)
    inside = row[:-1] == row[1:]
    pairs = np.bincount(row[:-1][inside] * PAIR_BUCKETS + pair[inside], minlength=n * PAIR_BUCKETS).reshape(n, -1)
    hashes, first, start, end = words(data, offsets)
    count = np.diff(first)
    length = sums((end - start).astype(float), first) / np.maximum(count, 1)
    return np.column_stack(
        [shares, pairs / size[:, None], np.log1p(length), *_repeats(hashes, first), np.log1p(count), count == 0]
    )


def page_view(data: np.ndarray, offsets: np.ndarray, source: np.ndarray, lang: np.ndarray, declared: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    hashes, first, start, end = words(_LINES[data], offsets)
    count = np.diff(first)
    width = (end - start).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, np.repeat(np.arange(n), count), width)
    kinds = [np.zeros((n, b)) for b in (SOURCE_BUCKETS, LANG_BUCKETS)]
    for table, values in zip(kinds, (source, lang)):
        table[np.arange(n), (mix(values.astype(np.uint64)) % np.uint64(table.shape[1])).astype(int)] = 1
    ends = np.flatnonzero(data == 0x0A)
    breaks = np.searchsorted(ends, offsets[1:]) - np.searchsorted(ends, offsets[:-1])
    chars = np.log1p(np.maximum(declared, 0))
    return np.column_stack(
        [*kinds, chars, chars - np.log1p(np.diff(offsets)), np.log1p(count), np.log1p(longest),
         np.log1p(sums(width, first) / np.maximum(count, 1)), *_repeats(hashes, first), np.log1p(breaks)]
    )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("source", "lang", "declared")]
        for a, b in slices(offsets, CHUNK_BYTES):
            at = offsets[a : b + 1]
            piece, at = data[at[0] : at[-1]], at - at[0]
            views = (text_view(piece, at), page_view(piece, at, *(c[a:b] for c in columns)))
            packed = [pa.array([x.tobytes() for x in v.astype(np.float32)], pa.binary()) for v in views]
            yield pa.record_batch([batch.column("id").slice(a, b - a), *packed], names=["id", "text_x", "page_x"])


def features(df: DataFrame, id: str, text: str, source: str, lang: str, declared: str | None) -> DataFrame:
    """``(id, text_x, page_x)``: both views of every row as packed 32-bit floats."""
    chars = F.length(F.coalesce(F.col(text), F.lit(""))) if declared is None else F.col(declared)
    rows = df.select(
        F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(source)).alias("source"),
        F.xxhash64(F.col(lang)).alias("lang"), F.coalesce(chars, F.lit(0)).cast("double").alias("declared"),
    )
    return rows.mapInArrow(_features, f"id {rows.schema['id'].dataType.simpleString()}, text_x binary, page_x binary")


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float32)
    return flat.reshape(n, -1).astype(np.float64)


def _total(df: DataFrame, of, width: int) -> np.ndarray:
    """Sum over all rows of what ``of`` returns for a batch: an array of ``width`` numbers."""

    def tasks(batches):
        out = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                out += of(batch)
        yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    def add(table: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table({"sums": pa.array([out.tobytes()], pa.binary())})

    parts = df.mapInArrow(tasks, "sums binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    merged = parts.groupBy("g").applyInArrow(add, "sums binary").collect()  # at most MERGE_GROUPS rows
    return sum((np.frombuffer(r.sums) for r in merged), np.zeros(width))


def _newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the weighted logistic loss."""
    p = _sigmoid(x @ w)
    return np.concatenate([x.T @ (weight * (y - p)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()])


def _step(total: np.ndarray, w: np.ndarray) -> np.ndarray:
    d = len(w)
    ridge = np.full(d, RIDGE)
    ridge[0] = 1e-6  # the constant is free
    return w + np.linalg.solve(total[d:].reshape(d, d) + np.diag(ridge), total[:d] - ridge * w)


@dataclass
class TwoViews:
    """Scaling and weights of both views, and the calibration of each and of both together."""

    means: list[np.ndarray]
    scales: list[np.ndarray]
    weights: list[np.ndarray]
    alone: list[np.ndarray]
    both: np.ndarray

    def inputs(self, batch) -> list[np.ndarray]:
        out = []
        for name, mean, scale in zip(("text_x", "page_x"), self.means, self.scales):
            x = (_matrix(batch.column(name)) - mean) / scale
            out.append(np.column_stack([np.ones(len(x)), x]))
        return out

    def odds(self, batch) -> list[np.ndarray]:
        return [np.clip(x @ w, -30, 30) for x, w in zip(self.inputs(batch), self.weights)]

    def scores(self, batch) -> list[np.ndarray]:
        z = self.odds(batch)
        one = np.ones(len(z[0]))
        each = [_sigmoid(np.column_stack([one, x]) @ w) for x, w in zip(z, self.alone)]
        return [*each, _sigmoid(np.column_stack([one, *z]) @ self.both)]


def fit(rows: DataFrame) -> TwoViews | None:
    """Co-train on checkpointed ``(id, text_x, page_x, label, calibrates)``; None without both labels."""
    known = {r.label: r["count"] for r in rows.where("label IS NOT NULL").groupBy("label").count().collect()}
    if len(known) < 2:
        return None
    first = rows.first()
    sizes = [len(first[c]) // 4 for c in ("text_x", "page_x")]
    d = sum(sizes)

    def moments(batch):
        x = np.column_stack([_matrix(batch.column(c)) for c in ("text_x", "page_x")])
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    total = _total(rows, moments, 1 + 2 * d)
    mean = total[1 : d + 1] / total[0]
    scale = np.sqrt(np.maximum(total[d + 1 :] / total[0] - mean**2, 0))
    scale[scale < 1e-7] = 1.0
    cut = [slice(0, sizes[0]), slice(sizes[0], d)]
    model = TwoViews(
        [mean[c] for c in cut], [scale[c] for c in cut], [np.zeros(n + 1) for n in sizes],
        [np.array([0.0, 1.0])] * 2, np.array([0.0, 0.5, 0.5]),
    )
    widths = [(n + 1) + (n + 1) ** 2 for n in sizes]

    for turn in range(ROUNDS + 1):
        teachers = None if turn == 0 else [w.copy() for w in model.weights]
        for _ in range(STEPS):
            now = [w.copy() for w in model.weights]

            def sums_of(batch, now=now, teachers=teachers):
                x = model.inputs(batch)
                label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                apart = batch.column("calibrates").to_numpy(zero_copy_only=False).astype(bool)
                out = []
                for k in (0, 1):
                    y, weight = label.copy(), np.where(np.isnan(label) | apart, 0.0, 1.0)
                    if teachers is not None:
                        p = _sigmoid(x[1 - k] @ teachers[1 - k])
                        sure = np.isnan(label) & (np.maximum(p, 1 - p) >= SURE)
                        y[sure], weight[sure] = p[sure] > 0.5, PSEUDO_WEIGHT
                    use = weight > 0
                    out.append(_newton_sums(x[k][use], y[use], weight[use], now[k]))
                return np.concatenate(out)

            total = _total(rows, sums_of, sum(widths))
            model.weights = [_step(total[: widths[0]], now[0]), _step(total[widths[0] :], now[1])]

    kept = rows.where("calibrates AND label IS NOT NULL")
    for _ in range(2 * STEPS):
        now = [*model.alone, model.both]

        def calibration(batch, now=now):
            z, y = model.odds(batch), batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            one = np.ones(len(y))
            inputs = [np.column_stack([one, z[0]]), np.column_stack([one, z[1]]), np.column_stack([one, *z])]
            return np.concatenate([_newton_sums(x, y, one, w) for x, w in zip(inputs, now)])

        total = _total(kept, calibration, 6 + 6 + 12)
        model.alone = [_step(total[:6], now[0]), _step(total[6:12], now[1])]
        model.both = _step(total[12:], now[2])
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    lang: str = "lang", declared: str | None = "n_chars", label: str = "quality",
) -> DataFrame:
    """``(id, text_score, page_score, score)`` for every row: the probability of good quality by each view and both.

    Rows whose crc32(id as text) mod 5 is 1 calibrate; all other labelled rows train.
    """
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id).alias("label_id")).agg(
        F.min(label).alias("low"), F.max(label).cast("int").alias("label")
    )
    known = known.where("low = label").select("label_id", "label")
    rows = features(docs, id, text, source, lang, declared)
    rows = rows.join(known, F.col("id") == F.col("label_id"), "left").drop("label_id")
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = checkpointed(rows.withColumn("calibrates", F.crc32(text_id.cast("binary")) % 5 == 1))
    model = fit(rows)
    if model is None:
        share = rows.agg(F.avg("label")).first()[0]
        flat = F.lit(0.5 if share is None else float(share))
        return rows.select("id", *[flat.alias(c) for c in ("text_score", "page_score", "score")])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = map(pa.array, model.scores(batch))
                yield pa.record_batch([batch.column("id"), *found], names=["id", "text_score", "page_score", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_score double, page_score double, score double")
