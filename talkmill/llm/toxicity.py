"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Training, on a bounded sample of labelled texts:

- Ordinary text trains a zstandard dictionary. Its content is the common part of all dictionaries.
- The windows of toxic and of ordinary text each train a dictionary of their own, which follows the common part. So
  phrases of words that ordinary texts also use save bytes too.
- A lexicon is an addition to these: words, and runs of character 4-grams, that far more toxic than
  ordinary texts hold, and that ordinary texts nearly lack, end a copy of the ordinary dictionary, the best ones last,
  where matches are cheapest. The others have filler there, so offsets into the parts before agree.
- A window is ``WINDOW`` consecutive words. What the toxic dictionary and the lexicon save on it, in bytes, is compared with
  thresholds: the saving's log-likelihood ratio, from counts over the windows of half of the sample. The savings of the
  toxic dictionary are counted on texts that it was not trained on.
- The half that trains no dictionary calibrates the document: a logistic function of the summed and mean ratios, the largest
  savings and the number of windows.

Texts are used whole, in lower case. Null, empty and wordless texts have no windows and get the score that the logistic function gives
for nothing found. Without labelled texts of both kinds every score is 0.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.llm.arrays import slices, text_bytes, words

SAMPLE_TEXTS = 2500  # expected texts per class that are trained on
SAMPLE_CHARS = 20_000_000  # of all texts trained on; those that come last in hash order are left out beyond it
WINDOW = 8  # words
TOP, REACH = 8, 16  # savings of the lexicon, and of the toxic dictionary, are counted up to this many bytes
COMMON_BYTES = 16_384
CLASS_BYTES = 16_384  # of each dictionary: what the windows of one class alone train
SPECIAL_BYTES, TAIL_BYTES = 2_048, 32
GRAM = 4
LIFT, DEVIATIONS = 20.0, 6.0  # how much more frequent a 4-gram or word must be among toxic texts
PIECE_BYTES, SUPPORT = 5, 0.004  # of a piece: least bytes, least contexts as a share of the toxic texts
CARRIER = slice(COMMON_BYTES - 2500, COMMON_BYTES - 2436)  # bytes of the common part in front of every window
CHUNK_BYTES = 2 << 20

_WORD = re.compile(r"[^\W\d_]+")
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[0x09:0x0E] = 0x20


@lru_cache(4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compressor that searches its whole dictionary for matches of four bytes or more."""
    settings = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=18, search_log=8, min_match=4, target_length=64,
        strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=settings)


def _lengths(content: bytes, data: bytes, spans: np.ndarray) -> np.ndarray:
    out = _compressor(content).multi_compress_to_buffer(zstandard.BufferWithSegments(data, spans.tobytes()))
    return np.fromiter(map(len, out), np.int64, len(spans))


def _carried(carrier: np.ndarray, data: np.ndarray, spans: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The windows one after the other, each behind the carrier.

    Very short input is stored and not compressed, whatever the dictionary; the carrier, which both dictionaries
    hold, takes every window past that.
    """
    size = spans[:, 1].astype(np.int64)
    length = size + len(carrier)
    begin = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint8)
    out[begin[:, None] + np.arange(len(carrier))] = carrier
    before = np.cumsum(size) - size
    places = np.arange(int(size.sum()))
    shift = np.repeat(spans[:, 0].astype(np.int64) - before, size)
    target = places + np.repeat(begin + len(carrier) - before, size)
    out[target] = data[places + shift]
    return out.tobytes(), np.stack([begin, length], axis=1).astype(np.uint64)


def _windows(data: np.ndarray, offsets: np.ndarray, n: int):
    """Spans of all windows with the white space around them, and the row of each."""
    _, first, start, end = words(data, offsets)
    count = np.diff(first)
    per_row = -(-count // n)
    row = np.repeat(np.arange(len(count)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    a = first[row] + nth * n
    b = np.minimum(a + n, first[row + 1]) - 1
    begin = np.maximum(start[a] - 1, offsets[row])
    stop = np.minimum(end[b] + 1, offsets[row + 1])
    return np.stack([begin, stop - begin], axis=1).astype(np.uint64), row


@dataclass
class Toxicity:
    """The dictionaries, the ratios of savings, and the logistic function.

    ``toxic`` is the ordinary one ended by the lexicon, ``trained`` the one of the toxic windows.
    """

    ordinary: bytes
    toxic: bytes
    trained: bytes
    ratios: np.ndarray
    trained_ratios: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    def savings(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Savings of the lexicon from 0 to ``TOP``, those of the toxic dictionary within ``REACH``, and the window's row.

        Rows are taken in chunks, so that the copies of their windows have a bound.
        """
        parts = []
        for a, b in slices(offsets, CHUNK_BYTES):
            at = offsets[a : b + 1]
            foul, own, row = self._savings(data[at[0] : at[-1]], at - at[0])
            parts.append((foul, own, row + a))
        empty = np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*parts))) if parts else (empty, empty, empty)

    def _savings(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spans, row = _windows(data, offsets, WINDOW)
        if not len(spans):
            return row, row, row
        carrier = np.frombuffer(self.ordinary[CARRIER], np.uint8)
        raw, spans = _carried(carrier, _SPACES[data], spans)
        plain = _lengths(self.ordinary, raw, spans)
        foul, own = (plain - _lengths(c, raw, spans) for c in (self.toxic, self.trained))
        return np.clip(foul, 0, TOP), np.clip(own, -REACH, REACH), row

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per row: summed ratios and largest savings of both, and the logarithm of the windows."""
        rows = len(offsets) - 1
        foul, own, row = self.savings(data, offsets)
        count = np.bincount(row, minlength=rows)
        total = np.bincount(row, self.trained_ratios[own + REACH], rows)

        def largest(saved: np.ndarray) -> np.ndarray:
            top = np.zeros(rows)
            np.maximum.at(top, row, saved)
            return top

        columns = [np.bincount(row, self.ratios[foul], rows), largest(foul), np.bincount(row, foul >= 3, rows)]
        columns += [total, total / np.maximum(count, 1), largest(own), np.log1p(count)]
        return np.stack(columns, axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = (self.features(data, offsets) - self.means) / self.scales
        z = np.concatenate([np.ones((len(x), 1)), x], axis=1) @ self.weights
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 12)  # equal texts have equal scores


def _grams(word: str):
    word = f" {word} "
    return (word[i : i + GRAM] for i in range(len(word) - GRAM + 1))


def _contexts(texts: list[str]) -> Counter:
    """How many different words stand before each word.

    Words become numbers text by text, so only different words and pairs of numbers are held at once.
    """
    numbers: dict[str, int] = {"": 0}  # before the first word
    pairs = []
    for text in texts:
        words = _WORD.findall(text)
        own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        pairs.append(np.unique(np.append(0, own)[:-1] << 32 | own))
    found = np.unique(np.concatenate(pairs)) & ((1 << 32) - 1) if pairs else np.zeros(0, np.int64)
    times = np.bincount(found, minlength=len(numbers))
    return Counter({w: int(times[i]) for w, i in numbers.items() if times[i]})


def _special(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words and pieces of words that mark toxic texts, best first.

    Counted are the different words before a word, not texts or places: copies of a toxic text would
    otherwise make its rare words look typical.
    """
    foul, plain = _contexts(toxic), _contexts(ordinary)
    n, m = max(foul.total(), 1), max(plain.total(), 1)
    least = max(3, SUPPORT * len(toxic))

    def marks(part: str, a: Counter, b: Counter) -> bool:
        share = (a[part] + b[part]) / (n + m)
        apart = a[part] / n - b[part] / m
        often = a[part] >= least and a[part] / n >= LIFT * (b[part] + 0.5) / m
        return often and apart >= DEVIATIONS * math.sqrt(share * (1 / n + 1 / m))

    def holding(words: Counter) -> Counter:
        out: Counter = Counter()
        for w, times in words.items():
            for g in set(_grams(w)):
                out[g] += times
        return out

    grams_a, grams_b = holding(foul), holding(plain)
    words_a, words_b = (Counter({f" {w} ": times for w, times in words.items()}) for words in (foul, plain))
    marked = {g for g in grams_a if marks(g, grams_a, grams_b)}
    pieces: Counter = Counter({w: c for w, c in words_a.items() if marks(w, words_a, words_b)})
    for word, times in foul.items():
        text = f" {word} "
        hit = [text[i : i + GRAM] in marked for i in range(len(text) - GRAM + 1)]
        begin = None
        for i, h in enumerate([*hit, False]):
            if h and begin is None:
                begin = i
            elif not h and begin is not None:
                pieces[text[begin : i + GRAM - 1]] += times
                begin = None
    kept: list[str] = []
    inside = "\n".join(f" {w} " for w in plain)
    for piece, times in sorted(pieces.items(), key=lambda x: (-x[1], x[0])):
        if times >= least and len(piece.encode()) >= PIECE_BYTES and not any(piece in k for k in kept):
            if piece not in inside or piece in words_a:
                kept.append(piece)
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.large_string()))


def _dictionary(texts: list[str], size: int) -> bytes:
    """Dictionary of ``size`` bytes trained on all windows of the texts; the texts themselves where training finds too little."""
    data, offsets = _buffer(texts)
    spans, _ = _windows(data, offsets, WINDOW)
    raw = _SPACES[data].tobytes()
    try:
        return zstandard.train_dictionary(size, [raw[a : a + n] for a, n in spans.astype(int)]).as_bytes().ljust(size)
    except zstandard.ZstdError:  # the trainer wants several times ``size`` of text
        return raw[:size].ljust(size)


def train(texts: list[str], labels: list[int], prior: float = 0.5) -> Toxicity | None:
    """Model from labelled texts; None unless both labels occur. Equal input gives an equal model.

    ``prior`` is the toxic share of all labelled texts, of which the sample may hold more.
    """
    texts = [t.lower() for t in texts]
    y = np.array(labels)
    if not 0 < y.sum() < len(y):
        return None
    toxic, ordinary = ([t for t, l in zip(texts, y) if l == k] for k in (1, 0))
    pieces = "".join(reversed(_special(toxic, ordinary))).encode()
    # The last bytes of a dictionary are not indexed, so filler follows the pieces.
    special = (pieces[-SPECIAL_BYTES + TAIL_BYTES :] + b"\xff" * TAIL_BYTES).rjust(SPECIAL_BYTES, b"\xff")
    half = np.arange(len(texts)) % 2 == 0  # the texts come in hash order
    if len(set(y[half])) < 2 or len(set(y[~half])) < 2:
        half = np.ones(len(texts), bool)
    rest = ~half if not half.all() else half
    common = _dictionary([t for t, l in zip(texts, y) if l == 0], COMMON_BYTES)
    own = [_dictionary([t for t, h, l in zip(texts, half, y) if h and l == k], CLASS_BYTES) for k in (0, 1)]
    filler = b"\xff" * SPECIAL_BYTES  # does not occur in UTF-8
    model = Toxicity(
        common + own[0] + filler, common + own[0] + special, common + own[1] + filler,
        np.zeros(TOP + 1), np.zeros(2 * REACH + 1), np.zeros(0), np.zeros(0), np.zeros(0),
    )

    def ratio(saved: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
        counts = [np.bincount(saved[toxic == c], minlength=size) + 0.5 for c in (0, 1)]
        return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    data, offsets = _buffer([t for t, h in zip(texts, half) if h])
    saved, _, row = model.savings(data, offsets)
    model.ratios = ratio(saved, y[half][row], TOP + 1)
    data, offsets = _buffer([t for t, h in zip(texts, rest) if h])
    _, saved, row = model.savings(data, offsets)
    model.trained_ratios = ratio(saved + REACH, y[rest][row], 2 * REACH + 1)
    x = model.features(data, offsets)
    model.means, model.scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _logistic((x - model.means) / model.scales, y[rest])
    model.weights[0] += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    return model


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id: str = "doc_id", text: str = "text",
    label: str = "toxic", sample: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS,
) -> Toxicity | None:
    """Train on a sample of about ``sample`` labelled texts per class, chosen by a hash of the id.

    ``allowed`` is a condition on the id's row of ``labels``. An id that is labelled more than once is toxic if one of its labels is;
    of several texts with one id the one with the smallest hash is taken. ``chars`` bounds the sample's characters: texts enter in
    hash order, whatever their length, until they would exceed it.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull())
    known = known if allowed is None else known.where(allowed)
    known = known.groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # one row per class
    order = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    share = F.lit(0.0)
    for k, n in totals.items():
        share = F.when(F.col("toxic") == k, min(1.0, sample / n)).otherwise(share)
    chosen = known.where(order < share)  # about 2 * sample rows whatever the input
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic")
    rows = rows.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    upto = W.orderBy(F.xxhash64("id", F.lit(1)), "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum(F.length("text")).over(upto))  # one row per chosen id
    rows = rows.where(F.col("upto") <= chars).select(F.lit(0).alias("all"), "id", "text", "toxic")
    prior = min(max(totals.get(1, 0) / max(sum(totals.values()), 1), 1e-6), 1 - 1e-6)

    def run(table: pa.Table) -> pa.Table:
        """Train in a task: the bounded sample needs memory that a driver may lack."""
        columns = (table.column(c).to_pylist() for c in ("id", "text", "toxic"))
        held = sorted(zip(*columns), key=lambda r: (hash_order(r[0]), r[1]))
        model = train([t for _, t, _ in held], [y for *_, y in held], prior)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    done = rows.groupBy("all").applyInArrow(run, "model binary").first()
    return pickle.loads(done.model) if done else None


def hash_order(value) -> int:
    """A fixed order that has nothing to do with size."""
    return int.from_bytes(str(value).encode(), "big") * 0x9E3779B97F4A7C15 % (1 << 64)


def score(
    df: DataFrame, model: Toxicity | None, text: str = "text", out: str = "toxicity", keep: list[str] | None = None
) -> DataFrame:
    """Add the score of every text, from 0 to 1, to the columns ``keep``, all if not given."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    if model is None:
        return df.select(*[F.col(f"`{c}`") for c in kept], F.lit(0.0).alias(out))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.lower(F.col(f"`{text}`")).alias("text")
    )

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, CHUNK_BYTES):
                at = offsets[a : b + 1]
                found = model.scores(data[at[0] : at[-1]], at - at[0])
                yield pa.record_batch([batch.column("row").slice(a, b - a), pa.array(found)], names=["row", "score"])

    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"row {kind}, score double")
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("score").alias(out))


def held_out(id: str, parts: int = 5) -> Column:
    """Whether crc32 of the id as text falls into the first of ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % parts == 0
