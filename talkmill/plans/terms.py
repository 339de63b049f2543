"""Word n-grams as numbers: the most frequent ones of a table, and their counts per row.

An n-gram is its first n - 1 words, which are an n-gram of the order below with a number, and its last word. So a batch of
texts looks its words up once, and everything after that is arithmetic on arrays of whole numbers.

Texts of Latin-1 letters come as they are and are split here, many together, as bytes; all others are split into words in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.text import word_tokens

SLACK = 5_000  # rows fetched besides the terms wanted, for terms as frequent as the last of them
MOST = 200_000  # n-grams of one order that are numbered
ROWS = 4_096  # texts that are counted together, at most
COUNTED, SCALED = 1 << 20, 1 << 18  # words that are counted together, and that are made into vectors together, but for longer texts
CHARS = 1 << 22  # characters that are split into words together, but for longer texts
# The words of ``word_tokens`` for the first 256 characters: letters, numbers and the low line, in lower case.
_CHARS = [chr(i) for i in range(256)]
_WORD = bytes(unicodedata.category(c)[0] in "LN" or c == "_" for c in _CHARS)
_LOWER = bytes(ord(c.lower()) for c in _CHARS)


def words_column(text: Column) -> Column:
    """Texts whose words ``words_of`` finds: ``text`` where all characters are of Latin-1, else its ``words``."""
    simple = ~text.rlike(r"[^\x00-\xFF]")
    return F.struct(F.when(simple, text).alias("text"), F.when(~simple, word_tokens(text)).alias("words"))


def word_lists(tokens: Column) -> Column:
    """The words of ``words_column`` as lists."""
    return F.coalesce(tokens["words"], word_tokens(tokens["text"]))


def words_of(column: pa.Array) -> Iterator[pa.Array]:
    """Lists of words of a batch, in runs of rows; the column is that of ``words_column``, or lists already."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_struct(column.type):
        yield column
        return
    texts, lists = column.field("text"), column.field("words")
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(column):
        end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHARS, "right")), begin + 1)
        split, other = _split(texts.slice(begin, end - begin).to_pylist()), lists.slice(begin, end - begin)
        if other.null_count < len(other):
            at = np.arange(len(other))
            at = np.where(other.is_valid().to_numpy(zero_copy_only=False), at + len(other), at)
            split = pa.concat_arrays([split, other.cast(split.type)]).take(pa.array(at))
        yield split
        begin = end


def _split(texts: list[str | None]) -> pa.ListArray:
    """``word_tokens`` of texts of Latin-1 characters."""
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    # A line break before, between and after the texts: no word reaches over it.
    raw = b"\n" + "".join(f"{t or ''}\n" for t in texts).encode("latin-1")
    mark = np.frombuffer(raw.translate(_WORD), np.uint8)
    edges = np.flatnonzero(mark[1:] != mark[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    kept = mark.astype(bool)
    kept[starts[size < 2]] = False
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)[kept]
    starts, size = starts[size >= 2], size[size >= 2]
    offsets = np.append(0, np.cumsum(size))
    if len(data) and data.max() >= 128:
        wide = np.add.reduceat((data >= 128).astype(np.int64), offsets[:-1])
        offsets += np.append(0, np.cumsum(wide))
        data = np.frombuffer(data.tobytes().decode("latin-1").encode(), np.uint8)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    rows = np.append(0, np.searchsorted(starts, np.cumsum(sizes)))
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), words)


@dataclass
class Levels:
    """Numbered n-grams: words, then for every higher order the sorted keys ``number of all but the last word * words + last word``.

    ``places`` has the column of every numbered n-gram, -1 for one that only begins others.
    """

    words: pa.Array
    keys: list[np.ndarray]
    places: list[np.ndarray]

    @classmethod
    def of(cls, terms: Sequence[str], low: int, high: int) -> "Levels":
        """Levels that find ``terms`` of ``low`` to ``high`` words; a term's place is its position."""
        split = [(i, t.split(" ")) for i, t in enumerate(terms)]
        split = [(i, t) for i, t in split if low <= len(t) <= high]
        names = sorted({w for _, t in split for w in t})
        number, size = {w: i for i, w in enumerate(names)}, max(len(names), 1)
        codes = {(w,): i for w, i in number.items()}
        keys, places, known = [], [], {tuple(t): i for i, t in split}
        places.append(np.array([known.get((w,), -1) for w in names], np.int64))
        for n in range(2, high + 1):
            grams = {codes[tuple(t[: n - 1])] * size + number[t[n - 1]]: tuple(t[:n]) for _, t in split if len(t) >= n}
            order = sorted(grams)
            codes = {grams[k]: i for i, k in enumerate(order)}
            keys.append(np.array(order, np.int64))
            places.append(np.array([known.get(grams[k], -1) for k in order], np.int64))
        return cls(pa.array(names, pa.string()), keys, places)

    def codes(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per order: the row of every n-gram's first word, the n-gram's number or -1, and the number of every word.

        The arrays have a place for every word of the batch; n-grams do not reach over the end of a row.
        """
        flat, row = _flat(words)
        word = pc.fill_null(pc.index_in(flat, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        gram = word
        yield row, gram, word
        for n, keys in enumerate(self.keys, 2):
            gram = _numbers(_keys(row, gram, word, n, len(self.words)), keys)
            yield row, gram, word


def _flat(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all rows and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return words.flatten(), np.repeat(np.arange(len(words)), sizes)


def _keys(row: np.ndarray, gram: np.ndarray, word: np.ndarray, n: int, size: int) -> np.ndarray:
    """Key of the n-gram that begins at every word: -1 without a number for its first n - 1 words or its last, or beyond the row."""
    out = np.full(len(word), -1, np.int64)
    m = len(word) - (n - 1)
    if m > 0:
        last = word[n - 1 :]
        good = (gram[:m] >= 0) & (last >= 0) & (row[:m] == row[n - 1 :])
        out[:m] = np.where(good, gram[:m] * size + last, -1)
    return out


def _numbers(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys, or -1."""
    out = np.full(len(wanted), -1, np.int64)
    at = np.flatnonzero(wanted >= 0)
    if len(keys) and len(at):
        place = np.minimum(np.searchsorted(keys, wanted[at]), len(keys) - 1)
        hit = keys[place] == wanted[at]
        out[at[hit]] = place[hit]
    return out


def _slices(words: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of rows with no more than ``most`` words together, so that the memory of a task does not follow the batch."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < len(words):
        before = ends[begin - 1] if begin else 0
        end = min(max(int(np.searchsorted(ends, before + most, "right")), begin + 1), begin + ROWS)
        yield words.slice(begin, end - begin)
        begin = end


def _runs(column: pa.Array, most: int) -> Iterator[pa.Array]:
    for words in words_of(column):
        yield from _slices(words, most)


def _counts(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, how often each occurs, and in how many rows."""
    cells = np.sort(key * ROWS + row)
    fresh = np.ones(len(cells), bool)
    fresh[1:] = cells[1:] != cells[:-1]
    own = cells // ROWS
    begin = np.ones(len(cells), bool)
    begin[1:] = own[1:] != own[:-1]
    at = np.flatnonzero(begin)
    if not len(at):
        return own, own, own
    return own[at], np.diff(np.append(at, len(own))), np.add.reduceat(fresh.astype(np.int64), at)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in _runs(batch.column(0), COUNTED):
            flat, row = _flat(words)
            coded = flat.dictionary_encode()
            key, tf, df = _counts(row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            term = coded.dictionary.take(pa.array(key))
            yield pa.RecordBatch.from_arrays([term, pa.array(tf), pa.array(df)], ["gram", "tf", "df"])


def _gram_counts(shared, n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for words in _runs(batch.column(0), COUNTED):
                *_, (row, gram, word) = levels.codes(words)
                key = _keys(row, gram, word, n, len(levels.words))
                # The last n - 1 words must be frequent too.
                key[:-1][gram[1:] < 0] = -1
                held = key >= 0
                key, tf, df = _counts(row[held], key[held])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tf), pa.array(df)], ["gram", "tf", "df"])

    return count


def frequent(lists: DataFrame, low: int, high: int, limit: int, min_df: int = 1) -> list[tuple[str, int]] | None:
    """The ``limit`` most frequent n-grams, ties by term, with their document frequency; ``words_column`` is ``__tokens``.

    An n-gram is at most as frequent as any shorter one inside it. So with ``limit`` n-grams known, a longer one is only counted
    if all its parts are as frequent as the last of them: one pass per order, and what reaches the driver are the terms wanted
    and those as frequent as the last. ``None`` if the parts are more than can be numbered, or short n-grams are not wanted
    and give no bound.
    """
    if low > 1:
        return None
    spark, words = lists.sparkSession, lists.select("__tokens")
    found: list[tuple[int, str, int]] = []  # (-count, term, rows) of all orders so far
    floor, levels, names = 1, None, []
    for n in range(1, high + 1):
        if n == 1:
            cells = words.mapInArrow(_word_counts, "gram string, tf long, df long")
        else:
            cells = words.mapInArrow(_gram_counts(spark.sparkContext.broadcast(levels), n), "gram long, tf long, df long")
        counted = cells.groupBy("gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        counted = counted.where((F.col("df") >= min_df) & (F.col("tf") >= floor))
        rows = counted.orderBy(F.desc("tf")).limit(limit + SLACK).collect()
        full = len(rows) == limit + SLACK
        floor = max(floor, _last([-c for c, *_ in found] + [r["tf"] for r in rows], limit))
        if full and rows[-1]["tf"] >= floor:
            rows = counted.where(F.col("tf") >= floor).limit(MOST + 1).collect()
            if len(rows) > MOST:
                return None
        rows = sorted((r for r in rows if r["tf"] >= floor), key=lambda r: r["gram"])
        if n == 1:
            names = [r["gram"] for r in rows]
            grams = names
            levels = Levels(pa.array(names, pa.string()), [], [])
        else:
            heads = [divmod(r["gram"], len(names)) for r in rows]
            grams = [f"{grams[a]} {names[b]}" for a, b in heads]
            levels = Levels(levels.words, [*levels.keys, np.array([r["gram"] for r in rows], np.int64)], [])
        found = [f for f in found if -f[0] >= floor] + [(-r["tf"], g, r["df"]) for g, r in zip(grams, rows)]
        if not rows:
            break
    return [(term, df) for _, term, df in sorted(found)[:limit]]


def _last(counts: list[int], limit: int) -> int:
    """Count of the last of the ``limit`` largest; 1 if there are fewer."""
    return sorted(counts, reverse=True)[limit - 1] if len(counts) >= limit else 1


def vectors(words: pa.Array, levels: Levels, width: int, idf: np.ndarray | None) -> pa.Array:
    """Sparse vectors of counts, or with ``idf`` of ``(1 + ln count) * idf`` scaled to length 1."""
    parts = [_vectors(w, levels, width, idf) for w in _runs(words, SCALED)]
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    return pa.chunked_array(parts, kind).combine_chunks() if len(parts) != 1 else parts[0]


def _vectors(words: pa.Array, levels: Levels, width: int, idf: np.ndarray | None) -> pa.StructArray:
    cells = [np.empty(0, np.int64)]
    for places, (row, gram, _) in zip(levels.places, levels.codes(words)):
        at = np.flatnonzero(gram >= 0)
        place = places[gram[at]]
        cells.append((row[at] * width + place)[place >= 0])
    cells = np.sort(np.concatenate(cells))
    at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.empty(0, np.int64)
    row, place = np.divmod(cells[at], width)
    values = np.diff(np.append(at, len(cells))).astype(float)
    ends = np.searchsorted(row, np.arange(len(words) + 1))
    if idf is not None:
        values = (1 + np.log(values)) * idf[place]
        squares = values * values
        norms = np.sqrt([squares[a:b].sum() for a, b in zip(ends, ends[1:])])
        values = values / np.where(norms > 0, norms, 1.0)[row]
    ends = pa.array(ends.astype(np.int32))
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(len(words), np.int8)), pa.array(np.full(len(words), width, np.int32)),
            pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values)),
        ],
        ["type", "size", "indices", "values"],
    )
