"""Merge-type SentencePiece encoding with seeded dropout of merges, and decoding without loss.

A text is written with ``▁`` for spaces and one before it, and cut before every run of ``▁`` and around characters
the vocabulary lacks; no piece crosses such a cut. A segment's candidate merges wait in an agenda, best
score first, leftmost first among equals. A candidate is skipped if the keyed hash of seed, segment, occurrence, place
and pair falls below the dropout share. The text's key and the segment's place in the text name the occurrence, so every
occurrence is drawn on its own and segmentations are the same in every run.

Agendas of different segments do not touch each other. So tasks work on blocks of segments of similar length
together, one merge of each per step, in numpy; segments longer than the last of ``WIDTHS`` use an agenda of their own on a
heap.

A character outside the vocabulary, and a ``▁`` of the text itself, becomes the pieces of its bytes. Null texts give
null, empty ones no pieces. The vocabulary file's place is a parameter; tasks read it from the bytes that the driver
sends with the function (0.5 MB, the size of one vocabulary whatever the data).
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.arrays import mix, slices, text_bytes

SPACE = "▁"
WIDTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48)  # segments of similar length share a block of the next of these widths
CHUNK_BYTES = 1 << 20  # text encoded at once
CHUNK_PIECES = 1 << 18  # pieces decoded at once
BLOCK_CELLS = 1 << 18  # characters of segments of one length whose merges advance together
_NONE = np.int32(2**31 - 1)
_FACTOR = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


class Vocabulary:
    """Pieces, merges and byte pieces of a merge-type model."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte) < 256:
            raise ValueError("the vocabulary has no pieces for bytes")
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        self.bytes = [b""] * n  # what a piece stands for
        for i in plain:
            self.bytes[i] = names[i].replace(SPACE, " ").encode()
        for b, i in byte.items():
            self.bytes[i] = bytes([b])
        sizes = np.array([len(b) for b in self.bytes])
        self.place = np.append(0, np.cumsum(sizes))  # of each piece's bytes in ``flat``
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        number = {names[i]: i for i in plain}
        self.symbol = np.full(0x110000, -1, np.int32)
        for name, i in number.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        score = {i: sp.get_score(i) for i in plain}
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, merged, ranks = [], [], []
        for name, i in number.items():
            for cut in range(1, len(name)):
                a, b = number.get(name[:cut]), number.get(name[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    merged.append(i)
                    ranks.append(rank[score[i]])
        self.size = n
        self._table(np.array(keys, np.int64), np.array(merged, np.int32), np.array(ranks, np.int32))

    def _table(self, keys: np.ndarray, merged: np.ndarray, ranks: np.ndarray) -> None:
        """Open hash table of pairs."""
        bits = max(4, int(len(keys) * 4 + 1).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys = np.full((1 << bits) + 64, -1, np.int64)
        self._place = np.zeros(len(self._keys), np.int32)
        self._probes = 1
        spots = self._spot(keys)
        for j, (k, s) in enumerate(zip(keys.tolist(), spots.tolist())):
            probe = 0
            while self._keys[s + probe] >= 0:
                probe += 1
            self._keys[s + probe], self._place[s + probe] = k, j
            self._probes = max(self._probes, probe + 1)
        self._merged, self._ranks = np.append(merged, -1), np.append(ranks, _NONE)

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs; pairs without a merge have the last rank."""
        keys = left.astype(np.int64) * self.size + right
        spot = self._spot(keys)
        at = np.full(len(keys), len(self._merged) - 1, np.int32)
        todo = np.arange(len(keys))
        for probe in range(self._probes):
            found = self._keys[spot + probe]
            hit = found == keys
            at[todo[hit]] = self._place[spot[hit] + probe]
            on = np.flatnonzero(~hit & (found >= 0))  # the slot holds another pair
            if not len(on):
                break
            todo, keys, spot = todo[on], keys[on], spot[on]
        return self._ranks[at], self._merged[at]


@lru_cache(2)
def _vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _skipped(keys: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    """Whether candidates are dropped; ``keys`` stand for seed, segment and occurrence, ``place`` is the first character."""
    spot = (place.astype(np.uint64) << np.uint64(42)) ^ (left.astype(np.uint64) << np.uint64(21)) ^ right.astype(np.uint64)
    return (mix(keys ^ mix(spot)) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def heap_agenda(vocabulary: Vocabulary, symbols: list[int], key: int, share: float) -> list[int]:
    """Pieces of one segment by an agenda on a heap."""
    n = len(symbols)
    piece, size = list(symbols), [1] * n
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple[int, int, int, int, int]] = []

    def add(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] >= 0]
        if not lefts:
            return
        a, b = np.array([piece[i] for i in lefts]), np.array([piece[after[i]] for i in lefts])
        ranks, merged = vocabulary.pairs(a, b)
        places = np.array(lefts)
        drop = _skipped(np.full(len(lefts), key, np.uint64), places, a, b, share) if share else ranks < 0
        for i, x, y, r, m, d in zip(lefts, a.tolist(), b.tolist(), ranks.tolist(), merged.tolist(), drop.tolist()):
            if r != _NONE and not d:
                heapq.heappush(heap, (r, i, x, y, m))

    add(list(range(n - 1)))
    while heap:
        _, i, x, y, m = heapq.heappop(heap)
        j = after[i]
        if not size[i] or j < 0 or piece[i] != x or piece[j] != y:
            continue  # one of its pieces has been merged since
        piece[i], size[j], after[i] = m, 0, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        add([before[i], i])
    return [p for p, s in zip(piece, size) if s]


def _together(vocabulary: Vocabulary, symbols: np.ndarray, size: np.ndarray, keys: np.ndarray, share: float):
    """Yield ``(rows, pieces)`` of segments of similar length; row by row what ``heap_agenda`` gives.

    The rows of ``symbols`` hold ``size`` characters and filler behind. Blocks of at most ``BLOCK_CELLS`` characters bound the
    temporary arrays whatever the text.
    """
    step = max(1, BLOCK_CELLS // symbols.shape[1])
    for begin in range(0, len(symbols), step):
        part = slice(begin, begin + step)
        for rows, left, pieces in _block(vocabulary, symbols[part], size[part].copy(), keys[part], share):
            for n in np.unique(left):
                same = left == n
                yield rows[same] + begin, pieces[same, :n]


def _block(vocabulary: Vocabulary, symbols: np.ndarray, left: np.ndarray, keys: np.ndarray, share: float):
    """Yield ``(rows, left, pieces)``: numbers of rows that are done, how many pieces each has left, and the pieces."""
    rows = np.arange(len(symbols), dtype=np.int32)
    n = symbols.shape[1]
    place = np.broadcast_to(np.arange(n, dtype=np.int16), symbols.shape).copy()

    def rank(key, at, a, b):
        ranks, merged = vocabulary.pairs(a, b)
        if share:
            ranks[_skipped(key, at, a, b, share)] = _NONE
        return ranks, merged

    ranks = np.full((len(symbols), n - 1), _NONE, np.int32)
    merged = np.full((len(symbols), n - 1), -1, np.int32)
    line, at = np.nonzero(np.arange(n - 1)[None, :] < left[:, None] - 1)
    ranks[line, at], merged[line, at] = rank(keys[line], place[line, at], symbols[line, at], symbols[line, at + 1])
    while n > 1 and len(rows):
        best = ranks.argmin(axis=1)
        line = np.arange(len(rows))
        go = ranks[line, best] != _NONE
        if not go.all():
            yield rows[~go], left[~go], symbols[~go]
            rows, left, symbols, place, ranks, merged, keys, best = (
                x[go] for x in (rows, left, symbols, place, ranks, merged, keys, best)
            )
            line = np.arange(len(rows))
            if not len(rows):
                return
        symbols[line, best] = merged[line, best]
        column = np.arange(n - 1)[None, :]
        keep = column + (column > best[:, None])
        symbols, place = np.take_along_axis(symbols, keep, 1), np.take_along_axis(place, keep, 1)
        column = np.arange(n - 2)[None, :]
        keep = column + (column >= best[:, None])
        ranks, merged = np.take_along_axis(ranks, keep, 1), np.take_along_axis(merged, keep, 1)
        n -= 1
        left -= 1
        for at in (best - 1, best):  # the two pairs that hold the new piece
            here = np.flatnonzero((at >= 0) & (at < left - 1))
            if len(here):
                a = at[here]
                r, m = rank(keys[here], place[here, a], symbols[here, a], symbols[here, a + 1])
                ranks[here, a], merged[here, a] = r, m
    if len(rows):
        yield rows, left, symbols


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``first[k] .. first[k] + counts[k] - 1`` for all k, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def _power(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def encode_rows(
    vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, share: float, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all rows of UTF-8 text and the number of pieces before each row; ``keys`` tell the rows apart."""
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begin = lead[offsets]
    full = np.flatnonzero(np.diff(begin) > 0)
    # A space before every text that is not empty.
    points = np.insert(points, begin[full], 0x20)
    added = np.zeros(len(begin), np.int64)
    added[1:] = np.cumsum(np.diff(begin) > 0)
    begin = begin + added
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)

    space = points == 0x20
    symbols = vocabulary.symbol[np.where(space, ord(SPACE), points)]
    symbols[points == ord(SPACE)] = -1
    unknown = symbols < 0
    start = unknown.copy()
    start[1:] |= unknown[:-1] | (space[1:] & ~space[:-1])
    start[begin[:-1][full]] = True
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, len(points)))
    row = np.searchsorted(begin, first, "right") - 1

    codes = np.where(unknown, points.astype(np.int64) + (1 << 32), symbols).astype(np.uint64) + np.uint64(1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _power(_FACTOR, len(codes))[:-1], dtype=np.uint64)))
    segment = mix((total[first + size] - total[first]) * _power(_INVERSE, len(codes))[first] + size.astype(np.uint64))
    nth = np.arange(len(first)) - np.searchsorted(first, begin)[row]
    occurrence = mix(mix(keys.astype(np.uint64))[row] + nth.astype(np.uint64))
    if not share:
        occurrence[:] = 0
    key = mix(segment ^ mix(occurrence + mix(np.full(1, seed).astype(np.uint64))))
    if share:  # keys repeat only where whole rows do
        different, back, at = key, slice(None), first
    else:
        different, where, back = np.unique(key, return_index=True, return_inverse=True)
        at, size = first[where], size[where]
    del key, codes, total, segment, occurrence
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    known = ~unknown[at]
    for low, high in zip((0, *WIDTHS), WIDTHS):
        here = np.flatnonzero((size > low) & (size <= high) & known)
        if not len(here):
            continue
        last = len(symbols) - 1
        block = symbols[np.minimum(at[here][:, None] + np.arange(high)[None, :], last)]
        if high == 1:
            pieces.append((here, block))
        else:
            pieces += [(here[r], p) for r, p in _together(vocabulary, block, size[here], different[here], share)]
    for r in np.flatnonzero((size > WIDTHS[-1]) & known):
        line = symbols[at[r] : at[r] + size[r]].tolist()
        pieces.append((np.array([r]), np.array([heap_agenda(vocabulary, line, int(different[r]), share)])))
    odd = np.flatnonzero(unknown[at])
    for r in odd:
        raw = np.frombuffer(chr(points[at[r]]).encode("utf-8"), np.uint8)
        pieces.append((np.array([r]), vocabulary.byte[raw][None, :]))

    counts = np.zeros(len(different), np.int64)
    for r, p in pieces:
        counts[r] = p.shape[1]
    spot = np.cumsum(counts) - counts
    flat = np.empty(counts.sum(), np.int32)
    for r, p in pieces:
        flat[spot[r][:, None] + np.arange(p.shape[1])[None, :]] = p
    each = counts[back]
    ends = np.concatenate(([0], np.cumsum(each)))
    return flat[_ragged(spot[back], each)], ends[np.searchsorted(first, begin)]


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text that pieces were made from."""
    return b"".join(map(vocabulary.bytes.__getitem__, ids)).decode()[1:]


def decode_rows(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts and their offsets; ``ends`` are the offsets of the rows in ``ids``."""
    size = vocabulary.place[ids + 1] - vocabulary.place[ids]
    data = vocabulary.flat[_ragged(vocabulary.place[ids], size)]
    offsets = np.append(0, np.cumsum(size))[ends]
    full = np.flatnonzero(np.diff(offsets) > 0)
    drop = offsets[full]  # the space before every text that is not empty
    added = np.append(0, np.cumsum(np.diff(offsets) > 0))
    return np.delete(data, drop), offsets - added


def _read(spark, path: str) -> bytes:
    """The vocabulary file, through Spark's reader if its place is not local to the driver."""
    if "://" in path or path.startswith("file:"):
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def _texts(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Decoded rows as a string array, null where ``missing``."""
    data, offsets = decode_rows(vocabulary, ids, ends)
    whole = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return pc.if_else(pa.array(missing), None, whole).cast(pa.string())


def encode(
    df: DataFrame, model: str, text: str = "text", key: str = "doc_id", dropout: float = 0.1, seed: int = 0,
    out: str = "ids", back: str | None = None,
) -> DataFrame:
    """Add the pieces of each text as ``array<int>``; ``key`` tells the texts apart, a null key counts as one value.

    ``back`` names a column for the text that the pieces decode to, made by the same task. Columns named like the new ones
    are replaced, all others stay.
    """
    model_bytes = _read(df.sparkSession, model)
    new = [out] + ([back] if back else [])
    kept = [c for c in df.columns if c not in new]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.xxhash64(F.col(f"`{key}`")).alias("key"),
        F.col(f"`{text}`").alias("text"),
    )

    def run(batches):
        vocabulary = _vocabulary(model_bytes)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for a, b in slices(offsets, CHUNK_BYTES):
                at = offsets[a : b + 1]
                ids, ends = encode_rows(vocabulary, data[at[0] : at[-1]], at - at[0], keys[a:b], dropout, seed)
                missing = batch.column("text").slice(a, b - a).is_null().to_numpy(zero_copy_only=False)
                places = pa.array(ends.astype(np.int32), mask=np.append(missing, False))
                columns = [batch.column("row").slice(a, b - a), pa.ListArray.from_arrays(places, pa.array(ids, pa.int32()))]
                if back:
                    columns.append(_texts(vocabulary, ids, ends, missing))
                yield pa.record_batch(columns, names=["row", "ids", "back"][: len(columns)])

    kind = rows.schema["row"].dataType.simpleString()
    coded = rows.mapInArrow(run, f"row {kind}, ids array<int>" + (", back string" if back else ""))
    added = [F.col(n).alias(c) for n, c in zip(("ids", "back"), new)]
    return coded.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *added)


def decoded(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each array of pieces; null stays null."""
    model_bytes = _read(df.sparkSession, model)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        vocabulary, parts = _vocabulary(model_bytes), []
        places = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy()
        for a, b in slices(places, CHUNK_PIECES):
            at = places[a : b + 1]
            missing = column.slice(a, b - a).is_null().to_numpy(zero_copy_only=False)
            parts.append(_texts(vocabulary, values[at[0] : at[-1]], at - at[0], missing))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.select(*kept, texts(F.col(f"`{ids}`")).alias(out))
