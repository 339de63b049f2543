"""Words of a whole Arrow column as numpy arrays: hashes and byte spans, without a Python step per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 16  # bytes hashed at once; bounds the temporary arrays whatever the texts

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_FACTOR = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # several chunks, or none
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    _, places, values = column.buffers()
    if places is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _block_powers(base: int) -> np.ndarray:
    out = np.full(2 * BLOCK_BYTES, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    ready = _block_powers(base)
    if n <= len(ready):
        return ready[:n]
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _blocks(space: np.ndarray, size: int):
    """Ends of blocks of about ``size`` bytes; a block never ends inside a word."""
    begin, n = 0, len(space)
    while begin < n:
        end = min(n, begin + size)
        while end < n:
            gap = np.flatnonzero(space[end : end + size])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + size)
        yield begin, end
        begin = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, first, start, end)`` of the words of all rows.

    A word is a run of bytes other than ASCII white space; A-Z count as a-z. ``first`` has for each
    row the number of its first word, and the total at the end. ``start`` and ``end`` are places in ``data``.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends, hashes = [], [], []
    # Rows end words too, so blocks may end at them; one block holds a longer word whole.
    stop = _SPACE[data] | edge[:-1]
    for a, b in _blocks(stop, BLOCK_BYTES):
        space = _SPACE[data[a:b]]
        word = ~space
        before = np.concatenate(([True], space[:-1])) | edge[a:b]
        after = np.concatenate((space[1:], [True])) | edge[a + 1 : b + 1]
        s, e = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        up, down = _powers(_FACTOR, b - a), _powers(_INVERSE, b - a)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[data[a:b]] * up, dtype=np.uint64)))
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + a)
        ends.append(e + a)
    if not starts:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), empty, empty
    start, end = np.concatenate(starts), np.concatenate(ends)
    return np.concatenate(hashes), np.searchsorted(start, offsets), start, end


def slices(offsets: np.ndarray, size: int):
    """Row ranges of about ``size`` bytes each, at least one row."""
    n, begin = len(offsets) - 1, 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per row, rows given by ``first``; an empty row gives 0."""
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out
