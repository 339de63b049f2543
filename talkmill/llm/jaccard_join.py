"""Join of texts whose sets of word n-grams are alike, with Bayesian pruning of candidates.

1. Each text becomes its set of shingles. Equal sets form a class, which is counted before anything is compared.
2. Classes that share a band of MinHash values become neighbours of the smallest class of that band, so a
   bucket of any size costs one row per member. Components of these edges hold every candidate pair.
3. A component is compared in one task, or, if it is large, as pairs of bounded blocks. MinHash values are
   compared sixteen at a time; a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold (uniform prior) falls below the tolerance. The rest is verified exactly on the sets.
4. A task returns counts of links and a spanning forest, never the pairs, so a group of copies of any size
   gives a number of rows linear in its members.

What can be lost: bands are as long as keeps the chance that a pair at the threshold shares none below ``MISSED`` (at 0.8: 48
bands of 5 values, 5e-9), and pruning drops it with about the tolerance.

Words are runs without white space, in lower case. A text of one to four words has one shingle, all its words;
a text without words (null, empty, white space) is linked to nothing. Classes and shingles are 64-bit hashes.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.arrays import mix, slices, text_bytes, words
from talkmill.llm.components import components
from talkmill.session import checkpointed

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-7
HASHES = 240
MISSED = 1e-8  # chance that a pair at the threshold shares no band
STEP = 16  # MinHash values compared between two looks at the posterior
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 19
CHUNK_BYTES = 4 << 20
PAIRS = 1 << 17  # pairs compared at once

_FLIP = (mix(np.arange(1, HASHES + 1)) >> np.uint64(32)).astype(np.uint32)
_TIMES = ((mix(np.arange(1001, 1001 + HASHES)) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
_PLACE = mix(np.arange(2001, 2065)) | np.uint64(1)  # odd factors by place in a shingle or band


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, first, _, _ = words(data, offsets)
    spread = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        spread += hashes[k : k + len(spread)] * _PLACE[k % 64]
    spread = mix(spread)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(spread[a : b - size + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)[None] + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def set_hash(values: np.ndarray) -> int:
    total = mix(values).sum(dtype=np.uint64) ^ np.uint64(len(values))
    return int(mix(total[None]).view(np.int64)[0])


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MinHash values per set; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    ends = np.cumsum([len(s) for s in sets])
    begin = 0
    while begin < len(sets):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + (1 << 15), "right")))
        x = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        x ^= np.concatenate(sets[begin:end]).astype(np.uint32)
        first = np.concatenate(([0], ends[begin : end - 1] - before))
        for k in range(HASHES):
            out[begin:end, k] = np.minimum.reduceat((x ^ _FLIP[k]) * _TIMES[k], first)
        begin = end
    return out


def band_rows(threshold: float = THRESHOLD) -> int:
    """Values in a band: the more the fewer chance candidates, but few enough that pairs at the threshold meet."""
    fits = [r for r in range(1, 9) if (1 - threshold**r) ** (HASHES // r) <= MISSED]
    if not fits:
        raise ValueError(f"a threshold of {threshold} is too low for {HASHES} hashes")
    return max(fits)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    bands = HASHES // rows
    grouped = values[:, : bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
    keys = (grouped * _PLACE[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _PLACE[63]
    return mix(keys).view(np.int64)


def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... values compared: the fewest equal ones with which a pair stays.

    With a uniform prior, ``m`` equal of ``n`` give a Beta(m + 1, n - m + 1) posterior; its part above the
    threshold is the chance that a Binomial(n + 1, threshold) is at most ``m``.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _sketches(size: int):
    bands = HASHES // size

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, CHUNK_BYTES):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                full = [i for i, s in enumerate(sets) if len(s)]
                kept = [sets[i] for i in full]
                keys = band_keys(min_hashes(kept), size) if kept else np.zeros((0, bands), np.int64)
                places = pa.array(np.arange(0, keys.size + 1, bands), pa.int32())
                at = pa.array(full, pa.int64())
                yield pa.record_batch(
                    [
                        batch.column("id").slice(a, b - a).take(at),
                        batch.column("hash").slice(a, b - a).take(at),
                        pa.array([set_hash(s) for s in kept], pa.int64()),
                        pa.array([len(s) for s in kept], pa.int32()),
                        pa.ListArray.from_arrays(places, pa.array(keys.ravel())),
                    ],
                    names=["id", "hash", "class", "size", "bands"],
                )

    return run


def _links(sets: list[np.ndarray], pairs, need: list[int], at_least: Fraction):
    """Yield ``(i, j)`` arrays of the pairs that reach the threshold; ``pairs`` gives arrays of candidates."""
    values = min_hashes(sets)
    size = np.array([len(s) for s in sets])
    begin = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate(sets)
    _, local = np.unique(flat, return_inverse=True)
    flag = np.zeros(local.max() + 1, bool)
    for i, j in pairs:
        same = np.zeros(len(i), np.int32)
        for step, least in enumerate(need):
            part = slice(step * STEP, (step + 1) * STEP)
            same += (values[i, part] == values[j, part]).sum(axis=1, dtype=np.int32)
            stay = same >= least
            if not stay.all():
                i, j, same = i[stay], j[stay], same[stay]
        for left, right in _by_left(i, j):
            flag[local[begin[left] : begin[left + 1]]] = True
            n = size[right]
            ends = np.cumsum(n)
            places = np.arange(ends[-1]) + np.repeat(begin[right] - (ends - n), n)
            common = np.add.reduceat(flag[local[places]].astype(np.int64), ends - n)
            flag[local[begin[left] : begin[left + 1]]] = False
            union = size[left] + n - common
            found = right[common * at_least.denominator >= union * at_least.numerator]
            if len(found):
                yield np.full(len(found), left), found


def _by_left(i: np.ndarray, j: np.ndarray):
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    edges = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else []
    for a, b in zip(edges, [*edges[1:], len(i)]):
        yield int(i[a]), j[a:b]


def _candidates(component: np.ndarray, side: np.ndarray):
    """Index pairs within a component: all of them, or, with two sides, those across; bounded arrays."""
    order = np.argsort(component, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], component[order][1:] != component[order][:-1])))
    held, n = [], 0
    for a, b in zip(edges, [*edges[1:], len(order)]):
        rows = order[a:b]
        for k, row in enumerate(rows):
            others = rows[k + 1 :] if side[row] < 0 else rows[side[rows] == 1] if side[row] == 0 else rows[:0]
            if len(others):
                held.append((np.full(len(others), row), others))
                n += len(others)
            if n > PAIRS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _compare(need: list[int], at_least: Fraction):
    def run(table: pa.Table) -> pa.Table:
        """Counts of links per class, and for each class the smallest one it hangs together with here."""
        data, offsets = text_bytes(table.column("text"))
        sets, expected = [], table.column("class").to_numpy()
        for a, b in slices(offsets, CHUNK_BYTES):
            sets += shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        # An id may be repeated: keep one row per class, with the text that the class has.
        first = {}
        for i, s in enumerate(sets):
            if len(s) and set_hash(s) == expected[i]:
                first.setdefault((int(expected[i])), i)
        rows = np.array(sorted(first.values()), np.int64)
        if len(rows) < 2:
            return _FOUND.empty_table()
        classes, copies = expected[rows], table.column("copies").to_numpy()[rows]
        side, component = table.column("side").to_numpy()[rows], table.column("component").to_numpy()[rows]
        links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for i, j in _links([sets[k] for k in rows], _candidates(component, side), need, at_least):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            low = min(label[i[0]], label[j].min())
            hang = np.unique(np.concatenate((label[i[:1]], label[j])))
            label[np.isin(label, hang)] = low
        hit = links > 0
        return pa.table([classes[hit], classes[label[hit]], links[hit]], schema=_FOUND)

    return run


def near_texts(
    df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """``(id, class_id, copy_id, n_links)`` for every row of ``df``.

    ``copy_id`` is the smallest id among the texts with the same shingles, ``class_id`` the smallest id among all
    that hang together by links, ``n_links`` the number of other rows whose similarity is at least ``threshold``.
    A row without words has its own id and no links. Rows that repeat an id are rows of their own.
    """
    docs = df.select(F.col(id).alias("id"), F.lower(F.col(text)).alias("text")).withColumn("hash", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sketches = docs.mapInArrow(_sketches(band_rows(threshold)), f"id {kind}, hash long, class long, size int, bands array<long>")
    rows = checkpointed(sketches)
    # A row is known by its id and its text's hash, so rows without an id do not meet each other.
    classes = rows.groupBy("class").agg(
        F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.max("size").alias("size"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("shown"),
    )
    classes = checkpointed(classes)

    # Every copy has the same bands, so a bucket's rows are counted by class before they move.
    bands = rows.select("class", F.explode("bands").alias("key")).groupBy("key", "class").agg(F.lit(1).alias("one"))
    heads = bands.groupBy("key").agg(F.min("class").alias("head"), F.count("*").alias("n")).where("n > 1")
    edges = bands.join(heads, "key").where("class <> head").select(F.col("class").alias("u"), F.col("head").alias("v"))
    grouped = components(edges.distinct()).withColumnRenamed("id", "class")

    members = checkpointed(grouped.join(classes, "class"))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    sizes = sizes.select(
        "component",
        F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks"),
    )
    total = members.agg(F.sum("size")).first()[0] or 0
    packs = total // BLOCK_SHINGLES + 1
    placed = members.join(sizes, "component")
    whole = placed.where("blocks = 1").select(
        "class", "shown", "copies", "component",
        F.lit(-1).alias("side"),
        F.pmod(F.xxhash64("component"), F.lit(packs)).alias("x"), F.lit(-1).cast("long").alias("y"), F.lit(0).cast("long").alias("z"),
    )
    # A block meets itself and every other block of its component; the lower one is side 0.
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    cut = placed.where("blocks > 1").withColumn("own", own)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select(
        "class", "shown", "copies", "component",
        F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("component").alias("z"),
    )
    parts = whole.unionByName(cut)
    same = (F.col("shown.hash") == F.col("hash")) & F.col("shown.id").eqNullSafe(F.col("id"))
    with_text = parts.join(docs, same).drop("id", "hash", "shown")
    compare = _compare(needed_matches(threshold, tolerance), Fraction(threshold).limit_denominator(10_000))
    found = checkpointed(
        with_text.groupBy("x", "y", "z").applyInArrow(compare, "a long, b long, links long")
    )
    links = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "class")

    named = classes.join(links, "class", "left").join(linked, "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    named = named.join(lowest, "component").select(
        "class", "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    worded = rows.select("id", "class").join(named, "class").select("id", "class_id", "copy_id", "n_links")
    bare = docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("id")
    none = bare.select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(none)
