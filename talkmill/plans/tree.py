"""A decision tree on sparse rows, level by level.

The splits are those of Spark's trees: thresholds of at most ``maxBins`` bins from a sample of rows, the best gain of all features and
thresholds, the first among equals, children of at least ``minInstancesPerNode`` rows. But a row is its stored numbers, not a bin for every
feature, and a level is one pass over the rows however many nodes it has: tasks count the stored numbers of every node by feature, bin and
class; what is not stored is the rest of the node. Rows are files of ``linear.blocks``; which node a row is in is written next to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.plans import linear
from talkmill.plans.saved import Saved
from talkmill.sources.shared import read_file, write_file

SAMPLE = 10_000  # rows from which thresholds are found, as many as Spark takes
COUNTED = 1 << 22  # stored numbers that are counted together
EPSILON = 2.0**-52


def impure(stats: np.ndarray, kind: str = "gini") -> np.ndarray:
    """Impurity of weights by class (the last axis); 0 without any."""
    total = stats.sum(axis=-1)
    share = stats / np.where(total > 0, total, 1.0)[..., None]
    if kind == "entropy":
        out = np.zeros(total.shape)
        for c in range(stats.shape[-1]):
            s = share[..., c]
            out -= np.where(s > 0, s * np.log2(np.where(s > 0, s, 1.0)), 0.0)
    else:
        out = np.ones(total.shape)
        for c in range(stats.shape[-1]):
            out -= share[..., c] * share[..., c]
    return np.where(total > 0, out, 0.0)


def thresholds(value: np.ndarray, weight: np.ndarray, count: int, total: float, bins: int) -> np.ndarray:
    """Thresholds of a feature from the weight of each different stored number, in ascending order; the rest of ``total`` is zeros."""
    if not len(value):
        return np.empty(0)
    rest = total - weight.sum()
    if rest > EPSILON * count * 100:
        value, weight = np.append(value, 0.0), np.append(weight, rest)
        order = np.argsort(value, kind="stable")
        value, weight = value[order], weight[order]
    middle = (value[:-1] + value[1:]) / 2.0
    if len(middle) <= bins - 1:
        return middle
    stride = total / bins
    out, seen, target = [], weight[0], stride
    for i in range(1, len(value)):
        before, seen = seen, seen + weight[i]
        if abs(before - target) < abs(seen - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


@dataclass
class Nodes:
    """Nodes of a tree by number: feature and threshold of the split, children (-1 for a leaf) and weight by class."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    stats: np.ndarray

    def step(self, node: np.ndarray, rows: linear.Rows) -> np.ndarray:
        """The child that each row goes to; a row at a leaf stays."""
        value = np.zeros(len(node))
        # The one number of each row that its node asks for.
        at = np.flatnonzero(self.feature[node].take(rows.row) == rows.place)
        value[rows.row[at]] = rows.value[at]
        inside = self.left[node] >= 0
        return np.where(inside, np.where(value <= self.threshold[node], self.left[node], self.right[node]), node)


def _numbered(first: np.ndarray, flat: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Bin of each number: how many thresholds of its feature are below it."""
    low, high = first[place], first[place + 1]
    begin = low.copy()
    while True:  # a binary search for all numbers at once
        open_ = low < high
        if not open_.any():
            return low - begin
        middle = (low + high) // 2
        below = open_ & (flat[np.minimum(middle, max(len(flat) - 1, 0))] < value)
        low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class SparseTree(Estimator):
    """``DecisionTreeClassifier`` with the settings of ``base``, for rows whose weight depends on the class alone."""

    def __init__(self, base):
        super().__init__()
        self.base = base

    def copy(self, extra=None):
        return SparseTree(self.base)

    def _fit(self, df: DataFrame):
        get = self.base.getOrDefault
        packed, width = linear.blocks(df, get("featuresCol"), get("labelCol"), get("weightCol"))
        try:
            found = _classes(packed)
            if any(low != high for _, low, high in found.values()):
                return self.base.fit(df)
            classes = packed.top + 1
            rows, weight = np.zeros(classes, np.int64), np.zeros(classes)
            for c, (n, low, _) in found.items():
                rows[c], weight[c] = n, low
            first, flat = _splits(packed, width, rows, weight, get("maxBins"), get("seed"))
            settings = {n: get(n) for n in ("maxDepth", "minInstancesPerNode", "minInfoGain", "minWeightFractionPerNode", "impurity")}
            return SparseTreeModel(_grown(packed, width, rows, weight, first, flat, **settings))
        finally:
            packed.unpersist()


def _classes(packed: linear.Packed) -> dict[int, tuple[int, float, float]]:
    """Rows, and smallest and largest weight, of every class."""

    def run(batches):
        for batch in batches:
            for _, label, weight, _ in linear.unpacked(batch):
                own, at = np.unique(label, return_inverse=True)
                low, high = np.full(len(own), np.inf), np.full(len(own), -np.inf)
                np.minimum.at(low, at, weight)
                np.maximum.at(high, at, weight)
                yield pa.record_batch([pa.array(x) for x in (own.astype(np.int32), np.bincount(at), low, high)], names=["c", "n", "low", "high"])

    cells = packed.files.mapInArrow(run, "c int, n long, low double, high double").groupBy("c")
    found = cells.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # one row per class
    return {r["c"]: (r["n"], r["low"], r["high"]) for r in found}


def _splits(packed: linear.Packed, width: int, rows: np.ndarray, weight: np.ndarray, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the thresholds of every feature begin, and the thresholds of all features one after another."""
    count = int(rows.sum())
    bins = min(most, count)
    wanted = max(most * most, SAMPLE)
    share = min(1.0, wanted / max(count, 1))

    def run(batches):
        for batch in batches:
            for n, (block, label, _, _) in enumerate(linear.unpacked(batch)):
                kept = np.ones(block.n, bool)
                if share < 1:
                    # By the block's own numbers, so that a repeated task draws the same rows.
                    kept = np.random.default_rng([seed & 0xFFFFFFFF, n, len(block.row), block.n]).random(block.n) < share
                at = np.flatnonzero(kept.take(block.row) & (block.value != 0))
                cells = pa.table({"place": block.place[at], "value": block.value[at], "w": weight[label[block.row[at]]], "n": np.ones(len(at), np.int64)})
                yield from cells.group_by(["place", "value"]).aggregate([("w", "sum"), ("n", "sum")]).to_batches()

    cells = packed.files.mapInArrow(run, "place int, value double, w double, n long").groupBy("place", "value")
    # The different numbers of the sampled rows.
    found = cells.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toArrow().sort_by([("place", "ascending"), ("value", "ascending")])
    place, value, w, n = (found.column(c).to_numpy() for c in ("place", "value", "w", "n"))
    total = share * float((rows * weight).sum())
    at = np.searchsorted(place, np.arange(width + 1))
    parts = [thresholds(value[a:b], w[a:b], int(n[a:b].sum()), total, bins) for a, b in zip(at, at[1:])]
    return np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64)), np.concatenate(parts) if parts else np.empty(0)


def _grown(packed, width, rows, weight, first, flat, maxDepth, minInstancesPerNode, minInfoGain, minWeightFractionPerNode, impurity) -> Nodes:
    classes, kind = len(rows), impurity
    least = minWeightFractionPerNode * float((rows * weight).sum())
    spark = packed.files.sparkSession
    tree = [[-1, 0.0, -1, -1]]
    counts = [rows]  # rows by class of every node
    active = [] if maxDepth == 0 else [0]
    size = int(np.diff(first).max(initial=0)) + 1  # bins of a feature, at most
    bucket = max(12, spark.sparkContext.defaultParallelism)
    for level in range(maxDepth):
        if not active:
            break
        place = np.full(len(tree), -1)
        place[active] = np.arange(len(active))
        nodes = Nodes(*(np.array(x) for x in zip(*tree)), np.zeros((0, 0)))
        totals = np.array([counts[a] for a in active])
        shared = spark.sparkContext.broadcast((nodes, place, totals, first, flat, weight))

        def count(batches, level=level, shared=shared):
            nodes, place, totals, first, flat, _ = shared.value
            for batch in batches:
                for name in batch.column("names").flatten().to_pylist():
                    held, held_cells, where = [], 0, []
                    old = read_file(f"{name}-nodes{level - 1}").column("node").to_numpy() if level else None
                    begin = 0
                    one = pa.record_batch([pa.array([[name]])], names=["names"])
                    for block, label, _, _ in linear.unpacked(one):
                        node = np.zeros(block.n, np.int64) if old is None else nodes.step(old[begin : begin + block.n].astype(np.int64), block)
                        begin += block.n
                        where.append(node)
                        own = place[node]
                        at = np.flatnonzero((own >= 0).take(block.row))
                        feature = block.place[at].astype(np.int64)
                        bins = _numbered(first, flat, feature, block.value[at])
                        key = ((own[block.row[at]] * width + feature) * size + bins) * classes + label[block.row[at]]
                        held.append(key)
                        held_cells += len(key)
                        if held_cells >= COUNTED:
                            yield _batch(held)
                            held, held_cells = [], 0
                    if held_cells:
                        yield _batch(held)
                    write_file(f"{name}-nodes{level}", pa.table({"node": np.concatenate(where).astype(np.int32)}))

        def _batch(held):
            keys, n = _sums(np.concatenate(held), np.ones(sum(map(len, held)), np.int64))
            slot = (keys // (size * classes)) % bucket
            return pa.record_batch([pa.array(slot.astype(np.int32)), pa.array(keys), pa.array(n)], names=["slot", "key", "n"])

        def best(batches, shared=shared):
            _, _, totals, first, flat, weight = shared.value
            keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
            held = []
            for batch in batches:
                held.append((batch.column("key").to_numpy(), batch.column("n").to_numpy()))
                if sum(len(k) for k, _ in held) > max(COUNTED, len(keys)):
                    keys, n = _sums(*(np.concatenate(x) for x in zip((keys, n), *held)))
                    held = []
            keys, n = _sums(*(np.concatenate(x) for x in zip((keys, n), *held)))
            own, at = np.unique(keys // (size * classes), return_index=True)
            at = np.append(at, len(keys))
            step = max(1, COUNTED // (4 * size * classes))
            out = []
            for a in range(0, len(own), step):
                b = min(a + step, len(own))
                part = slice(at[a], at[b])
                cells = np.zeros((b - a, size, classes), np.int64)
                group = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                rest = keys[part] % (size * classes)
                cells[group, rest // classes, rest % classes] = n[part]
                node, feature = np.divmod(own[a:b], width)
                # What is not stored is zero.
                zero = _numbered(first, flat, feature, np.zeros(len(feature)))
                cells[np.arange(b - a), zero] += totals[node] - cells.sum(axis=1)
                left = np.cumsum(cells, axis=1)[:, :-1]
                right = totals[node][:, None, :] - left
                mine, other = left * weight, right * weight
                whole = impure(totals[node] * weight, kind)[:, None]
                sums = mine.sum(axis=2), other.sum(axis=2)
                total = sums[0] + sums[1]
                gain = whole - sums[0] / total * impure(mine, kind) - sums[1] / total * impure(other, kind)
                fine = (np.arange(size - 1)[None, :] < (first[feature + 1] - first[feature])[:, None])
                fine &= (left.sum(axis=2) >= minInstancesPerNode) & (right.sum(axis=2) >= minInstancesPerNode)
                fine &= (sums[0] >= least) & (sums[1] >= least) & (gain >= minInfoGain) & (gain > 0)
                gain = np.where(fine, gain, -np.inf)
                if gain.shape[1]:
                    split = gain.argmax(axis=1)
                    out.append((node, gain[np.arange(b - a), split], feature, split, left[np.arange(b - a), split]))
            if out:
                node, gain, feature, split, left = (np.concatenate(x) for x in zip(*out))
                order = np.lexsort((feature, -gain, node))
                node, gain, feature, split, left = (x[order] for x in (node, gain, feature, split, left))
                at = np.flatnonzero(np.append(True, node[1:] != node[:-1]) & np.isfinite(gain))
                yield pa.record_batch(
                    [pa.array(node[at]), pa.array(gain[at]), pa.array(feature[at]), pa.array(split[at]), pa.array(left[at].tolist(), pa.list_(pa.int64()))],
                    names=["node", "gain", "feature", "split", "rows"],
                )

        counted = packed.files.mapInArrow(count, "slot int, key long, n long").repartition(bucket, "slot")
        found = counted.mapInArrow(best, "node long, gain double, feature long, split long, rows array<long>")
        chosen = {}
        for r in found.collect():  # a row per node and task
            if r["node"] not in chosen or (-r["gain"], r["feature"]) < (-chosen[r["node"]]["gain"], chosen[r["node"]]["feature"]):
                chosen[r["node"]] = r
        shared.destroy()
        following = []
        for n, r in sorted(chosen.items()):
            a = active[n]
            left = np.array(r["rows"])
            tree[a] = [r["feature"], float(flat[first[r["feature"]] + r["split"]]), len(tree), len(tree) + 1]
            for part in (left, counts[a] - left):
                if level + 1 < maxDepth and abs(impure(part * weight, kind)) >= EPSILON:
                    following.append(len(tree))
                tree.append([-1, 0.0, -1, -1])
                counts.append(part)
        active = following
    stats = np.array(counts) * weight
    # Two leaves that say the same are one; children have larger numbers than their parents.
    said = stats.argmax(axis=1)
    for node in reversed(tree):
        if node[2] >= 0 and tree[node[2]][2] < 0 and tree[node[3]][2] < 0 and said[node[2]] == said[node[3]]:
            node[:] = [-1, 0.0, -1, -1]
    return Nodes(*(np.array(x) for x in zip(*tree)), stats)


class SparseTreeModel(Model, Saved):
    """Adds ``probability``, the shares of the classes at the leaf of a row, and ``prediction``."""

    def __init__(self, nodes: Nodes):
        super().__init__()
        self.nodes = nodes

    def _state(self) -> dict:
        return {n: getattr(self.nodes, n).tolist() for n in ("feature", "threshold", "left", "right", "stats")}

    @classmethod
    def _rebuilt(cls, state, parts):
        return cls(Nodes(*(np.array(state[n]) for n in ("feature", "threshold", "left", "right", "stats"))))

    def copy(self, extra=None):
        return SparseTreeModel(self.nodes)

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.nodes)

        def leaves(vectors: pa.Array) -> pa.Array:
            nodes = shared.value
            size, place, value = linear.flat(vectors)
            rows = linear.Rows(len(size), np.repeat(np.arange(len(size)), size), place, value)
            node = np.zeros(len(size), np.int64)
            while (nodes.left[node] >= 0).any():
                node = nodes.step(node, rows)
            share = nodes.stats / nodes.stats.sum(axis=1, keepdims=True)
            ends = np.arange(len(node) + 1, dtype=np.int32) * share.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(share[node].ravel()))

        found = df.withColumn("probability", F.arrow_udf(leaves, "array<double>")(F.unwrap_udt("features")))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return found.withColumn("prediction", best.cast("double"))
