"""Linear SVMs of many folds, classes and strengths in one solver.

Rows are packed once into blocks of sparse arrays, which tasks write to files in the shared folder and map from there: none of them
lies in the memory of the JVM. A pass multiplies every block with the weights of all problems at once and
sums loss and gradients; so a fit takes as many Spark jobs as one problem needs, however many folds, classes and values of C
there are. Problems only share the passes: each has its own step, its own history and its own end, after which no pass counts it.

A problem's objective is that of a linear SVM with squared hinge loss, ``|w|^2 / 2 + C * sum(weight * max(0, 1 - y f)^2)``, the shift
being one more weight whose input is always 1. It is smooth and strictly convex, so the answer does not depend on the way to it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.sources.shared import new_folder, read_file, removed, write_file

BLOCK_CELLS = 1 << 16  # stored numbers of a block of rows
FILE_CELLS = 1 << 22  # stored numbers of a file of blocks, at least, but for the last one of a task
GRADIENT = 1 << 12  # weights whose sums are added by one task
HISTORY, TOLERANCE = 10, 1e-4


@dataclass(frozen=True)
class Problem:
    """One class against the others, on all rows but those of ``fold``."""

    label: int
    fold: int = 0
    c: float = 1.0


@dataclass
class Rows:
    """A block of sparse rows."""

    n: int
    row: np.ndarray
    place: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, places, values) -> "Rows":
        """From a list of places and one of values per row."""
        counts = np.fromiter(map(len, places), np.int64, len(places))
        row = np.repeat(np.arange(len(places), dtype=np.int32), counts)
        if not len(row):
            return cls(len(places), row, np.zeros(0, np.int32), np.zeros(0))
        return cls(len(places), row, np.concatenate(list(places)).astype(np.int32), np.concatenate(list(values)).astype(float))

    def times(self, lines: np.ndarray) -> np.ndarray:
        """Margins of all lines (weights and a last shift) for every row."""
        out = np.empty((self.n, len(lines)))
        # Numbers as numpy counts with them, made once for all lines.
        row, place = self.row.astype(np.intp), self.place.astype(np.intp)
        for p, line in enumerate(lines):
            out[:, p] = np.bincount(row, self.value * line.take(place), self.n) + line[-1]
        return out

    def back(self, slopes: np.ndarray, width: int) -> np.ndarray:
        """Gradient per line from the slopes of the loss by margin; the last number is that of the shift."""
        out = np.empty((slopes.shape[1], width + 1))
        row, place = self.row.astype(np.intp), self.place.astype(np.intp)
        for p, slope in enumerate(np.ascontiguousarray(slopes.T)):
            # Rows far enough on their side of the line add nothing.
            if 2 * np.count_nonzero(slope) < self.n:
                at = np.flatnonzero((slope != 0).take(row))
                out[p, :-1] = np.bincount(place.take(at), self.value.take(at) * slope.take(row.take(at)), width)
            else:
                out[p, :-1] = np.bincount(place, self.value * slope.take(row), width)
            out[p, -1] = slope.sum()
        return out


def flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers per row, places and values of an Arrow column of ML vectors, sparse or dense."""
    lists = column.field("values")
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    place = (np.arange(size.sum()) - np.repeat(first, size)).astype(np.int32)
    sparse = column.field("type").to_numpy(zero_copy_only=False) == 0
    place[np.repeat(sparse, size)] = column.field("indices").filter(pa.array(sparse)).flatten().to_numpy(zero_copy_only=False)
    return size, place, lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)


@dataclass
class Packed:
    """Files of blocks, how wide their rows are and the largest class number in them."""

    files: DataFrame
    folder: str
    width: int
    top: int | None

    def unpersist(self) -> None:
        removed(self.files.sparkSession, self.folder)


def blocks(df: DataFrame, features: str = "features", label: str = "label_idx", weight: str = "weight", fold: str | None = None):
    """Write ``df`` in blocks; returns them and the width of the vectors."""
    vector = F.unwrap_udt(features)
    rows = df.select(
        vector.alias("v"), F.col(label).cast("int").alias("label"), F.col(weight).cast("double").alias("weight"),
        (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
        F.coalesce(vector["size"], F.size(vector["values"])).alias("width"),
    )
    spark = df.sparkSession
    folder = new_folder(spark, "linear")

    def pack(batches):
        held, cells_held, width, top = [], 0, 0, -1

        def file():
            name = f"{folder}/{uuid.uuid4().hex}"
            write_file(name, pa.Table.from_batches(held))
            found = [(name, pa.string()), (cells_held, pa.int64()), (width, pa.int32()), (top, pa.int32())]
            return pa.record_batch([pa.array([x], kind) for x, kind in found], names=["name", "cells", "width", "top"])

        for batch in batches:
            column = batch.column("v")
            column = column if isinstance(column, pa.StructArray) else column.combine_chunks()
            size, place, value = flat(column)
            other = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "fold")]
            cells = np.append(0, np.cumsum(size))
            begin = 0
            while begin < len(size):
                end = max(begin + 1, int(np.searchsorted(cells, cells[begin] + BLOCK_CELLS, "right")) - 1)
                own = slice(cells[begin], cells[end])
                wide = batch.column("width")[begin].as_py() or 0
                arrays = [place[own], value[own], size[begin:end], *(o[begin:end] for o in other)]
                kinds = [np.uint16 if wide <= 1 << 16 else np.int32, np.float64, np.int32, np.int32, np.float64, np.int32]
                packed = [pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(arrays, kinds)]
                held.append(pa.record_batch([pa.array([wide], pa.int32()), *packed], names=["width", "place", "value", "size", "label", "weight", "fold"]))
                width, top = max(width, wide), max(top, int(np.nanmax(np.append(other[0][begin:end], -1))))
                cells_held += int(cells[end] - cells[begin])
                begin = end
                if cells_held >= FILE_CELLS:
                    yield file()
                    held, cells_held = [], 0
        if held:
            yield file()

    # A row per file of four million numbers, and one per task.
    found = rows.mapInArrow(pack, "name string, cells long, width int, top int").collect()
    # As many parts as cores, with about as many numbers each: each part of a pass hands on a gradient of every problem.
    parts = max(1, min(spark.sparkContext.defaultParallelism, len(found)))
    names = [r["name"] for r in sorted(found, key=lambda r: (-r["cells"], r["name"]))]
    dealt = [[names[i::parts]] for i in range(parts)]
    files = spark.createDataFrame(spark.sparkContext.parallelize(dealt, parts), "names array<string>")
    width = max((r["width"] for r in found), default=0)
    return Packed(files, folder, width, max((r["top"] for r in found), default=None)), width


def top_label(packed: Packed) -> int:
    """Largest class number of the blocks."""
    return packed.top


def unpacked(batch):
    """``(rows, label, weight, fold)`` of the blocks of the files of a batch."""
    for name in batch.column("names").flatten().to_pylist():
        table = read_file(name)
        for k in range(table.num_rows):
            get = lambda c, kind: np.frombuffer(table.column(c)[k].as_buffer(), kind)  # noqa: B023, E731
            size = get("size", np.int32)
            row = np.repeat(np.arange(len(size), dtype=np.int32), size)
            place = get("place", np.uint16 if table.column("width")[k].as_py() <= 1 << 16 else np.int32).astype(np.int32)
            yield Rows(len(size), row, place, get("value", np.float64)), get("label", np.int32), get("weight", np.float64), get("fold", np.int32)


def _pass(packed: Packed, width: int, lines: np.ndarray, problems: list[Problem]) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of every problem without the penalty, in one job."""
    label, fold, strength = (np.array([getattr(p, n) for p in problems]) for n in ("label", "fold", "c"))
    shared = packed.files.sparkSession.sparkContext.broadcast(lines)
    schema = "part int, sums binary"

    def run(batches):
        total = np.zeros((len(problems), width + 2))
        for batch in batches:
            for rows, own, weight, part in unpacked(batch):
                sign = np.where(own[:, None] == label[None, :], 1.0, -1.0)
                gap = np.maximum(0.0, 1.0 - sign * rows.times(shared.value))
                scale = weight[:, None] * strength[None, :] * ((part[:, None] != fold[None, :]) | (fold[None, :] == 0))
                total[:, :-1] += rows.back(-2.0 * scale * gap * sign, width)
                total[:, -1] += (scale * gap * gap).sum(axis=0)
        for n, begin in enumerate(range(0, width + 2, GRADIENT)):
            yield pa.record_batch([pa.array([n], pa.int32()), pa.array([total[:, begin : begin + GRADIENT].tobytes()])], names=["part", "sums"])

    def add(table):
        sums = sum(np.frombuffer(s.as_buffer()) for s in table.column("sums"))
        return pa.table({"part": table.column("part")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    # A row per range of weights reaches the driver, summed over the parts.
    found = packed.files.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).toArrow().sort_by("part")
    shared.destroy()
    out = [np.frombuffer(s.as_buffer()).reshape(len(problems), -1) for s in found.column("sums")]
    out = np.hstack(out) if out else np.zeros((len(problems), width + 2))
    return out[:, -1], out[:, :-1]


def solve(packed: Packed, width: int, problems: list[Problem], rounds: int = 100, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights and shift of every problem, by limited-memory BFGS steps taken side by side.

    A problem ends when its gradient has shrunk to ``tolerance`` of the first one. A step that does not lower the
    objective enough is halved, for that problem alone. ``rounds`` bounds the passes.
    """
    lines = np.zeros((len(problems), width + 1))

    def value(at, own):
        loss, slope = _pass(packed, width, at, own)
        return loss + (at * at).sum(axis=1) / 2, slope + at

    best, slope = value(lines, problems)
    start = np.linalg.norm(slope, axis=1)
    memory: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = np.minimum(1.0, 1.0 / np.maximum(start, 1e-300))
    way = -slope
    for _ in range(rounds):
        going = np.linalg.norm(slope, axis=1) > tolerance * np.maximum(start, 1e-300)
        if not going.any():
            break
        tried = np.where(going[:, None], lines + step[:, None] * way, lines)
        # A problem that has ended takes no part in a pass.
        live = np.flatnonzero(going)
        found, new = best.copy(), slope.copy()
        found[live], new[live] = value(tried[live], [problems[i] for i in live])
        fall = (slope * way).sum(axis=1)
        good = going & (found <= best + 1e-4 * step * fall + 1e-12 * np.abs(best))
        s = np.where(good[:, None], tried - lines, 0.0)
        y = np.where(good[:, None], new - slope, 0.0)
        sy = (s * y).sum(axis=1)
        memory = [*memory, (s, y, np.where(sy > 0, 1 / np.where(sy > 0, sy, 1.0), 0.0))][-HISTORY:]
        lines, best, slope = (np.where(good[:, None], a, b) for a, b in ((tried, lines), (found[:, None], best[:, None]), (new, slope)))
        best = best[:, 0]
        stuck = going & ~good & (step < 1e-10)
        start = np.where(stuck, np.inf, start)  # rounding allows no further step
        way = np.where(good[:, None], _direction(slope, memory), way)
        step = np.where(good, 1.0, step / 2)
    return lines


def _direction(slope: np.ndarray, memory: list) -> np.ndarray:
    """The two-loop recursion for all problems; steps that a problem did not take count nothing."""
    q, shares = slope.copy(), []
    for s, y, r in reversed(memory):
        a = r * (s * q).sum(axis=1)
        shares.append(a)
        q -= a[:, None] * y
    size = np.ones(len(slope))
    for s, y, r in memory:  # the latest that counts
        yy = (y * y).sum(axis=1)
        size = np.where(r > 0, 1 / (np.where(r > 0, r * yy, 1.0)), size)
    q *= size[:, None]
    for (s, y, r), a in zip(memory, reversed(shares)):
        b = r * (y * q).sum(axis=1)
        q += (a - b)[:, None] * s
    return -q


def held_margins(packed: Packed, problems: list[Problem], lines: np.ndarray, classes: int) -> DataFrame:
    """``(fold, label_idx, margins)`` of every row by the lines of the problems that left its fold out, in class order."""
    folds = sorted({p.fold for p in problems})
    own = {f: lines[[k for k, p in enumerate(problems) if p.fold == f]] for f in folds}

    def run(batches):
        for batch in batches:
            for rows, label, _, fold in unpacked(batch):
                out = np.zeros((rows.n, classes))
                for f in folds:
                    here = fold == f
                    if here.any():
                        found = rows.times(own[f])[here]
                        out[here] = found if found.shape[1] == classes else np.hstack([-found, found])
                ends = pa.array(np.arange(rows.n + 1, dtype=np.int32) * classes)
                lists = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
                yield pa.record_batch([pa.array(fold), pa.array(label.astype(float)), lists], names=["fold", "label_idx", "margins"])

    return packed.files.mapInArrow(run, "fold int, label_idx double, margins array<double>")
