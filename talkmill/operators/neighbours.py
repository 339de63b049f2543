"""Exact nearest neighbours by cosine similarity, and the vote among them.

Training rows are dealt by id range and written once, in blocks, each an inverted index: for every term the rows that hold it, and the
largest and smallest weight in the block. Tasks over the query rows stream the blocks past a fixed block of queries. The weights bound
every similarity from above, so a block is opened only for queries whose bound reaches the ``k``-th best found so far, the most
promising blocks first. Terms that many queries and many rows of a block hold are multiplied as dense matrices, the others through their
postings. That is done in single precision, whose error is bounded; only pairs that can be among the ``k`` best by that bound are summed
in double precision. Training rows and queries are shuffled once each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions.columns import bind
from talkmill.session import checkpointed
from talkmill.sources.shared import new_folder, read_file, write_file

BLOCK_ROWS = 4096  # training rows of a block, fewer where they hold more than BLOCK_CELLS numbers
BLOCK_CELLS = 1 << 20
QUERY_ROWS = 1024  # query rows that a task holds at once
EXPANDED = 1 << 18  # products of a query number and a posting that are formed at once
DENSE = 800  # a product through postings costs about as much as so many of a dense matrix
DENSE_CELLS = 1 << 21  # numbers of a dense matrix of training rows
FEW = 16  # of so many pairs one is summed anew; if it is more, all products are formed in double precision
PARTS = 4  # parts of the queries for each core
DIGITS = 9  # similarities are compared to this many decimals, ties go to the smaller id


def sparse(vector: str, out: str = "vec"):
    """Array of numbers as ``struct<indices, values>`` without zeros."""
    v = F.col(vector)
    places = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i) != 0)
    values = F.transform(places, lambda i: F.get(v, i).cast("double"))
    return F.struct(places.alias("indices"), values.alias("values")).alias(out)


def unit(vec: str = "vec"):
    """Vector scaled to length 1; a zero vector stays."""
    values = F.col(f"{vec}.values")
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    # Bound, so that the length is summed once a row and not once a number.
    scaled = bind(norm, lambda n: F.transform(values, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return F.struct(F.col(f"{vec}.indices").alias("indices"), scaled.alias("values")).alias(vec)


@dataclass
class Sparse:
    """Rows of a block: their numbers, and where the numbers of each row begin."""

    first: np.ndarray
    place: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, column) -> "Sparse":
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lists, values = column.field("indices"), column.field("values")
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (lists, values)]
        return cls(np.append(0, np.cumsum(size, dtype=np.int64)), flat[0].astype(np.int64), flat[1].astype(float))

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def take(self, at: np.ndarray) -> "Sparse":
        size = np.diff(self.first)[at]
        cells = _ranges(self.first[:-1][at], size)
        return Sparse(np.append(0, np.cumsum(size)), self.place[cells], self.value[cells])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of all ranges that begin at ``first``, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _spans(first: np.ndarray, rows: int, cells: int):
    """Ranges of at most ``rows`` rows and about ``cells`` numbers, at least one row each."""
    begin, n = 0, len(first) - 1
    while begin < n:
        end = min(begin + rows, int(np.searchsorted(first, first[begin] + cells, "right")) - 1, n)
        end = max(end, begin + 1)
        yield begin, end
        begin = end


def _index(rows: Sparse) -> tuple[pa.Table, pa.Table]:
    """Postings of a block in the order of terms, and the extreme weights of each term."""
    order = np.argsort(rows.place, kind="stable")
    place, value, row = rows.place[order], rows.value[order], rows.rows[order]
    terms, starts = np.unique(place, return_index=True)
    most = np.maximum.reduceat(value, starts) if len(starts) else value
    least = np.minimum.reduceat(value, starts) if len(starts) else value
    tops = pa.table({"term": terms, "start": starts, "most": np.maximum(most, 0), "least": np.minimum(least, 0)})
    return tops, pa.table({"row": row.astype(np.int32), "value": value})


def _by_row(rows: Sparse) -> pa.Table:
    """Where the postings of ``_index`` have the numbers of the rows, one row after another."""
    order = np.argsort(rows.place, kind="stable")
    spot = np.empty(len(order), np.int32)
    spot[order] = np.arange(len(order), dtype=np.int32)
    return pa.table({"spot": spot})


def write_blocks(train: DataFrame, block_rows: int = BLOCK_ROWS) -> list[tuple[int, str]]:
    """Write ``(id, label, vec)`` in blocks by id; returns rows before each block and its name, one entry per block."""
    folder = new_folder(train.sparkSession, "neighbours")
    # Written once: the ranges of ids are found by one pass and dealt out by another.
    kept = checkpointed(train.select(F.col("id").alias("near_id"), "label", unit().alias("vec")))
    dealt = kept.repartitionByRange("near_id").sortWithinPartitions("near_id")

    def write(batches):
        held, part = [], _task()
        cells = count = number = 0

        def block(batch):
            rows = Sparse.of(batch.column("vec"))
            name = f"{folder}/{part:06d}-{number:06d}"
            tops, postings = _index(rows)
            write_file(f"{name}-tops", tops)
            write_file(f"{name}-postings", postings)
            write_file(f"{name}-cells", _by_row(rows))
            write_file(f"{name}-rows", batch.select(["near_id", "label"]).append_column("end", pa.array(rows.first[1:])))
            return pa.record_batch([[part], [number], [batch.num_rows], [name]], names=["part", "number", "n", "name"])

        for batch in batches:
            size = Sparse.of(batch.column("vec")).first
            for a, b in _spans(size, block_rows, BLOCK_CELLS):
                if held and (count + b - a > block_rows or cells + size[b] - size[a] > BLOCK_CELLS):
                    yield block(pa.Table.from_batches(held))
                    held, cells, count, number = [], 0, 0, number + 1
                held.append(batch.slice(a, b - a))
                cells, count = cells + size[b] - size[a], count + b - a
        if held:
            yield block(pa.Table.from_batches(held))

    found = dealt.mapInArrow(write, "part long, number long, n long, name string").orderBy("part", "number").collect()
    before, out = 0, []
    for r in found:
        out.append((before, r["name"]))
        before += r["n"]
    return out


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


class _Best:
    """The best ``k`` rows so far of every query: similarity, place in the order of ids, id and label."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.sims = np.full((n, k), -np.inf)
        self.places = np.full((n, k), np.iinfo(np.int64).max)
        self.ids, self.labels = np.empty((n, k), object), np.empty((n, k), object)

    def open(self, bounds: np.ndarray, before: int) -> np.ndarray:
        """Queries for which a block of this bound, that begins at this place, may hold a better row."""
        return np.flatnonzero((bounds > self.sims[:, -1]) | ((bounds == self.sims[:, -1]) & (before < self.places[:, -1])))

    def meet(self, at: np.ndarray, sims: np.ndarray, before: int, rows: pa.Table) -> None:
        """Take the rows of a block into account for the queries ``at``."""
        # All that may round to the k-th best so far, or, where these are many, the k best of the block, the first in the order of ids.
        near = sims >= np.maximum(self.sims[at, -1:] - 10.0**-DIGITS, -1e300)
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * self.k + 16)
        if len(many):
            part = np.round(sims[many], DIGITS)
            last = -np.partition(-part, self.k - 1, axis=1)[:, self.k - 1, None]
            same = part == last
            near[many] &= (part > last) | (same & (np.cumsum(same, axis=1) <= self.k))
        line, spot = np.nonzero(near)
        self.add(at, line, spot, sims[line, spot], before, rows)

    def add(self, at: np.ndarray, line: np.ndarray, spot: np.ndarray, sims: np.ndarray, before: int, rows: pa.Table) -> None:
        """Take pairs into account: the query ``at[line]`` and the row ``spot`` of the block, in the order of the queries."""
        if not len(line):
            return
        found = np.round(sims, DIGITS) + 0.0
        met = np.unique(line)
        line = np.append(np.repeat(met, self.k), line)
        sims = np.append(self.sims[at[met]], found)
        places = np.append(self.places[at[met]], spot + before)
        order = np.lexsort((places, -sims, line))
        first = np.searchsorted(line[order], met)
        order = order[first[:, None] + np.arange(self.k)]
        self.sims[at[met]], self.places[at[met]] = sims[order], places[order]
        for mine, column in ((self.ids, "near_id"), (self.labels, "label")):
            new = np.empty(len(spot), object)
            new[:] = rows.column(column).take(pa.array(spot)).to_pylist()
            mine[at[met]] = np.append(mine[at[met]], new)[order]


def _bounds(queries: Sparse, tops: pa.Table) -> np.ndarray:
    """No similarity of a query with a row of the block is above this."""
    terms, most, least = (tops.column(c).to_numpy() for c in ("term", "most", "least"))
    if not len(terms):
        return np.zeros(len(queries.first) - 1)
    at = np.minimum(np.searchsorted(terms, queries.place), len(terms) - 1)
    share = np.maximum(queries.value * most[at], queries.value * least[at]) * (terms[at] == queries.place)
    # A little above what rounding may add.
    return np.round(np.bincount(queries.rows, share, len(queries.first) - 1) + 1e-12, DIGITS)


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix product; a number that is not finite counts only where the other side has one."""
    good = np.isfinite(left), np.isfinite(right)
    if good[0].all() and good[1].all():
        return left @ right
    bad = [(~g).astype(float) for g in good]
    met = bad[0] @ (right != 0).astype(float) + (left != 0).astype(float) @ bad[1]
    return np.where(met > 0, np.nan, np.where(good[0], left, 0.0) @ np.where(good[1], right, 0.0))


def _similarities(queries: Sparse, tops: pa.Table, postings: pa.Table, rows: int, kind: type = float) -> np.ndarray:
    """Products of all queries with all rows of the block, through the postings of the queries' terms.

    In single precision all numbers must be finite.
    """
    count = len(queries.first) - 1
    out = np.zeros((count, rows), kind)
    share = 8 // out.itemsize
    terms, starts = (tops.column(c).to_numpy() for c in ("term", "start"))
    if not len(terms) or not len(queries.place):
        return out
    row, value = postings.column("row").to_numpy(), postings.column("value").to_numpy()
    sizes = np.diff(np.append(starts, len(row)))
    at = np.minimum(np.searchsorted(terms, queries.place), len(terms) - 1)
    known = np.flatnonzero(terms[at] == queries.place)
    at, own, weight = at[known], queries.rows[known], queries.value[known]
    # Terms of so many queries and rows that a dense product is cheaper.
    dense = np.bincount(at, minlength=len(terms)) * sizes * DENSE * share > count * rows
    column = np.cumsum(dense) - 1
    chosen, inside = np.flatnonzero(dense), dense[at]
    step = max(1, DENSE_CELLS * share // max(rows, 1))
    for begin in range(0, len(chosen), step):
        part = chosen[begin : begin + step]
        left, right = np.zeros((count, len(part)), kind), np.zeros((len(part), rows), kind)
        mine = np.flatnonzero(inside & (column[at] >= begin) & (column[at] < begin + step))
        np.add.at(left, (own[mine], column[at[mine]] - begin), weight[mine])
        for n, t in enumerate(part):
            cells = slice(starts[t], starts[t] + sizes[t])
            right[n] = np.bincount(row[cells], value[cells], rows)
        out += _product(left, right) if kind is float else left @ right
    at, own, weight = at[~inside], own[~inside], weight[~inside]
    size = sizes[at]
    ends = np.cumsum(size)
    begin = 0
    while begin < len(size):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + EXPANDED, "right")))
        n = size[begin:end]
        cells = _ranges(starts[at[begin:end]], n)
        spot = np.repeat(own[begin:end], n)
        low, high = own[begin], own[end - 1] + 1
        key = (spot - low) * rows + row[cells]
        product = np.bincount(key, np.repeat(weight[begin:end], n) * value[cells], (high - low) * rows)
        out[low:high] += product.reshape(high - low, rows)
        begin = end
    return out


def _pairs(queries: Sparse, tops: pa.Table, postings: pa.Table, name: str, ends: np.ndarray, floor: np.ndarray, k: int, skip) -> tuple | None:
    """``(line, row, similarity)`` of all pairs that can be among the ``k`` best of a query, if these are few, else ``None``.

    ``floor`` has the ``k``-th best of every query so far. The rough products are at most ``off`` from the exact ones: vectors have
    length 1, or, where their squares are too small to be summed well, less than 2.
    """
    rows, count = len(ends), len(queries.first) - 1
    value = postings.column("value").to_numpy()
    if not (np.isfinite(queries.value).all() and np.isfinite(value).all()):
        return None
    rough = _similarities(queries, tops, postings, rows, np.float32)
    off = (tops.num_rows + 16) * 2.0**-22 + 10.0**-DIGITS
    rough[skip] = -np.inf
    least = np.where(np.isfinite(floor), floor - off, np.finfo(np.float32).min)
    near = rough >= least[:, None].astype(np.float32)
    line, row = np.divmod(np.flatnonzero(near), rows)
    many = np.flatnonzero(np.bincount(line, minlength=count) > 4 * k + 16)
    if len(many) and rows > k:
        part = rough[many]
        last = -np.partition(-part, k - 1, axis=1)[:, k - 1, None]
        near[many] &= part >= last - np.float32(2 * off)
        line, row = np.divmod(np.flatnonzero(near), rows)
    if len(line) * FEW > count * rows + 64 * FEW * (k + 1):
        return None
    terms, starts = (tops.column(c).to_numpy() for c in ("term", "start"))
    sizes = np.diff(np.append(starts, len(value)))
    spot = read_file(f"{name}-cells").column("spot").to_numpy()
    own = np.repeat(np.arange(len(terms), dtype=np.int32), sizes)
    first = np.append(0, ends)
    sims = np.zeros(len(line))
    # Queries are spread out over the terms of the block, some at a time, and meet the numbers of their rows.
    batch = max(1, DENSE_CELLS // 2 // max(len(terms), 1))
    wide = np.zeros((min(batch, count), len(terms)))
    at = np.minimum(np.searchsorted(terms, queries.place), max(len(terms) - 1, 0))
    known = terms[at] == queries.place if len(terms) else np.zeros(len(at), bool)
    holder = queries.rows
    begin = 0
    while begin < len(line):
        low = line[begin]
        end = int(np.searchsorted(line, low + batch))
        mine = np.arange(queries.first[low], queries.first[min(low + batch, count)])
        mine = mine[known[mine]]
        held = holder[mine] - low, at[mine]
        np.add.at(wide, held, queries.value[mine])
        while begin < end:
            size = ends[row[begin:end]] - first[row[begin:end]]
            # No more than so many numbers at once.
            size = size[: max(1, int(np.searchsorted(np.cumsum(size), EXPANDED, "right")))]
            part = slice(begin, begin + len(size))
            cells = spot[_ranges(first[row[part]], size)]
            pair = np.repeat(np.arange(len(size)), size)
            sims[part] = np.bincount(pair, wide[(line[part] - low)[pair], own[cells]] * value[cells], len(size))
            begin += len(size)
        wide[held] = 0.0
    return line, row, sims


def nearest(query: DataFrame, train: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, skip_self: bool = False) -> DataFrame:
    """The ``k`` nearest training rows of each query row, exactly.

    ``query`` has ``(id, vec)``, ``train`` has ``(id, label, vec)``. Returns ``(id, near_id, label, similarity, rank)``. A zero vector
    is as near to all rows as to none: its neighbours are the smallest ids.
    """
    blocks = write_blocks(train, block_rows)
    types = dict(train.dtypes)
    schema = f"id {dict(query.dtypes)['id']}, near_id {types['id']}, label {types['label']}, similarity double, rank int"
    fields = pa.schema([("similarity", pa.float64()), ("rank", pa.int32())])

    def pack(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, QUERY_ROWS):
                part, sink = batch.slice(begin, QUERY_ROWS), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()])], names=["rows"])

    def search(batches):
        for batch in batches:
            for cell in batch.column("rows"):
                part = pa.ipc.open_stream(cell.as_buffer()).read_next_batch()
                queries, best = Sparse.of(part.column("vec")), _Best(part.num_rows, k)
                bounds = [_bounds(queries, read_file(f"{name}-tops")) for _, name in blocks]
                for b in sorted(range(len(blocks)), key=lambda b: -bounds[b].sum()):
                    before, name = blocks[b]
                    at = best.open(bounds[b], before)
                    if not len(at):
                        continue
                    rows, tops, postings = (read_file(f"{name}-{x}") for x in ("rows", "tops", "postings"))
                    own, skip = queries.take(at), (np.empty(0, int), np.empty(0, int))
                    if skip_self:
                        spot = pc.index_in(rows.column("near_id").combine_chunks(), part.column("id").take(pa.array(at)))
                        same = np.flatnonzero(spot.is_valid().to_numpy(zero_copy_only=False))
                        skip = spot.to_numpy(zero_copy_only=False)[same].astype(int), same
                    pairs = _pairs(own, tops, postings, name, rows.column("end").to_numpy(), best.sims[at, -1], k, skip)
                    if pairs:
                        best.add(at, *pairs, before, rows)
                        continue
                    found = _similarities(own, tops, postings, rows.num_rows)
                    found[skip] = -np.inf
                    best.meet(at, found, before, rows)
                line, rank = np.nonzero(np.isfinite(best.sims))
                kinds = [f.type for f in rows.schema] if blocks and len(line) else [pa.null(), pa.null()]
                yield pa.record_batch(
                    [
                        part.column("id").take(pa.array(line)),
                        pa.array(best.ids[line, rank].tolist(), kinds[0]),
                        pa.array(best.labels[line, rank].tolist(), kinds[1]),
                        pa.array(best.sims[line, rank], fields.field(0).type),
                        pa.array(rank + 1, fields.field(1).type),
                    ],
                    names=["id", "near_id", "label", "similarity", "rank"],
                )

    if not blocks:
        return query.sparkSession.createDataFrame([], schema)
    # Every query meets every block, so blocks of queries are dealt over all cores.
    packed = query.select("id", unit()).mapInArrow(pack, "rows binary")
    dealt = packed.repartition(PARTS * query.sparkSession.sparkContext.defaultParallelism)
    return checkpointed(dealt).mapInArrow(search, schema)


def vote_of_neighbours(near: DataFrame) -> DataFrame:
    """Most frequent label among the neighbours, the first in sort order among equals."""
    votes = near.groupBy("id", "label").agg(F.count("*").alias("votes"))
    order = F.struct((-F.col("votes")).alias("v"), F.col("label").alias("l"))
    return votes.groupBy("id").agg(
        F.min_by("label", order).alias("y_pred"),
        (F.max("votes") / F.sum("votes")).alias("confidence"),
    )
