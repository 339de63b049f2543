"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... segments; each segment keeps its mean and deviation. Scaled by the root of the
segment's length, these statistics are a shorter vector, and the distance of two of them is never more than the distance of the vectors.
With both norms that gives the most a pair can score. Tasks compare a block of queries with blocks of candidates from
the coarsest statistics to the finest: what can no longer reach a query's k-th best score is dropped, and only the survivors
are scored exactly.

Queries and candidates are packed into blocks of bounded size by the hash of their id. Each block of queries meets
every block of candidates, in groups, and a group sends ``k`` rows per query.

Components are scaled and floored to integers. Vectors that are null or hold a null or non-finite component, and rows without an
id, take no part. Vectors are compared with those of the same length. Rows with the id of a query are its own;
a query row that is repeated counts once, other repeated rows count each. Ties go to the smaller id. A score beyond 64 bits
is given as the largest or smallest 64-bit number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 1024
QUERY_ROWS = 1024
BLOCK_ROWS = 8192
GROUP_BLOCKS = 8  # candidate blocks that one task compares with a block of queries
EXACT = 2.0**53
_BLOCK_DDL = "side string, dim int, block long, ids binary, vectors binary"
_FOUND_DDL = "query_id long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & whole


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    raw = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    whole = _scaled(raw)
    return np.where(np.isfinite(whole), whole / SCALE, raw)  # exact: the scale is a power of two


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles; infinite where the number is beyond them."""
    with np.errstate(over="ignore"):
        return np.floor(raw * SCALE)


def _whole(x: float) -> int:
    """The whole number of a component, of any size."""
    scaled = x * SCALE
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * SCALE


def _pack(table: pa.Table) -> pa.Table:
    side, dim, block = (table.column(c)[0].as_py() for c in ("side", "dim", "block"))
    ids, vectors = table.column("id").to_numpy(), _matrix(table.column("vector"), dim) + 0.0  # no negative zeros
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    if side == "query" and len(ids):
        lines = np.concatenate([ids[:, None], vectors.view(np.int64)], axis=1)
        _, first = np.unique(lines, axis=0, return_index=True)
        ids, vectors = ids[np.sort(first)], vectors[np.sort(first)]
    return pa.table(
        {"side": [side], "dim": pa.array([dim], pa.int32()), "block": [block], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]}
    )


def _levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine; the finest has about four components in a segment."""
    out, n = [], 1
    while n * 4 <= dim:
        out.append(n)
        n *= 2
    return out


def _statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that their distance bounds the vectors' distance."""
    edges = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(vectors, edges[:-1], axis=1) / size
    square = np.add.reduceat(vectors * vectors, edges[:-1], axis=1) / size
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.tile(size, 2))


def _products(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows, cut to 64 bits; pairs too large for doubles are multiplied as integers."""
    with np.errstate(all="ignore"):
        out = a @ b.T
        top = np.abs(a).max(axis=1, initial=0)[:, None] * np.abs(b).max(axis=1, initial=0)[None, :] * max(a.shape[1], 1)
        exact = top < EXACT  # false for infinite and undefined ones
        out = np.where(exact, out, 0).astype(np.int64)
    rows, columns = np.nonzero(~exact)
    left = {i: [_whole(x) for x in raw_a[i].tolist()] for i in np.unique(rows)}
    right = {j: [_whole(x) for x in raw_b[j].tolist()] for j in np.unique(columns)}
    low, high = -(1 << 63), (1 << 63) - 1
    for i, j in zip(rows, columns):
        out[i, j] = min(max(sum(x * y for x, y in zip(left[i], right[j])), low), high)
    return out


class _Best:
    """The ``k`` best scores of each query of a block so far."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, k: int):
        self.ids, self.raw, self.vectors, self.k = ids, raw, _scaled(raw), k
        with np.errstate(all="ignore"):
            self.norm = (self.vectors * self.vectors).sum(axis=1)
            self.levels = _levels(raw.shape[1])
            self.statistics = [_statistics(self.vectors, n) for n in self.levels]
        self.least = np.full(len(ids), -np.inf)  # the k-th best score
        self.query = np.zeros(0, np.int64)
        self.found = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)

    def meet(self, ids: np.ndarray, raw: np.ndarray) -> None:
        vectors = _scaled(raw)
        stay = np.arange(len(ids))
        alive = self.ids[:, None] != ids[None, :]
        if np.isfinite(self.least).any():
            with np.errstate(all="ignore"):
                norm = (vectors * vectors).sum(axis=1)
                # Rounding of the bounds; far above what double arithmetic loses.
                slack = 1e-9 * (self.norm[:, None] + norm[None, :]) + 1
                for n, own in zip(self.levels, self.statistics):
                    other = _statistics(vectors[stay], n)
                    distance = (own * own).sum(axis=1)[:, None] + (other * other).sum(axis=1)[None, :] - 2 * own @ other.T
                    most = (self.norm[:, None] + norm[stay][None, :] - distance) / 2 + slack[:, stay]
                    alive &= ~(most < self.least[:, None])  # an undefined bound drops nothing
                    some = alive.any(axis=0)
                    stay, alive = stay[some], alive[:, some]
        if not len(stay):
            return
        score = _products(self.vectors, vectors[stay], self.raw, raw[stay])
        keep = alive & (score >= self.least[:, None])
        q, c = np.nonzero(keep)
        self._add(q, ids[stay[c]], score[q, c])

    def _add(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        found = np.concatenate([self.found, found])
        score = np.concatenate([self.score, score])
        order = np.lexsort((found, -score.astype(np.float64), query))
        # Scores beyond 2^53 may be equal as floats; order those by their exact value.
        if len(score) and np.abs(score.astype(np.float64)).max() >= EXACT:
            order = np.array(sorted(range(len(score)), key=lambda i: (query[i], -int(score[i]), found[i])))
        query, found, score = query[order], found[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        self.query, self.found, self.score = query[top], found[top], score[top]
        last = rank[top] == self.k - 1
        least = self.score[last].astype(np.float64)
        # Beyond 2^53 a score may round up; the next double below keeps its equals.
        self.least[self.query[last]] = np.where(np.abs(least) >= EXACT, np.nextafter(least, -np.inf), least)

    def rows(self) -> pa.RecordBatch:
        return pa.record_batch(
            [self.ids[self.query], self.found, self.score], names=["query_id", "vec_id", "score"]
        )


def _search(k: int):
    def run(batches):
        """Rows of one group follow each other; each holds the queries and one block of candidates."""
        key, best = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, block, group = (batch.column(c)[row].as_py() for c in ("dim", "query_block", "group"))
                if (dim, block, group) != key:
                    if best is not None:
                        yield best.rows()
                    key = (dim, block, group)
                    best = _Best(*_unpacked(batch, row, "query_ids", "query_vectors", dim), k)
                best.meet(*_unpacked(batch, row, "ids", "vectors", dim))
        if best is not None:
            yield best.rows()

    return run


def _unpacked(batch: pa.RecordBatch, row: int, ids: str, vectors: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(batch.column(ids)[row].as_buffer(), np.int64)
    if not dim:
        return found, np.zeros((len(found), 0))
    return found, np.frombuffer(batch.column(vectors)[row].as_buffer(), np.float64).reshape(len(found), dim)


def top_k(df: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best rows for each row that satisfies ``queries``."""
    rows = df.select(
        F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks")
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("dim", F.size("vector"))
    sides = rows.select(
        "id", "vector", "dim",
        F.explode(F.when(F.col("asks"), F.array(F.lit("query"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("side"),
    )
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count("*") / BLOCK_ROWS).alias("all_blocks"),
        F.ceil(F.count_if("asks") / QUERY_ROWS).alias("query_blocks"),
    ).where("query_blocks > 0")
    sides = sides.join(sizes, "dim").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.when(F.col("side") == "query", F.col("query_blocks")).otherwise(F.col("all_blocks")))
    )
    packed = sides.select("side", "dim", "block", "id", "vector").groupBy("side", "dim", "block").applyInArrow(_pack, _BLOCK_DDL)
    asked = packed.where("side = 'query'").select(
        "dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")
    )
    given = packed.where("side = 'all'").join(sizes, "dim").select(
        "dim", "block", "ids", "vectors",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("query_block"),
    )
    met = given.join(asked, ["dim", "query_block"]).withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, "dim", "query_block", "group").sortWithinPartitions("dim", "query_block", "group", "block")
    found = met.select("dim", "query_block", "group", "query_ids", "query_vectors", "ids", "vectors").mapInArrow(
        _search(k), _FOUND_DDL
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
