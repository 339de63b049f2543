"""Interpolated modified Kneser-Ney word model: counted in Spark, kept as sorted arrays, mapped by workers.

Words become 64-bit hashes, the sorted hashes of all training words give them numbers, and a pair of
words is ``number << 32 | number``. Tasks count pairs in numpy, send one packed row per shard, and each
shard is merged, sorted and written as an array file in the shared folder. Scoring tasks map these files
and search them; no table of the model passes through the driver or a broadcast.

A shard holds the pairs of a range of first words. First words that hold more than a quarter of a
shard's share are dealt out by the whole pair; their sums meet in a second, pre-aggregated shuffle.

The model is of order two: ``p(w | v) = max(c(vw) - D, 0) / c(v) + g(v) * q(w)`` with
``q`` the discounted share of different words before ``w``, interpolated with ``1 / (V + 1)``.

Null and empty texts count as one end token. Repeated rows count each time. Without training tokens
every probability is 1 / (V + 1) = 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.arrays import mix, slices, sums, text_bytes, words
from talkmill.llm.files import map_array, new_folder, write_array
from talkmill.session import checkpointed

END = np.uint64(0x0E0D)  # hash of the end token; word hashes are scrambled, so no word is near it
UNKNOWN = 0xFFFFFFFF
CHUNK_BYTES = 4 << 20  # text worked on at once
HELD_PAIRS = 1 << 22  # pairs a task keeps before it sends them

_CONTEXT = np.dtype([("id", "u4"), ("total", "u8"), ("n1", "u4"), ("n2", "u4"), ("n3", "u4")])
_BEFORE = np.dtype([("id", "u4"), ("n", "u4")])
_PACKED = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary())])
_PACKED_DDL = "shard int, kind string, a binary, b binary"


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row and an end after them; ``first`` as in ``words``."""
    hashes, first, _, _ = words(data, offsets)
    places = first + np.arange(len(first))
    out = np.full(places[-1], END)
    ends = np.zeros(places[-1], bool)
    ends[places[1:] - 1] = True
    out[~ends] = hashes
    return out, places


def _chunks(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in slices(offsets, CHUNK_BYTES):
            hashes, first = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield batch.slice(a, b - a), hashes, first


def _rows(shards: np.ndarray, kind: str, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    """One packed row per shard that occurs; the order within a shard stays."""
    order = np.argsort(shards, kind="stable")
    shards, a = shards[order], a[order]
    b = None if b is None else b[order]
    first = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(shards) else []
    edges = [*first, len(shards)]
    parts = list(zip(edges[:-1], edges[1:]))
    return pa.record_batch(
        [
            pa.array([int(shards[i]) for i, _ in parts], pa.int32()),
            pa.array([kind] * len(parts), pa.string()),
            pa.array([a[i:j].tobytes() for i, j in parts], pa.binary()),
            pa.array([b"" if b is None else b[i:j].tobytes() for i, j in parts], pa.binary()),
        ],
        schema=_PACKED,
    )


def _packed(table: pa.Table, kind: str, column: str, dtype) -> list[np.ndarray]:
    rows = zip(table.column("kind").to_pylist(), table.column(column))
    return [np.frombuffer(x.as_py(), dtype) for k, x in rows if k == kind]


def _discounts(n: list[float]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more from the numbers of items seen one to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0

    def of(k: int, low: float, high: float) -> float:
        return min(max(k - (k + 1) * y * high / low, 0.0), float(k)) if low else y * k

    return np.array([0.0, of(1, n1, n2), of(2, n2, n3), of(3, n3, n4)])


def _seen(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class KneserNey:
    """Places and small totals of a fitted model; tasks map the arrays when they first need them."""

    folder: str
    shards: int
    base: list[int]  # number of the first word of each shard of words, and their total
    tokens: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    pair_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_seen: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    pairs: int = 0

    @property
    def vocabulary(self) -> int:
        return self.base[-1]

    @property
    def width(self) -> int:
        return self.vocabulary // self.shards + 1  # word numbers per range; the last number is the begin

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_maps"}

    def _map(self, name: str, kind) -> np.ndarray:
        maps = self.__dict__.setdefault("_maps", {})
        if name not in maps:
            maps[name] = map_array(f"{self.folder}/{name}", kind)
        return maps[name]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of each word."""
        different, back = np.unique(hashes, return_inverse=True)
        ids = np.full(len(different), UNKNOWN, np.int64)
        counts = np.zeros(len(different), np.int64)
        shard = word_shard(different, self.shards)
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = cuts[s], cuts[s + 1]
            keys = self._map(f"words-{s}", np.uint64)
            if a == b or not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, different[a:b]), len(keys) - 1)
            hit = keys[at] == different[a:b]
            ids[a:b] = np.where(hit, at + self.base[s], UNKNOWN)
            counts[a:b] = np.where(hit, self._map(f"counts-{s}", np.int64)[at], 0)
        return ids[back], counts[back]

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        left = keys >> np.uint64(32)
        shard = (left // np.uint64(self.width)).astype(np.int64)
        hot = np.isin(left, self.hot.astype(np.uint64))
        return np.where(hot, (mix(keys) % np.uint64(self.shards)).astype(np.int64), shard)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of word pairs."""
        different, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(different), np.int64)
        shard = self.pair_shard(different)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            at = order[cuts[s] : cuts[s + 1]]
            known = self._map(f"pairs-{s}", np.uint64)
            if len(at) and len(known):
                found = np.minimum(np.searchsorted(known, different[at]), len(known) - 1)
                count = self._map(f"paircounts-{s}", np.uint32)[found]
                out[at] = np.where(known[found] == different[at], count, 0)
        return out[back]

    def _by_number(self, ids: np.ndarray, name: str, kind) -> np.ndarray:
        """Values of a per-word file for word numbers, 0 for unknown words."""
        different, back = np.unique(ids, return_inverse=True)
        out = np.zeros(len(different), kind)
        part = different // self.width
        cuts = np.searchsorted(part, np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                out[a:b] = self._map(f"{name}-{s}", kind)[different[a:b] - s * self.width]
        return out[back]

    def log10(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Base-10 logarithm of the model's probability of each token; ``first`` starts the rows."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first[:-1]] = self.vocabulary  # number of the begin
        known = ids != UNKNOWN
        ways = np.zeros(len(ids))
        ways[known] = self._by_number(ids[known], "ways", np.uint32)
        rest = float(self.word_discounts[1:] @ np.array(self.word_seen[1:4])) if self.pairs else 1.0
        total = self.pairs or 1
        kept = ways - self.word_discounts[np.minimum(ways, 3).astype(int)]
        low = np.maximum(kept, 0) / total + rest / total / (self.vocabulary + 1)

        p = low.copy()
        seen = np.flatnonzero(before != UNKNOWN)
        if self.pairs and len(seen):
            context = self._by_number(before[seen], "contexts", _CONTEXT)
            ready = context["total"] > 0  # the end never has a word after it
            seen, context = seen[ready], context[ready]
            d = self.pair_discounts
            left = d[1] * context["n1"] + d[2] * context["n2"] + d[3] * context["n3"]
            high = np.zeros(len(seen))
            pair = known[seen]
            keys = (before[seen[pair]].astype(np.uint64) << np.uint64(32)) | ids[seen[pair]].astype(np.uint64)
            count = self.pair_counts(keys)
            high[pair] = np.maximum(count - d[np.minimum(count, 3)], 0)
            p[seen] = (high + left * low[seen]) / context["total"]
        return np.log10(p)


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a word hash; shards are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _one_row(values: dict, schema: pa.Schema) -> pa.Table:
    return pa.table({k: [v] for k, v in values.items()}, schema=schema)


def fit(train: DataFrame, text: str = "text", shards: int | None = None) -> KneserNey:
    """Count all rows of ``train`` and write the model to the shared folder.

    ``shards`` is the number of files per table, ``spark.sql.shuffle.partitions`` by default.
    """
    spark = train.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = train.select(F.col(text).alias("text"))
    model = KneserNey(new_folder(spark, "kneser-ney"), n, [0])
    _count_words(docs, model)
    _count_pairs(docs, model)
    return model


def _count_words(docs: DataFrame, model: KneserNey) -> None:
    folder, n = model.folder, model.shards

    def count(batches):
        keys, counts, held = [], [], 0
        for _, hashes, _ in _chunks(batches):
            k, c = np.unique(hashes, return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.uint64))
            held += len(k)
            if held > HELD_PAIRS:
                k, c = _merge(keys, counts)
                yield _rows(word_shard(k, n), "word", k, c)
                keys, counts, held = [], [], 0
        if keys:
            k, c = _merge(keys, counts)
            yield _rows(word_shard(k, n), "word", k, c)

    schema = pa.schema([("shard", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64()), ("top", pa.binary())])

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merge(_packed(table, "word", "a", np.uint64), _packed(table, "word", "b", np.uint64))
        write_array(f"{folder}/words-{shard}", keys)
        write_array(f"{folder}/counts-{shard}", counts.astype(np.int64))
        # Candidates for hot words: at most 4 * n words of all can hold a 4 * n-th of the tokens.
        often = np.flatnonzero(counts * np.uint64(4 * n) >= counts.sum())
        top = np.stack([often.astype(np.int64), counts[often].astype(np.int64)])
        return _one_row(
            {"shard": shard, "words": len(keys), "tokens": int(counts.sum()), "top": top.tobytes()}, schema
        )

    packed = docs.mapInArrow(count, _PACKED_DDL)
    ddl = "shard int, words long, tokens long, top binary"
    done = {r.shard: r for r in packed.groupBy("shard").applyInArrow(merge, ddl).collect()}  # n rows
    for s in range(n):
        if s not in done:
            write_array(f"{folder}/words-{s}", np.zeros(0, np.uint64))
            write_array(f"{folder}/counts-{s}", np.zeros(0, np.int64))
    sizes = [done[s].words if s in done else 0 for s in range(n)]
    model.base = [0, *(int(x) for x in np.cumsum(sizes))]
    model.tokens = sum(r.tokens for r in done.values())
    hot = [model.vocabulary]  # the begin
    for s, r in done.items():
        places, counts = np.frombuffer(r.top, np.int64).reshape(2, -1)
        hot += [int(p) + model.base[s] for p, c in zip(places, counts) if c * 4 * n >= model.tokens]
    model.hot = np.array(sorted(hot), np.uint32)


def _count_pairs(docs: DataFrame, model: KneserNey) -> None:
    folder, n = model.folder, model.shards

    def count(batches):
        keys, counts, held = [], [], 0

        def send():
            k, c = _merge(keys, counts)
            return _rows(model.pair_shard(k), "pair", k, c.astype(np.uint32))

        for _, hashes, first in _chunks(batches):
            ids, _ = model.numbers(hashes)
            before = np.empty_like(ids)
            before[1:] = ids[:-1]
            before[first[:-1]] = model.vocabulary
            pair = (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
            k, c = np.unique(pair, return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.uint64))
            held += len(k)
            if held > HELD_PAIRS:
                yield send()
                keys, counts, held = [], [], 0
        if keys:
            yield send()

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merge(_packed(table, "pair", "a", np.uint64), _packed(table, "pair", "b", np.uint32))
        write_array(f"{folder}/pairs-{shard}", keys)
        write_array(f"{folder}/paircounts-{shard}", np.minimum(counts, UNKNOWN).astype(np.uint32))
        left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(UNKNOWN)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
        context = np.zeros(len(first), _CONTEXT)
        context["id"] = left[first]
        context["total"] = np.add.reduceat(counts, first)
        for name, hit in (("n1", counts == 1), ("n2", counts == 2), ("n3", counts > 2)):
            context[name] = np.add.reduceat(hit.astype(np.int64), first)
        ids, ways = np.unique(right, return_counts=True)
        before = np.zeros(len(ids), _BEFORE)
        before["id"], before["n"] = ids, ways
        seen = np.array([*_seen(counts), len(keys)], np.int64)
        return pa.Table.from_batches(
            [
                _rows(context["id"].astype(np.int64) // model.width, "context", context),
                _rows(before["id"].astype(np.int64) // model.width, "before", before),
                _rows(np.array([-1]), "seen", seen.reshape(1, -1)),
            ]
        )

    packed = docs.mapInArrow(count, _PACKED_DDL)
    # Written once: the sums below read it twice, and a lost executor must not count again.
    stats = checkpointed(packed.groupBy("shard").applyInArrow(merge, _PACKED_DDL))
    seen = [np.frombuffer(r.a, np.int64) for r in stats.where("kind = 'seen'").select("a").collect()]  # n rows
    seen = np.sum(seen, axis=0) if seen else np.zeros(5, np.int64)
    model.pair_discounts, model.pairs = _discounts(seen[:4]), int(seen[4])

    schema = pa.schema([("shard", pa.int32()), ("seen", pa.binary())])

    def spread(table: pa.Table) -> pa.Table:
        part = table.column("shard")[0].as_py()
        size = max(0, min(model.width, model.vocabulary + 1 - part * model.width))
        contexts, ways = np.zeros(size, _CONTEXT), np.zeros(size, np.uint32)
        for rows in _packed(table, "context", "a", _CONTEXT):
            at = rows["id"].astype(np.int64) - part * model.width
            for name in ("total", "n1", "n2", "n3"):
                contexts[name][at] += rows[name]
        for rows in _packed(table, "before", "a", _BEFORE):
            ways[rows["id"].astype(np.int64) - part * model.width] += rows["n"]
        write_array(f"{folder}/contexts-{part}", contexts)
        write_array(f"{folder}/ways-{part}", ways)
        counted = [*_seen(ways), int((ways > 2).sum())]
        return _one_row({"shard": part, "seen": np.array(counted, np.int64).tobytes()}, schema)

    parts = stats.where("kind <> 'seen'").groupBy("shard").applyInArrow(spread, "shard int, seen binary")
    done = {r.shard: np.frombuffer(r.seen, np.int64) for r in parts.collect()}  # n rows
    for s in set(range(n)) - set(done):
        size = max(0, min(model.width, model.vocabulary + 1 - s * model.width))
        write_array(f"{folder}/contexts-{s}", np.zeros(size, _CONTEXT))
        write_array(f"{folder}/ways-{s}", np.zeros(size, np.uint32))
    total = np.sum(list(done.values()), axis=0) if done else np.zeros(5, np.int64)
    model.word_discounts = _discounts(total[:4])
    model.word_seen = [0, int(total[0]), int(total[1]), int(total[4])]  # words with 1, 2, 3 or more words before


def score(
    df: DataFrame, model: KneserNey, text: str = "text", prefix: str = "lm_", keep: list[str] | None = None
) -> DataFrame:
    """Add the figures of each text to the columns ``keep``, all columns of ``df`` if it is not given.

    New columns, named with ``prefix``: ``n_tokens``, ``n_known`` (tokens seen in training), ``base`` (add-0.1
    unigram log10), ``log10`` (of the model) and ``perplexity``.
    """
    names = ["n_tokens", "n_known", "base", "log10", "perplexity"]
    keep = df.columns if keep is None else keep
    kept = [f"`{c}`" for c in keep]
    rows = df.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))

    def run(batches):
        for batch, hashes, first in _chunks(batches):
            ids, counts = model.numbers(hashes)
            size = np.diff(first)
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
            logs = sums(model.log10(ids, first), first)
            figures = [size, sums((counts > 0).astype(np.int64), first), sums(base, first), logs, 10 ** (-logs / size)]
            yield pa.record_batch([batch.column("row"), *map(pa.array, figures)], names=["row", *names])

    kind = rows.schema["row"].dataType.simpleString()
    ddl = f"row {kind}, n_tokens long, n_known long, base double, log10 double, perplexity double"
    out = rows.mapInArrow(run, ddl)
    clash = {prefix + c for c in names}
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep if c not in clash],
        *[F.col(c).alias(prefix + c) for c in names],
    )


def held_out(doc_id: str, parts: int) -> Column:
    """Whether crc32 of the id as text falls into the first of ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 0
