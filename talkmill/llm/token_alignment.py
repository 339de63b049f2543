"""Alignment of two tokenizations of every text by merge-path partitioning of their token ends.

A is a byte-level vocabulary in the format of the ``tokenizers`` library, B a SentencePiece model. Both see the text with
one space before it, so the tokens of each cut the same bytes, and the ends of A and B are two sorted lists.

- **Diagonals.** The merge of both lists is a path of ``len(A) + len(B)`` steps; at equal ends A steps first. A binary search on
  every ``STEPS``-th diagonal finds how many ends of A and of B the path has taken there. So the merge falls into pieces of
  equal work, however long the text, that need nothing of each other but the ends just before them.
- **Pieces.** Every different end closes one overlap of an A token with a B token (a *link*). A piece emits the links whose
  end it holds, and the places where both end together.
- **Stitching.** Those places, one piece after the other, cut the tokens of a document into groups; a group that crosses a
  border of pieces lies between the last place of one and the first of a later one.

Links are counted per pair of ids over the whole corpus. Tasks count their own chunks first, Spark adds the counts up, and
the totals are written as sorted arrays, in shards, which the tasks of the second pass map into memory; shards hold ranges
of pairs, so a chunk opens those only that hold its pairs. The second pass reads the written ids, no text is encoded twice.

Texts that are null or empty, and texts whose joined tokens are not the space and the text (a vocabulary that
normalises, a ``▁`` in the text), have no tokens: counts 0 and an empty digest. Repeated rows and ids are rows of their own. Special
tokens' strings are plain text. The files' places are parameters.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkmill.llm.arrays import slices, text_bytes
from talkmill.llm.files import map_array, new_folder, write_array

CHUNK_BYTES = 1 << 20  # text encoded at once; a longer text is a chunk of its own
STEPS = 1 << 17  # merge steps of a piece
SHARD_PAIRS = 1 << 21  # different pairs of ids in a shard of the totals
SPACE = "▁"

# Fixed pattern of byte-level pre-tokenization, as the vocabulary file's "ByteLevel" step defines it.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Bytes:
    """The bytes of every id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def __len__(self):
        return len(self.size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place[ids] - (ends - size), size)]


class ByteLevel:
    """A byte-level vocabulary.

    Plain byte-level BPE runs in ``tiktoken``, three times as fast: the same pattern cuts the words, and the rank of a merge is the
    order of its id. Files of any other make run in ``tokenizers``.
    """

    def __init__(self, file: bytes):
        spec = json.loads(file)
        self._slow = Tokenizer.from_str(file.decode())
        self._slow.encode_special_tokens = True
        byte, model = _byte_of(), spec["model"]
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = model["vocab"]
        entries = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for name, i in vocabulary.items():
            entries[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        self.bytes = _Bytes(entries)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [vocabulary.get(a + b, -1) for a, b in merges]
        plain = (spec.get("pre_tokenizer") or {}) | {"trim_offsets": None}
        plain = plain == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": None, "use_regex": True}
        odd = spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback")
        ranked = made == sorted(set(made)) and made[:1] > [-1]
        ranks = {entries[i]: i for n, i in vocabulary.items() if i not in special}
        whole = len(ranks) == len(merges) + 256 and all(bytes([b]) in ranks for b in range(256))
        self._fast = None
        if plain and not odd and model["type"] == "BPE" and ranked and whole:
            self._fast = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list:
        """Ids of the space and the text, for every text."""
        if self._fast:
            return [self._fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        found = self._slow.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [np.array(f.ids, np.int64) for f in found]


class Pieces:
    """A SentencePiece model; it puts the space before a text itself."""

    def __init__(self, model: bytes):
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self._sp.get_piece_size()
        names = [self._sp.id_to_piece(i) for i in range(n)]
        self.bytes = _Bytes(
            [bytes([int(x[3:5], 16)]) if self._sp.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        )

    def encode(self, texts: list[str]) -> list:
        return self._sp.encode(texts, num_threads=1)


@lru_cache(2)
def _tokenizers(a: bytes, b: bytes) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


def diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` the merge has taken after every ``steps`` steps, and at its end.

    Binary search on all diagonals at once; at equal values ``a`` is taken first.
    """
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, steps), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        first = a[mid] <= b[d[open_] - 1 - mid]
        low[open_] = np.where(first, mid + 1, low[open_])
        high[open_] = np.where(first, high[open_], mid)
    return low, d - low


def piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """``(link_a, link_b, cut_a, cut_b)`` of the merge steps from ``(i0, j0)`` to ``(i1, j1)``.

    ``a`` and ``b`` are all ends of the chunk. A link is the number of an A and of a B token; a cut is how many tokens of
    A and of B lie before a place where both end.
    """
    x, y = a[i0:i1], b[j0:j1]
    start = max(a[i0 - 1] if i0 else 0, b[j0 - 1] if j0 else 0)
    n = len(x) + len(y)
    from_a = np.zeros(n, bool)
    from_a[np.arange(len(x)) + np.searchsorted(y, x, "left")] = True
    ends = np.empty(n, a.dtype)
    ends[from_a], ends[~from_a] = x, y
    taken_a = np.cumsum(from_a) - from_a  # steps of A before this one
    taken_b = np.arange(n) - taken_a
    fresh = np.empty(n, bool)
    if n:
        fresh[0] = ends[0] > start
        np.greater(ends[1:], ends[:-1], out=fresh[1:])
    before = i0 + taken_a
    same = ~from_a & (before > 0)
    same[same] = a[before[same] - 1] == ends[same]
    return before[fresh], j0 + taken_b[fresh], before[same], j0 + taken_b[same] + 1


def pieces(a: np.ndarray, b: np.ndarray, steps: int = STEPS):
    """``piece`` of every equal share of the merge, in order."""
    i, j = diagonals(a, b, steps)
    for k in range(len(i) - 1):
        yield piece(a, b, i[k], i[k + 1], j[k], j[k + 1])


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return ids, counts


def _kept(ids: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(rows, counts)], np.where(rows, counts, 0)


def _whole(names: _Bytes, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows whose tokens, joined, are the bytes of the row; ``size`` has the bytes of each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    good = np.bincount(row, names.size[ids], len(counts)).astype(np.int64) == size
    wrong = np.flatnonzero(names.joined(ids[good[row]]) != data[np.repeat(good, size)])
    ends = np.cumsum(size[good])
    good[np.flatnonzero(good)[np.searchsorted(ends, wrong, "right")]] = False
    return good


def encode_chunk(a: ByteLevel, b: Pieces, texts: list[str | None]):
    """``(a ids, tokens per row, b ids, tokens per row)``; rows without an alignment have none."""
    texts = [t or "" for t in texts]
    full = np.array([t != "" for t in texts], bool)
    some = [t for t in texts if t]
    data, offsets = text_bytes(pa.array([" " + t for t in some], pa.large_string()))
    size = np.diff(offsets)
    sides = [_flat(side.encode(some)) for side in (a, b)]
    good = np.ones(len(some), bool)
    for side, (ids, counts) in zip((a, b), sides):
        good &= _whole(side.bytes, ids, counts, data, size)
    out = []
    for ids, counts in sides:
        ids, counts = _kept(ids, counts, good)
        all_counts = np.zeros(len(texts), np.int64)
        all_counts[full] = counts
        out += [ids, all_counts]
    return tuple(out)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, width: int):
    """Different linked pairs of ids, as ``a * width + b`` in order, and their links."""
    found = []
    for link_a, link_b, _, _ in pieces(ends_a, ends_b):
        found.append(np.unique(a[link_a].astype(np.int64) * width + b[link_b], return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else _added(*(np.concatenate(x) for x in zip(*found)))


@lru_cache(4)
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every number below ``n``, left-aligned with a free place behind, and how many."""
    size = np.array([len(str(k)) for k in range(n)])
    width = int(size.max()) + 1
    table = np.zeros((n, width), np.uint8)
    for k in range(n):
        table[k, : size[k]] = np.frombuffer(str(k).encode(), np.uint8)
    return table, size


def written(
    a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, n: int
) -> list[bytes]:
    """Groups of every row as ``a1,a2|b1;a3|b2,b3``; ids are below ``n``, ``first_a`` and ``first_b`` start the rows."""
    group_a = np.searchsorted(cut_a, np.arange(len(a)), "right")
    group_b = np.searchsorted(cut_b, np.arange(len(b)), "right")
    at_a = np.arange(len(a)) + np.append(0, cut_b)[group_a]
    at_b = np.arange(len(b)) + cut_a[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[cut_a - 1]], mark[at_b[cut_b - 1]] = ord("|"), ord(";")
    table, size = _digits(n)
    size = size[ids]
    raw = table[ids]
    raw[np.arange(len(ids)), size] = mark
    raw = raw[np.arange(table.shape[1])[None, :] <= size[:, None]].tobytes()
    ends = np.append(0, np.cumsum(size + 1))
    places = ends[first_a + first_b]
    return [raw[s : max(s, e - 1)] for s, e in zip(places[:-1].tolist(), places[1:].tolist())]


class Totals:
    """Corpus-wide links of pairs of ids in mapped shards of sorted arrays."""

    def __init__(self, shards: list[tuple[int, str]]):
        self.shards = sorted(shards)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of each pair, and whether no pair of its B id has more; ``keys`` are in order and counted."""
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        cuts = np.append(np.searchsorted(keys, [k for k, _ in self.shards]), len(keys))
        for (_, name), s, e in zip(self.shards, cuts[:-1], cuts[1:]):
            if s < e:
                known, values = _mapped(name)
                at = np.searchsorted(known, keys[s:e])
                counts[s:e], best[s:e] = values[at] >> 1, values[at] & 1
        return counts, best


@lru_cache(4096)
def _mapped(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a shard; a worker maps, or copies, each shard once."""
    return map_array(f"{name}-pairs", np.int64), map_array(f"{name}-links", np.int64)


def _write_totals(counted: DataFrame, width: int) -> Totals:
    """Add up ``(pair, n)`` and write the totals in shards of sorted arrays."""
    spark = counted.sparkSession
    folder = new_folder(spark, "pairs")
    totals = counted.groupBy("pair").agg(F.sum("n").alias("n"))
    path = f"{folder}/totals"
    totals.write.parquet(path)
    totals = spark.read.parquet(path)
    shards = max(1, -(-totals.count() // SHARD_PAIRS))
    # One row per B id: never more than the vocabulary has.
    most = totals.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    marked = totals.join(F.broadcast(most), F.col("pair") % width == F.col("b"))
    marked = marked.select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("links"))
    dealt = marked.repartitionByRange(shards, "pair").sortWithinPartitions("pair")

    def write(batches):
        columns = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if columns:  # about SHARD_PAIRS rows
            pairs, links = (np.concatenate(c) for c in zip(*columns))
            name = f"{folder}/{uuid.uuid4().hex}"
            write_array(f"{name}-pairs", pairs)
            write_array(f"{name}-links", links)
            yield pa.record_batch([pa.array([int(pairs[0])]), pa.array([name])], names=["first", "name"])

    found = dealt.mapInArrow(write, "first long, name string").collect()  # one row per shard
    return Totals([(r["first"], r["name"]) for r in found])


def _read(spark, path: str) -> bytes:
    """A vocabulary file, through Spark's reader if its place is not local to the driver."""
    if "://" in path or path.startswith("file:"):
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def align(
    df: DataFrame, a: str, b: str, text: str = "text", keep: list[str] | None = None, groups: bool = False
) -> DataFrame:
    """The alignment of every text, next to the columns ``keep``, all if not given.

    Adds ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair has the most links of its B id in the corpus),
    ``count_sum`` (over the links, their pair's links in the corpus) and ``digest`` (SHA-256 of the written groups). With ``groups`` also
    ``a`` and ``b``, the ids, and ``end_a`` and ``end_b``, how many of them each group and those before it hold. Columns
    of the same names are replaced.
    """
    spark = df.sparkSession
    files = _read(spark, a), _read(spark, b)
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest"] + (["a", "b", "end_a", "end_b"] if groups else [])
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    rows = df.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def encode(batches):
        one, two = _tokenizers(*files)
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for s, e in slices(offsets, CHUNK_BYTES):
                ids_a, n_a, ids_b, n_b = encode_chunk(one, two, batch.column("text").slice(s, e - s).to_pylist())
                ends = [np.cumsum(t.bytes.size[i]) for t, i in ((one, ids_a), (two, ids_b))]
                pairs, links = pair_counts(ids_a, ids_b, *ends, len(two.bytes))
                places = pa.array([0, e - s], pa.int32())
                arrays = [_packed(x) for x in (ids_a, n_a, ids_b, n_b, pairs, links)]
                yield pa.record_batch(
                    [pa.ListArray.from_arrays(places, batch.column("row").slice(s, e - s)), *arrays],
                    names=["rows", "a", "n_a", "b", "n_b", "pairs", "links"],
                )

    names = "a binary, n_a binary, b binary, n_b binary, pairs binary, links binary"
    folder = new_folder(spark, "tokens")
    coded = rows.mapInArrow(encode, f"rows array<{kind}>, {names}")
    coded.write.option("compression", "zstd").parquet(folder)
    chunks = spark.read.parquet(folder)

    def counted(batches):
        for batch in batches:
            for pairs, links in zip(batch.column(0), batch.column(1)):
                yield pa.record_batch([pa.array(_unpacked(pairs)), pa.array(_unpacked(links))], names=["pair", "n"])

    width = len(_tokenizers(*files)[1].bytes)
    totals = _write_totals(chunks.select("pairs", "links").mapInArrow(counted, "pair long, n long"), width)

    def finish(batches):
        one, two = _tokenizers(*files)
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("rows").slice(k, 1).flatten()
                arrays = [_unpacked(batch.column(c)[k]) for c in ("a", "n_a", "b", "n_b", "pairs")]
                columns = _finished(one.bytes, two.bytes, totals, *arrays, groups)
                yield pa.record_batch([own, *columns], names=["row", *new])

    types = {"digest": "string"} | dict.fromkeys(["a", "b", "end_a", "end_b"], "array<int>")
    schema = f"row {kind}, " + ", ".join(f"{c} {types.get(c, 'long')}" for c in new)
    out = chunks.select("rows", "a", "n_a", "b", "n_b", "pairs").mapInArrow(finish, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *new)


def _packed(values: np.ndarray) -> pa.Array:
    """An array of numbers as one binary value, in two or four bytes a number if they fit, led by that width."""
    top = int(values.max()) if len(values) else 0
    kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64
    return pa.array([bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()], pa.binary())


def _unpacked(value) -> np.ndarray:
    raw = np.frombuffer(value.as_buffer(), np.uint8)
    kind = {2: np.uint16, 4: np.uint32, 8: np.int64}[int(raw[0])]
    return raw[1:].copy().view(kind).astype(np.int64)


def _finished(
    bytes_a: _Bytes, bytes_b: _Bytes, totals: Totals, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray,
    pairs: np.ndarray, groups: bool,
) -> list[pa.Array]:
    """The new columns of the rows of a chunk."""
    rows = len(n_a)
    first_a, first_b = (np.append(0, np.cumsum(n)) for n in (n_a, n_b))
    links, best, total = (np.zeros(rows, np.int64) for _ in range(3))
    count_of, best_of = totals(pairs)
    cuts_a, cuts_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for link_a, link_b, cut_a, cut_b in pieces(np.cumsum(bytes_a.size[a]), np.cumsum(bytes_b.size[b])):
        at = np.searchsorted(pairs, a[link_a] * len(bytes_b) + b[link_b])
        # Links come in the order of A tokens, so the rows are runs.
        cut = np.searchsorted(link_a, first_a)
        sums = [np.append(0, np.cumsum(x[at].astype(np.int64))) for x in (count_of, best_of)]
        links += np.diff(cut)
        total += np.diff(sums[0][cut])
        best += np.diff(sums[1][cut])
        cuts_a.append(cut_a)
        cuts_b.append(cut_b)
    cut_a, cut_b = np.concatenate(cuts_a), np.concatenate(cuts_b)
    last = np.searchsorted(cut_a, first_a, "right")
    texts = written(a, b, cut_a, cut_b, first_a, first_b, max(len(bytes_a), len(bytes_b)))
    digest = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
    out = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, np.diff(last), links, best, total)] + [pa.array(digest, pa.string())]
    if groups:
        for ids, first in ((a, first_a), (b, first_b)):
            out.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
        for cut, first in ((cut_a, first_a), (cut_b, first_b)):
            own = cut - np.repeat(first[:-1], np.diff(last))
            out.append(pa.ListArray.from_arrays(pa.array(last.astype(np.int32)), pa.array(own.astype(np.int32))))
    return out
