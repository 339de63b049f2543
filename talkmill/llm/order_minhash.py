"""Order MinHash fingerprints, as column expressions only.

A text is a sequence of units: words, cut into pieces of at most 16 characters. Its k-mers of three units are
numbered by occurrence, so a repeated k-mer counts as often as it stands there. Each numbered k-mer is hashed
once; the upper bits deal it to one of 64 buckets and the smallest two of a bucket are kept. The two are put
back in text order and hashed together: one entry per bucket. Two texts agree in an entry when they share these
k-mers in the same order, which is what makes the share of equal entries sensitive to edit distance.

Hash, place and bucket are packed in one number, so that sorting an array of numbers does the work of grouping;
no step is more than ``n log n`` in the length of the text. Places have 24 bits; beyond 16.7 million units
they start again.

Null texts count as empty. A text without units has the empty fingerprint; two empty fingerprints are alike (1),
an empty and another one are not (0). A text of one or two units has a single k-mer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.llm.expressions import let

UNIT = r"[^\x20\x09-\x0D]{1,16}"
K = 3
BUCKET_BITS = 6
PLACE_BITS = 24
_PLACE = (1 << PLACE_BITS) - 1
_ENTRY_BITS = 32


def _pack(hash_: Column, place: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_PLACE)))


def _hash(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, PLACE_BITS)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_PLACE))


def _bucket(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - BUCKET_BITS)


def _starts(packed: Column, part) -> Column:
    """Places where ``part`` of a sorted array changes."""
    return F.filter(
        F.sequence(F.lit(0), F.size(packed) - 1),
        lambda i: (i == 0) | (part(F.get(packed, i)) != part(F.get(packed, i - 1))),
    )


def _kmers(units: Column) -> Column:
    """Sorted numbers: hash of each k-mer over its place."""

    def of(h: Column) -> Column:
        last = F.greatest(F.size(h) - K, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: _pack(F.xxhash64(*[F.get(h, i + j) for j in range(K)]), i)
        )

    return F.sort_array(let(F.transform(units, lambda u: F.xxhash64(u)), of))


def _numbered(kmers: Column) -> Column:
    """Sorted numbers: hash of each k-mer with its occurrence over its place."""

    def of(s: Column) -> Column:
        def runs(starts: Column) -> Column:
            def run(a: Column, j: Column) -> Column:
                n = F.coalesce(F.get(starts, j + 1), F.size(s)) - a
                first = F.get(s, a)
                once = F.array(_pack(F.xxhash64(_hash(first), F.lit(0)), _place(first)))
                more = F.transform(
                    F.sequence(F.lit(0), n - 1),
                    lambda o: _pack(F.xxhash64(_hash(first), o), _place(F.get(s, a + o))),
                )
                return F.when(n == 1, once).otherwise(more)

            return F.flatten(F.transform(starts, run))

        return let(_starts(s, _hash), runs)

    return F.sort_array(let(kmers, of))


def _entries(numbered: Column) -> Column:
    """Bucket and tuple hash of every bucket in use."""

    def of(s: Column) -> Column:
        def entry(i: Column) -> Column:
            x, y = F.get(s, i), F.get(s, i + 1)
            pair = F.when(_place(x) <= _place(y), F.xxhash64(_hash(x), _hash(y))).otherwise(
                F.xxhash64(_hash(y), _hash(x))
            )
            alone = y.isNull() | (_bucket(x) != _bucket(y))
            value = F.when(alone, F.xxhash64(_hash(x))).otherwise(pair)
            low = value.bitwiseAND(F.lit((1 << _ENTRY_BITS) - 1))
            return F.shiftleft(_bucket(x).cast("long"), _ENTRY_BITS).bitwiseOR(low)

        return F.transform(_starts(s, _bucket), entry)

    return let(numbered, of)


def signature(text: Column) -> Column:
    """Entries of the fingerprint, one number per bucket in use."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    none = F.array().cast("array<long>")
    return let(units, lambda u: F.when(F.size(u) > 0, _entries(_numbered(_kmers(u)))).otherwise(none))


def fingerprint(entries: Column) -> Column:
    """Entries in hexadecimal digits, ten for each."""
    return F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal entries over the buckets that either text uses, from 0 to 1."""
    buckets = lambda e: F.transform(e, lambda x: F.shiftrightunsigned(x, _ENTRY_BITS))
    used = F.size(F.array_union(buckets(a), buckets(b)))
    return F.when(used == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / used)


def with_next(df: DataFrame, id: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Add the ``columns`` of the row that follows in descending ``id``; after the last row comes the first.

    Rows are dealt to slices of ids of about equal size, and a slice is one window group; the first row of each slice, a
    row per slice, closes the gap to the one before. Null ids come last, equal ids in the order of ``columns``. ``id`` is
    a number. Added columns replace columns of the same name.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / n for k in range(1, n)]
    bounds = df.agg(F.percentile_approx(id, F.lit(shares) if shares else F.lit([0.5])).alias("b")).first().b or []
    bounds = sorted(set(bounds)) if shares else []
    coarse = bounds[:: max(1, int(len(bounds) ** 0.5))]
    step = max(1, int(len(bounds) ** 0.5))

    key = F.col(id)
    if bounds:  # number of bounds below the id, looked up in two steps
        low = F.size(F.filter(F.lit(coarse), lambda b: b < key))
        fine = F.slice(F.lit(bounds), F.greatest((low - 1) * step + 1, F.lit(1)), F.lit(step))
        number = F.when(low == 0, 0).otherwise((low - 1) * step + F.size(F.filter(fine, lambda b: b < key)))
    else:
        number = F.lit(0)
    rows = df.withColumn("__slice", F.when(key.isNull(), -1).otherwise(number).cast("int"))
    order = [F.desc_nulls_last(id), *columns]
    here = W.partitionBy("__slice").orderBy(*order)
    after = F.lead(F.struct(*columns)).over(here)

    # First row of each slice: its largest id, and among equal ids the first in order; at most n rows.
    tops = rows.groupBy("__slice").agg(F.max(id).alias("__top")).collect()
    names = sorted(r["__slice"] for r in tops)
    if not names:
        return rows.withColumn("__next", after).select(*_named(df, columns, prefix))
    largest = {r["__slice"]: r["__top"] for r in tops}
    kind = df.schema[id].dataType.simpleString()
    top = spark.createDataFrame(
        [(names[(k + 1) % len(names)], s, largest[s]) for k, s in enumerate(names)], f"__for int, __own int, __top {kind}"
    )
    # The filter reaches the scan, so what ``columns`` cost is paid for these rows only.
    wanted = key.isin([x for x in largest.values() if x is not None])
    heads = rows.where(wanted | key.isNull() if -1 in largest else wanted)
    heads = heads.join(F.broadcast(top), F.col("__slice") == F.col("__own"))
    heads = heads.where(F.col(id).eqNullSafe(F.col("__top")))
    firsts = heads.groupBy("__for").agg(F.min(F.struct(*columns)).alias("__head"))
    firsts = firsts.withColumnRenamed("__for", "__slice")
    out = rows.withColumn("__next", after).join(firsts, "__slice", "left")
    out = out.withColumn("__next", F.coalesce("__next", "__head"))
    return out.select(*_named(df, columns, prefix))


def _named(df: DataFrame, columns: list[str], prefix: str) -> list[Column]:
    new = [prefix + c for c in columns]
    return [F.col(f"`{c}`") for c in df.columns if c not in new] + [
        F.col("__next")[c].alias(prefix + c) for c in columns
    ]
