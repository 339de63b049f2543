"""Splits, folds, oversampling, bootstrap and review samples, all decided by content hashes.

A row's place in its class is its rank by ``sha1(label, text, row_id, seed)``. The hash spreads
a class, and copies of one text within it, evenly over buckets, so ranks come from bucket counts
plus a rank inside a bucket; no class has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.functions.columns import ColumnLike, bind, col
from talkmill.functions.text import snippet
from talkmill.session import checked_broadcast

BUCKET_DIGITS = 3  # hex digits: 4096 buckets per class
COPY_RANGE = 1000  # copies of a row that one task makes at a time


def content_hash(label: ColumnLike, text: ColumnLike) -> Column:
    """Identity of a labelled text."""
    return F.sha1(F.concat(col(label).cast("string"), F.lit("\x1f"), col(text)))


def sample_key(label: str, text: str, row_id: str, seed: int = 42) -> Column:
    parts = [F.col(label).cast("string"), F.col(text), F.col(row_id).cast("string"), F.lit(str(seed))]
    return F.sha1(F.concat_ws("\x1f", *parts))


def _keyed(df: DataFrame, label: str, text: str, row_id: str, seed: int) -> DataFrame:
    keyed = df.withColumn("__key", sample_key(label, text, row_id, seed))
    return keyed.withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))


def _bucket_offsets(keyed: DataFrame, label: str) -> DataFrame:
    """Rows per class and bucket, rows in earlier buckets and rows of the whole class."""
    counts = keyed.groupBy(label, "__bucket").agg(F.count("*").alias("__n"))
    order = W.partitionBy(label).orderBy("__bucket")
    return counts.withColumn(
        "__before",
        F.coalesce(F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("__total", F.sum("__n").over(W.partitionBy(label)))


def rank_in_class(
    df: DataFrame, label: str, text: str = "text", row_id: str = "row_id", seed: int = 42
) -> DataFrame:
    """Add ``rank`` (from 1) in hash order within the class and ``class_rows``."""
    keyed = _keyed(df, label, text, row_id, seed)
    offsets = _bucket_offsets(keyed, label).drop("__n")
    inside = W.partitionBy(label, "__bucket").orderBy("__key", row_id)
    return (
        keyed.withColumn("__inside", F.row_number().over(inside))
        .join(offsets, [label, "__bucket"])
        .withColumn("rank", F.col("__before") + F.col("__inside"))
        .withColumnRenamed("__total", "class_rows")
        .drop("__key", "__bucket", "__before", "__inside")
    )


def _mark_first(
    df: DataFrame, label: str, text: str, row_id: str, seed: int, take: Column
) -> DataFrame:
    """Add ``__total`` rows of the class and ``__first``: among the first ``take`` in hash order.

    ``take`` is per class and may use ``__total``. Only the hash where each class is cut has to
    be found: bucket counts give its bucket, and the rows of that one bucket are ranked. The
    table itself is then marked without a shuffle.
    """
    keyed = _keyed(df, label, text, row_id, seed)
    offsets = _bucket_offsets(keyed, label).withColumn("__take", take)
    cut_in = offsets.where("__before < __take and __before + __n >= __take").select(
        label, "__bucket", (F.col("__take") - F.col("__before")).alias("__need")
    )
    inside = W.partitionBy(label, "__bucket").orderBy("__key", row_id)
    cut = (
        keyed.select(label, "__bucket", "__key", row_id)
        .join(checked_broadcast(cut_in), [label, "__bucket"])
        .withColumn("__rn", F.row_number().over(inside))
        .where("__rn = __need")
        .select(label, F.struct("__key", row_id).alias("__cut"))
    )
    classes = offsets.groupBy(label).agg(F.max("__total").alias("__total")).join(cut, label, "left")
    marked = keyed.join(checked_broadcast(classes), label)
    first = F.coalesce(F.struct("__key", row_id) <= F.col("__cut"), F.lit(False))
    return marked.withColumn("__first", first).drop("__key", "__bucket", "__cut")


def hold_out(
    df: DataFrame,
    label: str,
    text: str = "text",
    row_id: str = "row_id",
    share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: the first ``round(share * n)`` rows of each class are ``test``."""
    take = F.floor(F.col("__total") * share + 0.5)
    marked = _mark_first(df, label, text, row_id, seed, take)
    part = F.when(F.col("__first"), "test").otherwise("train")
    return marked.withColumn("split", part).drop("__first", "__total")


def k_folds(
    df: DataFrame,
    label: str,
    k: int = 5,
    text: str = "text",
    row_id: str = "row_id",
    seed: int = 42,
) -> DataFrame:
    """Add ``fold`` in ``1..k``, dealt in turn within each class."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = rank_in_class(df, label, text, row_id, seed)
    fold = F.pmod(F.col("rank") - 1, F.lit(k)) + 1
    return ranked.withColumn("fold", fold.cast("int")).drop("rank", "class_rows")


def fold_manifest(folds: DataFrame, label: str, text: str = "text") -> DataFrame:
    """Rows per content hash, label and fold: what a saved fold assignment is checked against."""
    return folds.groupBy(
        content_hash(label, text).alias("row_hash"), F.col(label).alias("label"), "fold"
    ).agg(F.count("*").alias("n"))


def check_manifest(manifest: DataFrame, rows: DataFrame, label: str, k: int, text: str = "text") -> None:
    """Raise unless a saved manifest was made for ``k`` folds of exactly these rows."""
    found = manifest.agg(
        F.count_distinct("fold").alias("k"), F.sum("n").alias("n"), F.max("fold").alias("top")
    ).first()
    if found["k"] != k or found["top"] != k:
        raise ValueError(f"fold manifest was built for {found['k']} folds, not {k}")
    total = rows.count()
    if found["n"] != total:
        raise ValueError(f"fold manifest expects {found['n']} rows, the table has {total}")
    have = rows.groupBy(
        content_hash(label, text).alias("row_hash"), F.col(label).alias("label")
    ).agg(F.count("*").alias("have"))
    want = manifest.groupBy("row_hash", "label").agg(F.sum("n").alias("want"))
    off = have.join(want, ["row_hash", "label"], "full_outer").where("not have <=> want")
    if not off.isEmpty():
        raise ValueError("fold manifest does not match the rows")


def oversample(
    df: DataFrame, label: str, text: str = "text", row_id: str = "row_id", seed: int = 42
) -> DataFrame:
    """Copy rows of smaller classes until each class is as large as the largest.

    A class of ``m`` rows that lacks ``d`` gets ``d // m`` copies of every row and one more of
    its first ``d % m`` rows in hash order. ``copy_no`` 0 is the original.
    """
    largest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    lack = largest - F.col("__total")
    marked = _mark_first(df, label, text, row_id, seed, F.pmod(lack, F.col("__total")))
    extra = (F.floor(lack / F.col("__total")) + F.col("__first").cast("int")).cast("long")
    ready = marked.withColumn("__extra", extra).drop("__total", "__first")
    few = ready.where(F.col("__extra") < COPY_RANGE)
    few = few.withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), "__extra")))
    # Many copies of a row are dealt as ranges of copy numbers before they are made, so they spread over all tasks.
    many = ready.where(F.col("__extra") >= COPY_RANGE)
    starts = F.sequence(F.lit(0).cast("long"), "__extra", F.lit(COPY_RANGE).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows now, so no merging of small parts
    many = many.withColumn("__from", F.explode(starts)).repartition(parts, "__from", row_id)
    last = F.least(F.col("__from") + COPY_RANGE - 1, F.col("__extra"))
    many = many.withColumn("copy_no", F.explode(F.sequence("__from", last))).drop("__from")
    source = F.when(F.col("copy_no") == 0, "original").otherwise("oversample")
    every = few.unionByName(many).withColumn("copy_no", F.col("copy_no").cast("int"))
    return every.withColumn("_aug_source", source).drop("__extra")


def oversample_summary(copies: DataFrame, label: str) -> DataFrame:
    """Rows per class before and after, and copies made."""
    original = F.col("_aug_source") == "original"
    return copies.groupBy(F.col(label).alias("label")).agg(
        F.count_if(original).alias("before"),
        F.count("*").alias("after"),
        F.count_if(~original).alias("synthetic"),
    )


def _poisson(u: Column, rate: float) -> Column:
    """Smallest ``k`` whose Poisson distribution function exceeds ``u``; 20 terms cover 32 bits."""
    import math

    terms, total = [], 0.0
    for k in range(20 + int(4 * rate)):
        total += math.exp(-rate) * rate**k / math.factorial(k)
        terms.append(total)
    out = F.lit(len(terms))
    for k in reversed(range(len(terms))):
        out = F.when(u < terms[k], k).otherwise(out)
    return out


def bag_draw(row_id: str, bag: Column, fraction: float, seed: int) -> tuple[Column, Column]:
    """Key and Poisson weight of a row in a bag."""
    key = F.sha1(F.concat_ws("\x1f", F.col(row_id).cast("string"), bag.cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return key, bind(u, lambda x: _poisson(x, fraction)).cast("int")


def bag_weights(
    df: DataFrame, label: str, draws: list[tuple[int, int, int]], row_id: str = "row_id", fraction: float = 1.0, fold: str | None = None
) -> DataFrame:
    """Add ``weights``, the weight of a row in each draw as an array: ``bootstrap`` for many bags without repeating rows.

    A draw is ``(bag, seed, left-out fold)``, fold 0 leaving out none. Rows of the fold have weight 0. A class that a draw would miss
    gets its first row in hash order with weight 1.
    """

    def drawn(bag: int, seed: int, out: int) -> Column:
        key, weight = bag_draw(row_id, F.lit(bag), fraction, seed)
        use = F.col(fold) != out if fold and out else F.lit(True)
        return F.when(use, F.struct(weight.alias("w"), key.alias("k")))

    marked = df.withColumn("__d", F.array(*[drawn(*d) for d in draws]))
    cells = marked.select(label, F.col(row_id).alias("__id"), F.posexplode("__d").alias("__j", "__x")).where("__x IS NOT NULL")
    forced = (
        cells.groupBy(label, "__j")
        .agg(F.max("__x.w").alias("__w"), F.min(F.struct("__x.k", "__id")).alias("__first"))
        .where("__w = 0")
    )
    # One row per class and draw at most.
    forced = forced.groupBy(label).agg(F.map_from_entries(F.collect_list(F.struct("__j", "__first"))).alias("__forced"))
    joined = marked.join(checked_broadcast(forced), label, "left")

    def weight(x: Column, j: Column) -> Column:
        own = F.struct(x["k"], F.col(row_id)) == F.try_element_at("__forced", j)
        return F.when(own, 1).otherwise(F.coalesce(x["w"], F.lit(0)))

    return joined.withColumn("weights", F.transform("__d", weight)).drop("__d", "__forced")


def bootstrap(
    df: DataFrame,
    label: str,
    bags: int,
    row_id: str = "row_id",
    fraction: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Repeat the table per bag with a Poisson ``weight``; weight 0 is out of bag.

    A class that a bag would miss gets its first row in hash order with weight 1.
    """
    if fraction <= 0:
        raise ValueError("fraction must be positive")
    bagged = df.withColumn("bag", F.explode(F.sequence(F.lit(1), F.lit(bags))))
    key, weight = bag_draw(row_id, F.col("bag"), fraction, seed)
    drawn = bagged.withColumn("__key", key).withColumn("weight", weight)
    forced = (
        drawn.groupBy("bag", label)
        .agg(F.max("weight").alias("__w"), F.min(F.struct("__key", row_id)).alias("__first"))
        .where("__w = 0")
        .select("bag", label, "__first")
    )
    joined = drawn.join(checked_broadcast(forced), ["bag", label], "left")
    weight = F.when(F.struct("__key", row_id) == F.col("__first"), 1).otherwise(F.col("weight"))
    return joined.withColumn("weight", weight).drop("__key", "__first")


def out_of_bag(bagged: DataFrame) -> DataFrame:
    return bagged.where("weight = 0")


def class_samples(
    df: DataFrame,
    label: str,
    n: int = 5,
    text: str = "text",
    row_id: str = "row_id",
    seed: int = 42,
    classes: list | None = None,
) -> DataFrame:
    """First ``n`` rows per class in hash order, text cut for review.

    Ranks are limited inside each task before the shuffle, so a large class moves ``n`` rows per
    task.
    """
    rows = df if classes is None else df.where(F.col(label).isin(classes))
    order = W.partitionBy(label).orderBy("__key", row_id)
    return (
        rows.withColumn("__key", sample_key(label, text, row_id, seed))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .withColumn(text, snippet(text))
        .drop("__key")
    )


def paired_samples(df: DataFrame, label: str, first, second, n: int = 5, **options) -> DataFrame:
    """Samples of two classes side by side: rank 1 of both, rank 2 of both, ..."""
    sample = class_samples(df, label, n, classes=[first, second], **options)
    seen = {r[0] for r in sample.select(label).distinct().collect()}
    if seen != {first, second}:
        raise ValueError(f"classes not found: {sorted({first, second} - seen, key=str)}")
    place = F.when(F.col(label) == first, 0).otherwise(1)
    return sample.withColumn("place", place).orderBy("rank", "place")


def dry_run_sample(
    df: DataFrame, text: str = "text", row_id: str = "row_id", n: int = 5, seed: int = 42
) -> DataFrame:
    """A few longer rows in hash order, to look at before and after a change."""
    key = F.sha1(F.concat_ws("\x1f", F.col(text), F.col(row_id).cast("string"), F.lit(str(seed))))
    return df.where(F.length(text) > 20).orderBy(key, row_id).limit(n)


def sample_segments(
    files: DataFrame,
    target: int,
    duration_ms: int,
    known: DataFrame | None = None,
    seed: int = 42,
    file: str = "file",
    length_ms: str = "length_ms",
) -> DataFrame:
    """Segment candidates spread over files: first one per file, then a second, up to 3 x target.

    Each file has a grid of slots of 1.5 durations with a hash-driven shift of up to half a
    duration, so two starts are never closer than one duration. Known ids are left out.
    """
    room = (F.col(length_ms) - duration_ms).cast("long")
    pitch = duration_ms + duration_ms // 2
    half = max(duration_ms // 2, 1)
    slots = F.floor(room / F.lit(pitch)).cast("int")

    def draw(slot, salt):
        key = F.concat_ws("\x1f", F.col(file), slot.cast("string"), F.lit(f"{seed}{salt}"))
        return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long")

    slot = F.col("__slot")
    grid = (
        files.where(F.col(length_ms) >= duration_ms)
        .withColumn("__slot", F.explode(F.sequence(F.lit(0), slots)))
        .withColumn("start_ms", F.least(slot * pitch + F.pmod(draw(slot, "p"), F.lit(half)), room))
        .select(
            F.concat(F.col(file), F.lit("@"), F.col("start_ms").cast("string")).alias("id"),
            F.col(file).alias("file"),
            "start_ms",
            F.lit(duration_ms).alias("duration_ms"),
            draw(slot, "o").alias("__draw"),
        )
    )
    if known is not None:
        grid = grid.join(known.select("id").distinct(), "id", "left_anti")
    # The last filter lets Spark limit ranks inside each task before the shuffle.
    order = W.partitionBy("file").orderBy("__draw", "start_ms")
    turn = grid.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= 3 * target)
    return turn.orderBy("turn", "file").limit(3 * target).drop("__draw")
