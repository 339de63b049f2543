"""Running totals and runs over a global order, without a single-task window.

Rows are range-partitioned on the order and written once (``checkpointed``), which fixes the
slices. Windows then run inside a slice, and what a slice needs from the ones before it comes
from a table with one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.session import checked_broadcast, checkpointed

SLICE = "__slice"
_BEFORE = (W.unboundedPreceding, -1)
_UPTO = (W.unboundedPreceding, W.currentRow)


def sliced(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition on ``order`` and tag each row with its slice number."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *[F.col(c) for c in order])
    return checkpointed(parts).withColumn(SLICE, F.spark_partition_id())


def with_running(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], previous: dict[str, str] | None = None
) -> DataFrame:
    """Add exact running sums and previous-row values over the global order of ``sliced`` rows.

    ``sums`` maps a new column to the column summed up to and with the current row; ``previous``
    maps a new column to an ascending order column whose last value before the row is wanted.
    """
    previous = previous or {}
    totals = [F.sum(c).alias(f"__s_{o}") for o, c in sums.items()]
    tops = [F.max(c).alias(f"__p_{o}") for o, c in previous.items()]
    # One row per slice, so the window over it is small whatever the data.
    earlier = W.orderBy(SLICE).rowsBetween(*_BEFORE)
    offsets = df.groupBy(SLICE).agg(*totals, *tops)
    offsets = offsets.select(
        SLICE,
        *[F.coalesce(F.sum(f"__s_{o}").over(earlier), F.lit(0)).alias(f"__s_{o}") for o in sums],
        *[F.max(f"__p_{o}").over(earlier).alias(f"__p_{o}") for o in previous],
    )
    local = W.partitionBy(SLICE).orderBy(*order)
    out = df.join(F.broadcast(offsets), SLICE)
    for o, c in sums.items():
        running = F.sum(c).over(local.rowsBetween(*_UPTO)) + F.col(f"__s_{o}")
        out = out.withColumn(o, running)
    for o, c in previous.items():
        out = out.withColumn(o, F.coalesce(F.lag(c).over(local), F.col(f"__p_{o}")))
    helpers = [f"__s_{o}" for o in sums] + [f"__p_{o}" for o in previous]
    return out.drop(*helpers)


def running_max_before(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Largest ``value`` of all rows before the current one in the global order."""
    rows = sliced(df, order)
    earlier = W.orderBy(SLICE).rowsBetween(*_BEFORE)
    offsets = rows.groupBy(SLICE).agg(F.max(value).alias("__m"))
    offsets = offsets.select(SLICE, F.max("__m").over(earlier).alias("__m"))
    local = W.partitionBy(SLICE).orderBy(*order).rowsBetween(*_BEFORE)
    inside = F.max(value).over(local)
    return (
        rows.join(F.broadcast(offsets), SLICE)
        .withColumn(out, F.greatest(inside, F.col("__m")))
        .drop("__m", SLICE)
    )


def merge_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: str,
    end: str,
    gap: Column | float,
) -> DataFrame:
    """Merge neighbouring rows with equal ``keys`` whose gap is at most ``gap``.

    Rows are neighbours in the order ``(keys[0], order)``: with keys ``(file, speaker)`` a row of
    another speaker in between ends a run. Returns one row per merged run with its smallest
    start and largest end. A file of any size is spread over slices; a run that crosses a slice
    border is joined by its carried end.
    """
    place = [keys[0], *[c for c in order if c != keys[0]]]
    rows = sliced(df.select(*dict.fromkeys([*keys, *place, start, end])), place)
    local = W.partitionBy(SLICE).orderBy(*place)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(local))
    first = F.lag(F.lit(1)).over(local).isNull()
    rows = rows.withColumn("__first", first).withColumn("__new", (first | ~same).cast("long"))
    rows = rows.withColumn("__run", F.sum("__new").over(local.rowsBetween(*_UPTO)))

    # Last run of each slice, and the longest stretch of slices that it fills alone.
    name = F.struct(*keys)
    ends = rows.groupBy(SLICE, "__run").agg(
        F.max(end).alias("__end"), F.first(name).alias("__name")
    )
    last = ends.groupBy(SLICE).agg(
        F.min_by("__name", "__run").alias("__head"),
        F.max_by("__name", "__run").alias("__tail"),
        F.max_by("__end", "__run").alias("__tail_end"),
        F.max("__run").alias("__runs"),
    )
    by_slice = W.orderBy(SLICE)
    goes_on = (F.col("__runs") == 1) & F.col("__head").eqNullSafe(F.lag("__tail").over(by_slice))
    last = last.withColumn("__cut", F.when(goes_on, 0).otherwise(1))
    last = last.withColumn("__chain", F.sum("__cut").over(by_slice.rowsBetween(*_UPTO)))
    chain = W.partitionBy("__chain").orderBy(SLICE).rowsBetween(*_UPTO)
    last = last.withColumn("__reach", F.max("__tail_end").over(chain))
    carry = last.select(
        SLICE,
        F.lag("__tail").over(by_slice).alias("__from"),
        F.lag("__reach").over(by_slice).alias("__from_end"),
    )

    rows = rows.join(F.broadcast(carry), SLICE)
    follows = (F.col("__run") == 1) & F.col("__from").eqNullSafe(name) & F.col("__from").isNotNull()
    in_run = W.partitionBy(SLICE, "__run").orderBy(*place).rowsBetween(*_BEFORE)
    reach = F.greatest(F.max(end).over(in_run), F.when(follows, F.col("__from_end")))
    rows = rows.withColumn("__reach", reach)
    opens = F.col("__reach").isNull() | (F.col(start) - F.col("__reach") > gap)
    rows = rows.withColumn("__open", opens.cast("long"))
    islands = with_running(rows, place, {"__island": "__open"})
    return islands.groupBy("__island").agg(
        *[F.first(k).alias(k) for k in keys],
        F.min(start).alias(start),
        F.max(end).alias(end),
    ).drop("__island")


def exact_quantile(
    df: DataFrame, value: str, share: float, out: str, by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantile per group with linear interpolation between neighbouring ranks.

    Values are counted first, then ranked by running counts over the global order, so neither
    a group nor its distinct values have to fit in one task. One row per group.
    """
    keys = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    ranked = with_running(sliced(counted, [*keys, value]), [*keys, value], {"__upto": "__n"})
    ranked = ranked.select(*keys, value, "__n", "__upto")
    one = F.lit(1).alias("__one")
    base = ranked.groupBy(*keys, one).agg(
        F.min(F.col("__upto") - F.col("__n")).alias("__base"), F.sum("__n").alias("__rows")
    )
    place = (F.col("__rows") - 1) * share
    low = F.col("__base") + F.floor(place)
    high = F.least(low + 1, F.col("__base") + F.col("__rows") - 1)

    def covers(i):
        return (F.col("__upto") - F.col("__n") <= i) & (i < F.col("__upto"))

    hits = ranked.withColumn("__one", F.lit(1)).join(
        checked_broadcast(base), [*keys, "__one"]
    ).where(covers(low) | covers(high))
    return (
        hits.groupBy(*keys, "__one")
        .agg(
            F.max(F.when(covers(low), F.col(value))).alias("__a"),
            F.max(F.when(covers(high), F.col(value))).alias("__b"),
            F.first(place - F.floor(place)).alias("__f"),
        )
        .select(*keys, (F.col("__a") + F.col("__f") * (F.col("__b") - F.col("__a"))).alias(out))
    )
