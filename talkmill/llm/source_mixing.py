"""Temperature mixing of sources: weights from token shares, realised as block permutations.

Weights are the sources' token shares raised to an exponent and normalised. The exponent between 0 (all sources
alike) and 1 (as they are) is bisected: the largest one whose weights have at least the target entropy, a share of
the entropy of equal weights, and, if that asks for too much, the smallest one at which no source is repeated more
often than the limit allows.

The budget is the number of tokens to draw; by default it is the least at which every source is used whole. A
source's part of it is met by blocks: each block is one permutation of all its documents, drawn by a keyed hash,
and the last block stops with the document that reaches the part. So a document is drawn either the
floor or the ceiling of its source's number of passes.

Running token sums over a permutation come from hash buckets whose number follows the size of the source, so
no source of any size is one window group. A null source is a source of its own. Null and empty texts have no tokens;
they are drawn in every whole block and, in a partial block, as long as the part is not reached. Equal rows are
ordered by their number of the copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.session import checkpointed

BUCKET_ROWS = 2000  # expected rows of a bucket, the largest window group
DIGITS = 60  # halvings of the exponent's range


def token_count(text: Column) -> Column:
    """Number of words, runs without ASCII white space."""
    # Single spaces, by far the most, are left where they are.
    gaps = r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}"
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), gaps, " "))
    return F.when(trimmed == "", 0).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "))) + 1).cast("long")


def _weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(n / total) ** exponent if n else 0.0 for n in tokens]
    return [x / sum(raised) for x in raised]


def _entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _repeats(tokens: list[int], weights: list[float], budget: int | None) -> list[float]:
    """Passes over each source; without a budget the source used least is used once."""
    raw = [w / n if n else 0.0 for n, w in zip(tokens, weights)]
    scale = budget if budget is not None else 1 / min(x for x in raw if x)
    return [x * scale for x in raw]


def mixing_weights(
    tokens: dict, entropy: float = 0.95, repeats: float = 4.0, budget: int | None = None
) -> tuple[dict, float]:
    """Weight of each source and the exponent used.

    ``tokens`` are the tokens of each source. ``entropy`` is the least share of the entropy that equal weights
    would have, ``repeats`` the most passes over a source; the limit goes before the entropy. With a budget that
    repeats a source more often even at exponent 1, the weights are those of exponent 1.
    """
    names = [s for s in tokens if tokens[s]]
    counts = [tokens[s] for s in names]
    if not counts:
        return {s: 0.0 for s in tokens}, 1.0

    def enough(x: float) -> bool:
        return _entropy(_weights(counts, x)) >= entropy * math.log(len(counts)) - 1e-12

    def allowed(x: float) -> bool:
        return max(_repeats(counts, _weights(counts, x), budget)) <= repeats + 1e-12

    exponent = _last(enough) if not enough(1.0) else 1.0
    if not allowed(exponent):
        exponent = _first(allowed, exponent) if allowed(1.0) else 1.0
    weights = dict(zip(names, _weights(counts, exponent)))
    return {s: weights.get(s, 0.0) for s in tokens}, exponent


def _last(holds) -> float:
    """Largest exponent at which ``holds``, true at 0 and false at 1."""
    low, high = 0.0, 1.0
    for _ in range(DIGITS):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def _first(holds, low: float) -> float:
    """Smallest exponent above ``low`` at which ``holds``, false at ``low`` and true at 1."""
    high = 1.0
    for _ in range(DIGITS):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def passes(
    df: DataFrame,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    entropy: float = 0.95,
    repeats: float = 4.0,
    budget: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """``(id, key, tokens, source, copies, weight, passes, drawn)`` for every different row of ``df``.

    ``key`` is a hash of the text; rows that agree in id, source and text are one row with their number in
    ``copies``. ``passes`` are the whole blocks of the source; the rows at the head of the last, partial permutation
    are drawn ``drawn - passes * copies`` times more.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id).alias("id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("key"),
        token_count(F.col(text)).alias("tokens"),
    )
    rows = checkpointed(rows.groupBy("id", "source", "key", "tokens").agg(F.count("*").alias("copies")))
    held = F.col("tokens") * F.col("copies")
    # One row per source; weights are few numbers, the rest stays distributed.
    found = rows.groupBy("source").agg(F.sum(held).alias("t"), F.count("*").alias("n")).collect()
    totals = {r.source: int(r.t) for r in found}
    weights, _ = mixing_weights(totals, entropy, repeats, budget)
    used = [s for s in totals if weights[s] > 0]
    whole = _repeats([totals[s] for s in used], [weights[s] for s in used], budget) if used else []
    whole = dict(zip(used, whole))
    plan = []
    for r in found:
        share = whole.get(r.source, 1.0)
        blocks = math.floor(share + 1e-9)
        rest = round(max(share - blocks, 0.0) * totals[r.source])
        plan.append((r.source, weights[r.source], blocks, rest, max(1, math.ceil(r.n / BUCKET_ROWS))))
    kind = df.schema[source].dataType.simpleString()
    plan = spark.createDataFrame(plan, f"source_ {kind}, weight double, passes int, rest long, buckets int")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")

    order = F.xxhash64(F.lit(seed), "id", "key")
    # The order is by bucket first: a bucket is a range of the hash.
    spot = (F.shiftrightunsigned(order, 33).cast("double") / F.lit(float(1 << 31)) * F.col("buckets")).cast("int")
    rows = rows.withColumns({"order": order, "bucket": spot})
    sums = rows.groupBy("source", "bucket").agg(F.sum(held).alias("n"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(
        F.col("source").alias("source_"), F.col("bucket").alias("bucket_"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"),
    )
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    here = W.partitionBy("source", "bucket").orderBy("order", "id", "key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum(held).over(here), F.lit(0)))
    left = F.col("rest") - F.col("before")
    # Copies of a row follow each other: those that begin before the rest is used up.
    more = F.when(left <= 0, 0).when(F.col("tokens") == 0, F.col("copies")).otherwise(
        F.least(F.col("copies"), F.ceil(left / F.greatest("tokens", F.lit(1))))
    )
    drawn = (F.col("passes") * F.col("copies") + more).cast("long")
    return rows.select("id", "key", "tokens", "source", "copies", "weight", "passes", drawn.alias("drawn"), "before", "order")


def mixed(df: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, each as often as it is drawn; all columns stay and none is added."""
    plan = passes(df, id, source, text, **options)
    plan = plan.select(
        F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("key").alias("__key"),
        F.col("drawn").alias("__drawn"), F.col("copies").alias("__copies"),
    )
    rows = df.withColumn("__text_key", F.xxhash64(F.col(text)))
    same = F.col(f"`{id}`").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    rows = rows.join(plan, same & F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    # Copies of a row share its draws; what cannot be shared evenly goes to the first ones.
    single = rows.where("__copies = 1").withColumn("__times", F.col("__drawn"))
    many = rows.where("__copies > 1")
    number = F.row_number().over(W.partitionBy("__id", "__source", "__key").orderBy("__id")) - 1
    many = many.withColumn("__times", F.floor(F.col("__drawn") / F.col("__copies")) + (number < F.col("__drawn") % F.col("__copies")).cast("long"))
    out = single.unionByName(many).where("__times > 0")
    out = out.withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
