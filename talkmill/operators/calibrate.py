"""Calibration: ECE, Brier score, log loss, reliability bins, tiers and temperature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions.columns import bind
from talkmill.functions.numbers import array_sum, safe_divide
from talkmill.operators.metrics import summary
from talkmill.session import checkpointed


def bin_of(confidence: Column, n_bins: int = 10) -> Column:
    """Number of the ``(lo, hi]`` bin, from 0; null for 0 and for values above 1.

    Edges are the doubles of ``i * (1 / n)``, as an even grid over [0, 1] has them.
    """
    edges = F.array(*[F.lit(e) for e in _edges(n_bins)])
    inside = (confidence > 0) & (confidence <= 1)
    guess = F.least(F.greatest(F.ceil(confidence * n_bins), F.lit(1)), F.lit(n_bins)).cast("int")
    low, high = F.element_at(edges, guess), F.element_at(edges, guess + 1)
    exact = F.when(confidence <= low, guess - 1).when(confidence > high, guess + 1).otherwise(guess)
    return F.when(inside, exact - 1)


def _edges(n_bins: int) -> list[float]:
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def _binned(df: DataFrame, confidence: str, correct: Column, n_bins: int, by: Sequence[str]) -> DataFrame:
    return (
        df.select(*by, F.col(confidence).alias("c"), correct.cast("double").alias("ok"))
        .withColumn("bin", bin_of(F.col("c"), n_bins))
        .groupBy(*by, "bin")
        .agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum("ok").alias("ok"))
    )


def _correct() -> Column:
    return F.col("y_true") == F.col("y_pred")


def ece(df: DataFrame, confidence: str = "confidence", n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error; rows outside all bins count in the total only."""
    bins = _binned(df, confidence, _correct(), n_bins, by)
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("c") - F.col("ok"))).otherwise(0.0)
    return bins.groupBy(*by).agg(safe_divide(F.sum(gap), F.sum("n")).alias("ece"))


def reliability(
    df: DataFrame, confidence: str = "confidence", n_bins: int = 10
) -> DataFrame:
    """Mean confidence, accuracy and rows per bin; an empty bin has its centre and no accuracy."""
    edges = _edges(n_bins)
    grid = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(n_bins)], "bin int, lo double, hi double"
    )
    bins = _binned(df, confidence, _correct(), n_bins, ())
    # At most ``n_bins`` + 1 rows.
    return grid.join(F.broadcast(bins), "bin", "left").select(
        "bin",
        "lo",
        "hi",
        F.coalesce(F.col("c") / F.col("n"), (F.col("lo") + F.col("hi")) / 2).alias("confidence"),
        (F.col("ok") / F.col("n")).alias("accuracy"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def tiers(
    df: DataFrame, bounds: Sequence[float] = (0.6, 0.8), confidence: str = "confidence"
) -> DataFrame:
    """Rows, coverage and accuracy per confidence tier; the upper bound belongs to a tier."""
    cuts = sorted(bounds)
    tier = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        tier = F.when(F.col(confidence) <= cuts[i], i).otherwise(tier)
    names = [f"<= {cuts[0]:.2f}"]
    names += [f"{a:.2f} - {b:.2f}" for a, b in zip(cuts, cuts[1:])] + [f"> {cuts[-1]:.2f}"]
    counts = [
        F.struct(
            F.lit(i).alias("tier"),
            F.lit(name).alias("name"),
            F.count_if(tier == i).alias("count"),
            F.count_if((tier == i) & _correct()).alias("ok"),
        ).alias(f"t{i}")
        for i, name in enumerate(names)
    ]
    one = df.agg(F.count("*").alias("rows"), *counts)
    return one.select("rows", F.inline(F.array(*[f"t{i}" for i in range(len(names))]))).select(
        "tier",
        "name",
        "count",
        safe_divide(F.col("count"), F.col("rows")).alias("coverage"),
        F.try_divide(F.col("ok").cast("double"), F.col("count")).alias("accuracy"),
    )


def brier(probs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Multiclass Brier score of long rows ``(row_id, label, proba, y_true)``."""
    hit = (F.col("label") == F.col("y_true")).cast("double")
    error = F.pow(F.col("proba") - hit, F.lit(2.0))
    rows = F.count_if(F.col("label") == F.col("y_true"))
    return probs.groupBy(*by).agg(safe_divide(F.sum(error), rows).alias("brier"))


def nll(probs: DataFrame, by: Sequence[str] = (), eps: float = 1e-9) -> DataFrame:
    """Mean negative log probability of the true label."""
    return (
        probs.where(F.col("label") == F.col("y_true"))
        .groupBy(*by)
        .agg(F.avg(-F.log(F.col("proba") + eps)).alias("nll"))
    )


def dense_logits(logits: DataFrame) -> DataFrame:
    """One row per sample from long ``(row_id, label, logit, y_true)``: scores in label order."""
    cell = F.struct("label", F.col("logit").cast("double").alias("logit"))
    return logits.groupBy("row_id", "y_true").agg(
        F.sort_array(F.collect_list(cell)).alias("cells")
    ).select(
        "row_id",
        "y_true",
        F.transform("cells", lambda c: c["label"]).alias("labels"),
        F.transform("cells", lambda c: c["logit"]).alias("scores"),
    )


def _true_proba(temperature: float) -> Column:
    scores = F.col("scores")
    t = F.lit(float(temperature))
    top = F.array_max(scores)
    place = F.array_position("labels", F.col("y_true")).cast("int")
    powers = F.transform(scores, lambda x: F.exp((x - top) / t))
    return F.exp((F.element_at(scores, place) - top) / t) / array_sum(powers)


def temperature_grid(dense: DataFrame, grid: Sequence[float], eps: float = 1e-9) -> DataFrame:
    """Log loss at each temperature of a grid, in one pass without a shuffle of the rows."""
    losses = [
        F.struct(
            F.lit(float(t)).alias("temperature"), F.avg(-F.log(_true_proba(t) + eps)).alias("nll")
        ).alias(f"t{i}")
        for i, t in enumerate(grid)
    ]
    one = dense.agg(*losses)
    return one.select(F.inline(F.array(*[f"t{i}" for i in range(len(grid))])))


def _slopes(dense: DataFrame, t: float) -> tuple[float, float, float]:
    """Mean log loss in ``b = 1 / t``, and its first and second derivative by ``b``: one pass, three sums.

    With ``m`` the mean score under the scaled probabilities the slope is ``m - score of the truth``, and the curvature is the
    variance of the score, which is never negative: the loss is convex in ``b``.
    """
    b, scores = F.lit(1.0 / t), F.col("scores")
    place = F.array_position("labels", F.col("y_true")).cast("int")

    def sums(top: Column) -> Column:
        powers = F.transform(scores, lambda x: F.exp((x - top) * b))
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("xx"))
        return F.aggregate(
            F.arrays_zip(powers.alias("p"), scores.alias("x")),
            zero,
            lambda a, c: F.struct(
                (a["n"] + c["p"]).alias("n"),
                (a["x"] + c["p"] * (c["x"] - top)).alias("x"),
                (a["xx"] + c["p"] * (c["x"] - top) * (c["x"] - top)).alias("xx"),
            ),
            lambda a: F.struct(
                (F.log(a["n"]) - (F.element_at(scores, place) - top) * b).alias("loss"),
                (a["x"] / a["n"] - (F.element_at(scores, place) - top)).alias("slope"),
                (a["xx"] / a["n"] - (a["x"] / a["n"]) * (a["x"] / a["n"])).alias("bend"),
            ),
        )

    one = dense.select(bind(F.array_max(scores), sums).alias("s"))
    row = one.agg(*[F.avg(f"s.{c}").alias(c) for c in ("loss", "slope", "bend")]).first()
    return row["loss"] or 0.0, row["slope"] or 0.0, row["bend"] or 0.0


def fit_temperature(logits: DataFrame, low: float = 0.1, high: float = 10.0, tolerance: float = 1e-7, rounds: int = 60) -> float:
    """Temperature in ``[low, high]`` with the smallest log loss.

    The loss is convex in the inverse temperature, so the sign of its slope says on which side the best one lies: every pass halves
    the bracket at least, and a Newton step from the two derivatives replaces the halving where it stays inside. A slope that points out
    of the range at one of its ends gives that end.
    """
    dense = dense_logits(logits).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        left, right = 1.0 / high, 1.0 / low  # inverse temperatures
        if _slopes(dense, high)[1] >= 0:
            return high
        if _slopes(dense, low)[1] <= 0:
            return low
        b = min(max(1.0, left), right)
        for _ in range(rounds):
            _, slope, bend = _slopes(dense, 1.0 / b)
            left, right = (b, right) if slope < 0 else (left, b)
            step = b - slope / bend if bend > 0 else left
            near = step if left < step < right else (left + right) / 2
            if slope == 0 or abs(near - b) < tolerance * b or right - left < tolerance * left:
                return 1.0 / near
            b = near
        return 1.0 / b
    finally:
        dense.unpersist()


def probabilities(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Long probabilities from long logits: ``softmax(logit / temperature)``."""
    return _probabilities(dense_logits(logits), temperature)


def _probabilities(dense: DataFrame, temperature: float) -> DataFrame:
    scores, t = F.col("scores"), F.lit(float(temperature))
    powers = F.transform(scores, lambda x: F.exp((x - F.array_max(scores)) / t))
    cells = F.arrays_zip(F.col("labels").alias("label"), F.col("powers").alias("power"))
    return (
        dense.withColumn("powers", powers)
        .withColumn("total", array_sum("powers"))
        .select("row_id", "y_true", "total", F.inline(cells))
        .select("row_id", "y_true", "label", (F.col("power") / F.col("total")).alias("proba"))
    )


def top_predictions(probs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Predicted label and confidence per row; the first label in sort order wins a tie."""
    return probs.groupBy(*by, "row_id", "y_true").agg(
        F.min_by("label", F.struct((-F.col("proba")).alias("p"), F.col("label").alias("l"))).alias("y_pred"),
        F.max("proba").alias("confidence"),
    )


def calibration_report(logits: DataFrame, temperature: float, n_bins: int = 10) -> DataFrame:
    """ECE, Brier, log loss and weighted F1 before and after scaling, and their difference."""
    dense = checkpointed(dense_logits(logits))  # regrouped once for both stages and all scores
    before = _probabilities(dense, 1.0).withColumn("stage", F.lit("before"))
    after = _probabilities(dense, temperature).withColumn("stage", F.lit("after"))
    probs = before.unionByName(after)
    top = top_predictions(probs, ["stage"])
    # Every table has two rows.
    wide = (
        ece(top, n_bins=n_bins, by=["stage"])
        .join(brier(probs, ["stage"]), "stage")
        .join(nll(probs, ["stage"]), "stage")
        .join(summary(top, ["stage"]).select("stage", "f1_weighted"), "stage")
    )
    names = ("ece", "brier", "nll", "f1_weighted")
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    long = wide.select("stage", F.inline(cells))

    def stage(name):
        return F.max(F.when(F.col("stage") == name, F.col("value")))

    return long.groupBy("metric").agg(
        stage("before").alias("before"),
        stage("after").alias("after"),
        (stage("after") - stage("before")).alias("delta"),
    )
