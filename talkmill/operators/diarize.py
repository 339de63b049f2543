"""Speaker turns: merging, overlaps and diarization error, on segment tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.functions.numbers import exact_round
from talkmill.operators.scan import merge_runs

# Time is cut into pieces of this many seconds, so a long file is spread over many tasks and a
# range comparison only meets turns that are close in time.
PIECE_SEC = 60.0


def merge_turns(segments: DataFrame, gap: float = 0.5, index: str = "seg_idx") -> DataFrame:
    """Merge neighbouring turns of one speaker whose gap is at most ``gap``.

    Turns are neighbours in the order of start and ``index``, which must be unique in a file.
    """
    merged = merge_runs(segments, ["file_id", "speaker"], ["start", index], "start", "end", gap)
    return merged.withColumn("dur", F.col("end") - F.col("start"))


def _pieces(start: Column, end: Column, width: float) -> Column:
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(F.ceil(end / width) - 1, first))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("file_id",), width: float = PIECE_SEC
) -> DataFrame:
    """Pairs of turns of the same file that overlap in time.

    Both sides are repeated for the time pieces they touch and joined on file and piece. A pair
    is kept in the piece where its overlap starts, so it appears once. Columns other than the
    keys get the prefixes ``l_`` and ``r_``.
    """

    def side(df, prefix):
        named = df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])
        span = _pieces(F.col(prefix + "start"), F.col(prefix + "end"), width)
        return named.withColumn("__piece", F.explode(span))

    start = F.greatest("l_start", "r_start")
    end = F.least("l_end", "r_end")
    joined = side(left, "l_").join(side(right, "r_"), [*keys, "__piece"])
    return (
        joined.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
        .where(F.col("__piece") == F.floor(start / width))
        .withColumn("overlap", end - start)
        .drop("__piece")
    )


def _best_total(gain: np.ndarray) -> float:
    """Largest total of a one-to-one choice of rows and columns (shortest augmenting paths)."""
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    rows, cols = gain.shape
    cost = gain.max() - gain
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for new in range(rows):
        reach = np.full(cols, np.inf)
        came = np.full(cols, -1)
        done = np.zeros(cols, bool)
        row, col, spent = new, -1, 0.0
        while True:
            step = spent + cost[row] - row_price[row] - col_price
            better = ~done & (step < reach)
            reach[better], came[better] = step[better], col
            open_reach = np.where(done, np.inf, reach)
            col = int(open_reach.argmin())
            spent = open_reach[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        closed = done & (owner >= 0)
        row_price[owner[closed]] += spent - reach[closed]
        row_price[new] += spent
        col_price[done] -= spent - reach[done]
        while col >= 0:
            before = came[col]
            owner[col] = owner[before] if before >= 0 else new
            col = before
    used = owner >= 0
    return float(gain[owner[used], np.flatnonzero(used)].sum())


_ERRORS = "total double, missed double, false_alarm double, confusion double"


def _file_errors(states) -> tuple[float, float, float, float]:
    """Seconds of reference speech, missed, false alarm and confusion of one file."""
    sec = np.array([s["sec"] for s in states])
    n_ref = np.array([len(s["ref"]) for s in states])
    n_hyp = np.array([len(s["hyp"]) for s in states])
    refs = {r: i for i, r in enumerate(sorted({r for s in states for r in s["ref"]}))}
    hyps = {h: i for i, h in enumerate(sorted({h for s in states for h in s["hyp"]}))}
    right = 0.0
    if refs and hyps:
        shared = np.zeros((len(refs), len(hyps)))
        for s in states:
            shared[np.ix_([refs[x] for x in s["ref"]], [hyps[x] for x in s["hyp"]])] += s["sec"]
        right = _best_total(shared)
    return (
        float((n_ref * sec).sum()),
        float((np.maximum(n_ref - n_hyp, 0) * sec).sum()),
        float((np.maximum(n_hyp - n_ref, 0) * sec).sum()),
        float((np.minimum(n_ref, n_hyp) * sec).sum()) - right,
    )


def active_speakers(
    reference: DataFrame,
    hypothesis: DataFrame,
    keys: Sequence[str] = ("file_id",),
    collar: float = 0.25,
    skip_overlap: bool = True,
    width: float = PIECE_SEC,
) -> DataFrame:
    """Scored seconds per file and pair of active speaker sets ``ref`` and ``hyp``.

    Time around each reference border (half the collar on both sides) is not scored, nor, with
    ``skip_overlap``, time with two reference speakers. The file is cut at every border, inside
    time pieces; copies of a turn count once.
    """

    def turns(df, side):
        return df.where("end > start").select(
            *keys,
            F.lit(side).alias("side"),
            F.col("speaker").cast("string").alias("speaker"),
            F.col("start").cast("double").alias("s"),
            F.col("end").cast("double").alias("e"),
        )

    ref = turns(reference, "r")
    spans = ref.unionByName(turns(hypothesis, "h"))
    if collar > 0:
        border = ref.select(*keys, F.explode(F.array("s", "e")).alias("t"))
        spans = spans.unionByName(
            border.select(
                *keys,
                F.lit("x").alias("side"),
                F.lit("").alias("speaker"),
                (F.col("t") - collar / 2).alias("s"),
                (F.col("t") + collar / 2).alias("e"),
            )
        )
    spans = spans.withColumn("piece", F.explode(_pieces(F.col("s"), F.col("e"), width))).withColumns(
        {
            "s": F.greatest(F.col("s"), F.col("piece") * width),
            "e": F.least(F.col("e"), (F.col("piece") + 1) * width),
        }
    )
    spans = spans.where("e > s").distinct()
    place = [*keys, "piece"]
    cuts = spans.select(*place, F.explode(F.array("s", "e")).alias("t0")).distinct()
    order = W.partitionBy(*place).orderBy("t0")
    cells = cuts.withColumn("t1", F.lead("t0").over(order)).where("t1 is not null")
    covered = cells.join(spans, place).where("s <= t0 and t0 < e")

    def who(side):
        return F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("speaker"))))

    active = covered.groupBy(*place, "t0", "t1").agg(
        who("r").alias("ref"), who("h").alias("hyp"), F.count_if(F.col("side") == "x").alias("cut")
    )
    scored = active.where("cut = 0 and size(ref) + size(hyp) > 0")
    if skip_overlap:
        scored = scored.where("size(ref) <= 1")
    return scored.groupBy(*keys, "ref", "hyp").agg(F.sum(F.col("t1") - F.col("t0")).alias("sec"))


def diarization_errors(
    reference: DataFrame,
    hypothesis: DataFrame,
    keys: Sequence[str] = ("file_id",),
    **options,
) -> DataFrame:
    """Seconds of missed, false-alarm and confused speech per file, under the best speaker mapping.

    Only the seconds per pair of speaker sets of one file reach the mapping step.
    """
    states = active_speakers(reference, hypothesis, keys, **options)
    names = [n.split()[0] for n in _ERRORS.split(", ")]

    def errors(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_file_errors(f) for f in files], columns=names)

    cell = F.struct("ref", "hyp", "sec")
    per_file = states.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("states"))
    return per_file.select(*keys, F.pandas_udf(errors, _ERRORS)("states").alias("e")).select(*keys, "e.*")


def error_percent(errors: DataFrame) -> DataFrame:
    """DER and its parts in percent of reference speech."""
    wrong = F.col("missed") + F.col("false_alarm") + F.col("confusion")

    def percent(part):
        return exact_round(F.coalesce(F.try_divide(part, F.col("total")), F.lit(0.0)) * 100, 2)

    empty = F.when(wrong == 0, 0.0).otherwise(100.0)
    return errors.withColumns(
        {
            "DER": F.when(F.col("total") == 0, empty).otherwise(percent(wrong)),
            "MS": percent(F.col("missed")),
            "FA": percent(F.col("false_alarm")),
            "SC": percent(F.col("confusion")),
        }
    ).drop("total", "missed", "false_alarm", "confusion")


def system_errors(reference: DataFrame, hypotheses: DataFrame, **options) -> DataFrame:
    """DER per system and file, for files that both the truth and the system have.

    ``hypotheses`` has ``(system, file_id, start, end, speaker)``.
    """
    pairs = hypotheses.select("system", "file_id").distinct()
    truth = reference.join(pairs, "file_id")
    found = hypotheses.join(reference.select("file_id").distinct(), "file_id", "left_semi")
    return error_percent(diarization_errors(truth, found, ["system", "file_id"], **options))


def system_table(errors: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean error per system, file count and real-time factor.

    ``runs`` has ``(system, file_id, time, audio_sec)``, one row per processed file.
    """
    audio = F.sum("audio_sec")
    speed = runs.groupBy("system").agg(
        F.count_distinct("file_id").alias("n_files"),
        exact_round(F.when(audio > 0, F.sum("time") / audio), 4).alias("RTF"),
    )
    means = errors.groupBy("system").agg(
        *[exact_round(F.avg(m), 2).alias(m) for m in ("DER", "MS", "FA", "SC")]
    )
    return speed.join(means, "system", "left")
