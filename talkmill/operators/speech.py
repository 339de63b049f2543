"""Word and character error rates of speech recognition, on result tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from talkmill.functions.columns import ColumnLike, col
from talkmill.functions.numbers import exact_round
from talkmill.functions.text import normalise_for_wer

FIRST_BAND, BLOCK = 64, 128  # edits looked for at first; columns that share a window of rows


def _words(text: ColumnLike) -> Column:
    c = col(text)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance, by a band of bits that widens until its answer is proven.

    Equal ends are cut off first. The table is crossed from the diagonal of one corner to that of the other, as far apart as the
    lengths differ. A path that leaves the space between them by some rows goes that far twice, so one of ``k`` edits stays within
    half of what ``k`` is above the difference. A band that wide gives an alignment, so never less than the distance, and the
    distance itself if that is at most ``k``; one that is made for the last answer is always enough.
    """
    begin, end = 0, min(len(a), len(b))
    while begin < end and a[begin] == b[begin]:
        begin += 1
    last = 0
    while last < end - begin and a[len(a) - 1 - last] == b[len(b) - 1 - last]:
        last += 1
    a, b = a[begin : len(a) - last], b[begin : len(b) - last]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, bytearray((len(a) + 7) // 8))[i >> 3] |= 1 << (i & 7)
    masks = {x: int.from_bytes(bits, "little") for x, bits in where.items()}
    k = max(FIRST_BAND, len(a) - len(b), len(a) // 8)
    found = _banded(masks, len(a), b, k)
    while found > k:
        k = min(found, 4 * k)
        found = _banded(masks, len(a), b, k)
    return found


def _banded(masks: dict, rows: int, b: Sequence, k: int) -> int:
    """Cost of the best alignment whose steps stay about where one of ``k`` edits can go.

    Columns of the table are kept as two bit sets: where they rise and where they fall (Myers 1999, Hyyro 2003). A block of
    columns sees a window of rows; a cell beyond it counts one more than its neighbour inside, as an insertion or deletion would.
    """
    rise = fall = low = high = top = 0
    more = rows - len(b)
    beyond = (k - more) // 2
    for begin in range(0, len(b), BLOCK):
        part = b[begin : begin + BLOCK]
        first, after = max(0, begin - beyond), min(rows, begin + len(part) + more + beyond)
        gone = (1 << (first - low)) - 1  # rows that leave the window at its top
        top += (rise & gone).bit_count() - (fall & gone).bit_count()
        rise = (rise >> (first - low)) | (((1 << (after - high)) - 1) << (high - first))
        fall >>= first - low
        low, high = first, after
        full = (1 << (high - low)) - 1
        wide = 2 * full + 1  # what is flipped by it stays positive, which is quicker than a complement
        seen: dict = {}
        for x in part:
            equal = seen.get(x)
            if equal is None:
                equal = seen[x] = (masks.get(x, 0) >> low) & full
            equal |= fall
            diagonal = (((rise + (equal & rise)) ^ rise) | equal) & full
            up = ((fall | ((rise | diagonal) ^ full)) << 1) | 1
            fall = up & diagonal
            rise = (((rise & diagonal) << 1) | ((up | diagonal) ^ wide)) & full
        top += len(part)
    return top + rise.bit_count() - fall.bit_count() + rows - high


@F.arrow_udf(IntegerType())
def _char_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in pairs], pa.int32())


@F.arrow_udf(IntegerType())
def _word_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = ((x if x is None else x.split(" ") if x else [], y if y is None else y.split(" ") if y else []) for x, y in zip(a.to_pylist(), b.to_pylist()))
    return pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in pairs], pa.int32())


def word_edits(reference: ColumnLike, hypothesis: ColumnLike) -> Column:
    """Edit distance in words between two normalised texts of any length."""
    return _word_edits(col(reference), col(hypothesis))


def char_edits(reference: ColumnLike, hypothesis: ColumnLike) -> Column:
    """Edit distance in characters between two texts of any length."""
    return _char_edits(col(reference), col(hypothesis))


def scored_segments(hypotheses: DataFrame, truth: DataFrame) -> DataFrame:
    """Edits and reference lengths per model and segment; empty references are left out.

    ``hypotheses`` has ``(model, seg_id, hypothesis, time)``, ``truth`` has ``(seg_id, text, ...)``.
    """
    ref = truth.withColumn("reference", normalise_for_wer("text")).where("reference <> ''").drop("text")
    hyp = hypotheses.withColumn("hypothesis", normalise_for_wer("hypothesis"))
    joined = hyp.join(ref, "seg_id")
    return joined.withColumns(
        {
            "word_edits": word_edits("reference", "hypothesis"),
            "ref_words": F.size(_words("reference")),
            "char_edits": char_edits("reference", "hypothesis"),
            "ref_chars": F.char_length("reference"),
        }
    )


def _ratio(edits: str, units: str) -> Column:
    return F.try_divide(F.sum(edits).cast("double"), F.sum(units).cast("double"))


def error_rates(scored: DataFrame, audio_sec: str | None = "audio_sec") -> DataFrame:
    """Corpus WER and CER in percent, real-time factor and sums per model.

    The rates divide summed edits by summed reference units; they are not means of rows.
    """
    has_audio = audio_sec is not None and audio_sec in scored.columns
    audio = F.sum(audio_sec) if has_audio else F.lit(0.0)
    rtf = F.when(audio > 0, F.sum("time") / audio)
    return scored.groupBy("model").agg(
        exact_round(_ratio("word_edits", "ref_words") * 100, 2).alias("WER"),
        exact_round(_ratio("char_edits", "ref_chars") * 100, 2).alias("CER"),
        exact_round(rtf, 4).alias("RTF"),
        F.count("*").alias("n_samples"),
        exact_round(audio, 1).alias("total_audio_sec"),
        exact_round(F.sum("time"), 1).alias("total_inference_sec"),
    )


def segment_report(scored: DataFrame) -> DataFrame:
    """WER in percent per segment."""
    wer = F.col("word_edits").cast("double") / F.col("ref_words")
    keep = [c for c in ("file", "start_ms") if c in scored.columns]
    return scored.select(
        "model",
        "seg_id",
        *keep,
        "reference",
        "hypothesis",
        exact_round(wer * 100, 1).alias("wer"),
        exact_round("time", 3).alias("inference_sec"),
    )


def worst_segments(scored: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` segments with the highest WER per model.

    Ranks are limited inside each task before the shuffle.
    """
    wer = F.col("word_edits").cast("double") / F.col("ref_words")
    order = W.partitionBy("model").orderBy(
        F.desc("wer"), F.desc("reference"), F.desc("hypothesis"), F.desc("seg_id")
    )
    return (
        scored.withColumn("wer", wer)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("model", "rank", "seg_id", "wer", "reference", "hypothesis")
    )
