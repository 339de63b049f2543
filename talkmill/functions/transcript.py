"""Transcript lines from an array of segments ``struct<start, end, speaker, text>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.columns import ColumnLike, col, strip
from talkmill.functions.numbers import fixed_text

UNKNOWN = "UNKNOWN"


def _clock(seg: Column) -> Column:
    zero = F.lit(0.0)
    start, end = F.coalesce(seg["start"], zero), F.coalesce(seg["end"], zero)
    return F.concat(F.lit("["), fixed_text(start, 1), F.lit("-"), fixed_text(end, 1), F.lit("] "))


def _words(seg: Column) -> Column:
    return strip(F.coalesce(seg["text"], F.lit("")))


def plain_transcript(segments: ColumnLike) -> Column:
    return strip(F.array_join(F.transform(col(segments), _words), " "))


def timed_transcript(segments: ColumnLike) -> Column:
    lines = F.transform(col(segments), lambda s: F.concat(_clock(s), _words(s)))
    return F.array_join(lines, " | ")


def speaker_transcript(segments: ColumnLike) -> Column:
    def line(s):
        speaker = F.coalesce(s["speaker"], F.lit(UNKNOWN))
        return F.concat(_clock(s), speaker, F.lit(": "), _words(s))

    return F.array_join(F.transform(col(segments), line), " | ")


def known_speakers(segments: ColumnLike) -> Column:
    """Speakers in order of first appearance, without missing and unknown ones."""
    names = F.transform(col(segments), lambda s: s["speaker"])
    return F.array_distinct(
        F.filter(names, lambda n: n.isNotNull() & (n != "") & (n != UNKNOWN))
    )


def role_of(
    speaker: Column,
    speakers: Column,
    first_is_caller: bool = True,
    caller: str = "звонящий",
    respondent: str = "ответчик",
) -> Column:
    """Role by order of appearance: first, second; later speakers keep their name."""
    first, second = (caller, respondent) if first_is_caller else (respondent, caller)
    place = F.array_position(speakers, F.coalesce(speaker, F.lit("")))
    return (
        F.when(place == 1, first).when(place == 2, second).when(place > 2, speaker).otherwise(UNKNOWN)
    )


def role_transcript(segments: ColumnLike, **roles) -> Column:
    speakers = known_speakers(segments)

    def line(s):
        who = role_of(s["speaker"], speakers, **roles)
        return F.concat(_clock(s), who, F.lit(": "), _words(s))

    return F.array_join(F.transform(col(segments), line), " | ")
