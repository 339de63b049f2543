"""Column helpers: bound values, prefix sums and places of pattern matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP = 64  # prefix sums are taken in groups, so that long arrays cost little more than their length


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; a lambda would compute a plain column for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """Sums of an array of integers up to and with each element."""

    def of(a: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(a) - 1)
        starts = F.sequence(F.lit(0), F.size(a) - 1, F.lit(_GROUP))
        totals = F.transform(starts, lambda s: _sum(F.slice(a, s + 1, F.lit(_GROUP))))
        before = F.aggregate(
            totals, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
        )

        def at(b: Column) -> Column:
            return F.transform(
                places,
                lambda i: F.get(b, F.floor(i / _GROUP).cast("int"))
                + _sum(F.slice(a, i - i % _GROUP + 1, i % _GROUP + 1)),
            )

        return let(before, at)

    return F.when(F.size(values) > 0, let(values, of)).otherwise(F.array().cast("array<int>"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern: array of ``struct<start, end, value>``.

    Places count code points from 0, the end is exclusive. ``value`` is the match, or one of its groups. What lies
    between the matches is what ``split`` returns, so the places are sums of lengths. Texts without a match
    are only searched once.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(b: Column) -> Column:
        found, kept, gaps = b["whole"], b["value"], b["between"]
        steps = F.transform(
            found,
            lambda x, i: F.get(gaps, i) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0),
        )
        return let(
            prefix_sums(steps),
            lambda starts: F.transform(
                starts,
                lambda s, i: F.struct(
                    s.alias("start"), (s + F.length(F.get(found, i))).alias("end"), F.get(kept, i).alias("value")
                ),
            ),
        )

    bound = F.struct(whole.alias("whole"), value.alias("value"), between.alias("between"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(bound, placed)).otherwise(none)
