"""Numbers: softmax, safe division, argmax and decimal rounding of the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.columns import ColumnLike, bind, col

_HALF = 1 << 30
_MASK = _HALF - 1


def _scaled(value: Column, digits: int) -> tuple[Column, Column]:
    """``(negative, n)`` with ``n = round(abs(value) * 10**digits)``, ties to the even digit.

    The built-in rounding works on the shortest decimal text of a double (0.35 -> 0.4). Here the
    exact binary fraction is taken apart into two 30-bit parts, so 0.35, which is a little less
    than its text says, gives 0.3, as printf-like formatting does.
    """
    base = 10**digits
    size = F.abs(value)
    whole = F.floor(size)
    fraction = size - whole
    high = F.floor(fraction * _HALF)
    rest = (fraction * _HALF - high) * _HALF
    low = F.floor(rest)
    top = high * base + F.shiftright(low * base, 30)
    digit = F.shiftright(top, 30)
    left = top.bitwiseAND(_MASK) * _HALF + (low * base).bitwiseAND(_MASK)
    half = _HALF * _HALF // 2
    up = (left > half) | ((left == half) & ((rest > low) | (digit % 2 == 1)))
    return value < 0, whole * base + digit + up.cast("long")


def exact_round(value: ColumnLike, digits: int) -> Column:
    c = col(value).cast("double")
    negative, n = _scaled(c, digits)
    rounded = n / F.lit(float(10**digits))
    return F.when(F.isnan(c), c).otherwise(F.when(negative, -rounded).otherwise(rounded))


def fixed_text(value: ColumnLike, digits: int) -> Column:
    """Number as text with a fixed count of decimals."""
    negative, n = _scaled(col(value).cast("double"), digits)
    base = 10**digits
    text = F.format_string(f"%d.%0{digits}d", F.floor(n / F.lit(base)), n % base)
    return F.when(negative, F.concat(F.lit("-"), text)).otherwise(text)


def safe_divide(a: ColumnLike, b: ColumnLike) -> Column:
    """Quotient; 0 when the divisor is 0."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def softmax(values: ColumnLike, temperature: Column | float = 1.0) -> Column:
    """Softmax over an array of scores, shifted by the largest one."""
    v = col(values)
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powers = bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp((x - top) / t)))
    shares = bind(powers, lambda ps: bind(array_sum(ps), lambda total: F.transform(ps, lambda p: p / total)))
    return F.when(v.isNotNull(), shares)


def array_sum(values: ColumnLike) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda acc, x: acc + x)


def margin_columns(score: ColumnLike, negative: str, positive: str) -> Column:
    """One margin as two ``struct<label, score>``: ``-s`` and ``s``."""
    s = col(score).cast("double")
    return F.array(
        F.struct(F.lit(negative).alias("label"), (-s).alias("score")),
        F.struct(F.lit(positive).alias("label"), s.alias("score")),
    )


def margin_confidence(scores: ColumnLike) -> Column:
    """Size of the only margin, or the largest of several; NaN without scores."""
    v = col(scores)
    return (
        F.when(F.size(v) == 1, F.abs(F.element_at(v, 1)))
        .when(F.size(v) > 1, F.array_max(v))
        .otherwise(F.lit(float("nan")))
    )


def top_label(label: ColumnLike, value: ColumnLike) -> Column:
    """Aggregate: label with the largest value, the first in sort order among equals."""
    return F.min_by(col(label), F.struct((-col(value)).alias("v"), col(label).alias("l")))
