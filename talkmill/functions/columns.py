"""Small column helpers shared by the function modules."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.strip() and str.split() see it.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f]"
# What ``\w`` stands for in Python: letters, numbers and underscore, but no combining marks, which Java adds.
WORD = r"\p{L}\p{N}_"

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(256)
def _python_words(pattern: str) -> str:
    """The pattern with ``\\w`` written out, inside a character class and outside."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            piece = pattern[i : i + 2]
            out.append((WORD if inside else f"[{WORD}]") if piece == r"\w" else piece)
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


def unicode_re(pattern: str, ignore_case: bool = False) -> str:
    """Java pattern whose classes, borders and case rules are Unicode, with Python's ``\\w``."""
    return ("(?iuU)" if ignore_case else "(?U)") + _python_words(pattern)


def literal_array(values: Sequence, kind: str) -> Column:
    """Array literal of any length; ``kind`` is the type of its elements."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def sub(c: ColumnLike, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(
        col(c), F.lit(unicode_re(pattern, ignore_case)), F.lit(replacement)
    )


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def literal_replacement(text: str) -> str:
    """Escape what a Java replacement string would read as a group reference."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def strip(c: ColumnLike) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c: ColumnLike) -> Column:
    return strip(F.coalesce(col(c), F.lit(""))) == ""


def collapse_spaces(c: ColumnLike) -> Column:
    """Runs of white space as one space, without those at the ends. A single space is no match, as it stays what it is."""
    return strip(sub(c, f"[{SPACE}&&[^ ]]{SPACE}*| {SPACE}+", " "))


def unit_hash(*parts) -> Column:
    """Number in [0, 1) that depends only on ``parts``."""
    key = F.concat_ws("\x1f", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
