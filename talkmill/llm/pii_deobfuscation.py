"""Personal data in plain and disguised form, with spans that point into the text as it is.

A text is searched twice: as it is, and after a chain of transducers that undo disguises. Each transducer
replaces pieces of the text and keeps, for every character it writes, the span of source characters it
stands for, so a match in the normalised text maps back to the source whatever the steps changed in length.

Transducers, in order: letters, digits and signs that look like ASCII ones, and characters without width;
three or more spelled digits in a row (English, German, French, Spanish), with ``plus`` before them; ``(at)``
and ``[dot]`` in brackets, and ``name at host dot tld`` and ``10 dot 0 dot 0 dot 1`` without. A match of the
normalised text is added unless a plain match of its kind covers it; plain matches always stay.

Null texts count as empty. Places count code points. A text of any length is searched whole in time
proportional to its length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match ends with its digits, so no match begins inside a run of them.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Fixed characters that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "А": "A", "В": "B", "С": "C",
    "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y",
    "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ʟ": "l", "․": ".", "‧": ".", "。": ".", "﹒": ".", "｡": ".", "﹫": "@",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-", "\ufe63": "-", "\ufe62": "+",
    "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u3000": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Fixed words for the digits 0 to 9.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3",
    "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3",
    "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Fixed last labels that a spoken address may have.
TLDS = frozenset("com org net edu gov info biz io co us uk de fr es it ru eu ch at nl pl ca au example test".split())
_AT = "at|arroba|ät|chez"
_DOT = "dot|punto|punkt|point"


def _looks() -> dict[str, str]:
    table = dict(LOOKALIKES)
    table |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}  # full width forms
    for first in (0x1D400, 0x1D434, 0x1D468, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670):  # mathematical letters
        table |= {chr(first + k): chr((65 if k < 26 else 71) + k) for k in range(52)}
    table |= {chr(0x1D7CE + k): str(k % 10) for k in range(50)}  # mathematical digits
    return table | dict.fromkeys(INVISIBLE, "")


_TABLE = _looks()
_FOREIGN = re.compile("[\xa0\xad\u0100-\U0010ffff]")  # a plain range, fast to search; all of the table lies in it
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:(plus)[\x20-]+)?((?:{_WORD})(?:[\x20,-]{{1,2}}(?:{_WORD}|[0-9])){{2,}})\b", re.I)
_TWO_SPELLED = re.compile(rf"\b(?:{_WORD})[\x20,-]{{1,2}}(?:{_WORD}|[0-9])", re.I)  # every match of _SPELLED holds one
_ONE_WORD = re.compile(rf"{_WORD}|[0-9]", re.I)
_MARK_AT = re.compile(rf"\x20?[(\[{{<]\x20?(?:{_AT}|@)\x20?[)\]}}>]\x20?", re.I)
_MARK_DOT = re.compile(rf"\x20?[(\[{{<]\x20?(?:{_DOT}|\.)\x20?[)\]}}>]\x20?", re.I)
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
_SAID = re.compile(
    rf"(?<![A-Za-z0-9._%+-])({_NAME}(?:(?:\.|\x20(?:{_DOT})\x20){_NAME}){{0,4}})(\x20(?:{_AT})\x20|@)"
    rf"([A-Za-z0-9-]{{1,64}}(?:(?:\.|\x20(?:{_DOT})\x20)[A-Za-z0-9-]{{2,64}}){{1,4}})(?![A-Za-z0-9-])",
    re.I,
)
_SAID_DOT = re.compile(rf"\x20(?:{_DOT})\x20", re.I)
_SAID_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:\x20(?:{_DOT})\x20[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_HINT_DOT = re.compile(rf"[\x20(\[{{<](?:{_DOT})[\x20)\]}}>]|[(\[{{<]\x20?(?:[.@]|(?:{_AT})\x20?[)\]}}>])", re.I)
# What else _SAID accepts: a spoken sign before a host with a plain dot.
_HINT_HOST = re.compile(rf"\x20(?:{_AT})\x20[a-z0-9-]{{1,64}}\.[a-z0-9-]{{2}}", re.I)


def _emails(text: str):
    at, begin = text.find("@"), 0
    while at >= 0:
        start = at
        while start > begin and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            begin = domain.end()
        at = text.find("@", max(at + 1, begin))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(piece: str) -> str:
    return "".join(c for c in piece if "0" <= c <= "9")


def detect(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by kind and place."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


class Mapped:
    """A rewritten text and, for each of its characters, the span of source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.start = text, np.arange(len(text))
        self.end = self.start + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans of the present text, given in order and apart from each other."""
        if not edits:
            return
        texts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        texts.append(self.text[at:])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])
        self.text = "".join(texts)

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


# Letters that match an ASCII letter where case is ignored, but whose lower case is not that letter.
_CASES = str.maketrans({"\u017f": "s", "\u0130": "i", "\u0131": "i", "\u212a": "k"})


def _unspelled(m: re.Match) -> str:
    words = [w.translate(_CASES).lower() for w in _ONE_WORD.findall(m[2])]
    return ("+" if m[1] else "") + "".join(w if w.isdigit() else DIGIT_WORDS[w] for w in words)


def _spells(text: str) -> bool:
    """Whether two digit words or a digit word and a digit may follow each other; a cheap look before the pattern."""
    return _TWO_SPELLED.search(text) is not None


def _said(m: re.Match) -> str:
    spoken = "@" not in m[2] or _SAID_DOT.search(m[3])
    if spoken and m[3].rpartition(".")[2].rpartition(" ")[2].lower() not in TLDS:
        return m[0]
    return _SAID_DOT.sub(".", m[1]) + "@" + _SAID_DOT.sub(".", m[3])


def _hints(text: str) -> bool:
    return bool(_HINT_DOT.search(text) or _HINT_HOST.search(text))


def normalised(text: str) -> Mapped | None:
    """The text with all disguises undone; None if it has none."""
    foreign = [] if text.isascii() else [m for m in _FOREIGN.finditer(text) if m[0] in _TABLE]
    if not foreign and not _hints(text) and not _spells(text):
        return None
    out = Mapped(text)
    out.rewrite([(m.start(), m.end(), _TABLE[m[0]]) for m in foreign])
    if _spells(out.text):
        out.rewrite([(m.start(), m.end(), _unspelled(m)) for m in _SPELLED.finditer(out.text)])
    if _hints(out.text):
        for pattern, sign in ((_MARK_AT, "@"), (_MARK_DOT, ".")):
            out.rewrite([(m.start(), m.end(), sign) for m in pattern.finditer(out.text)])
        out.rewrite([(m.start(), m.end(), _said(m)) for m in _SAID.finditer(out.text)])
        out.rewrite([(m.start(), m.end(), _SAID_DOT.sub(".", m[0])) for m in _SAID_IP.finditer(out.text)])
    return out if out.text != text else None


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the fixed patterns, and all spans with those that only the normalised text shows."""
    base = detect(text or "")
    hidden = normalised(text) if text else None
    if hidden is None:
        return base, base
    added = set()
    for kind, a, b in detect(hidden.text):
        a, b = hidden.source(a, b)
        if not any(k == kind and s <= a and b <= e for k, s, e in base):
            added.add((kind, a, b))
    return base, sorted([*base, *added])


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SPARK_SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")]))


@F.arrow_udf(T.StructType([T.StructField(n, _SPARK_SPAN) for n in ("base", "found")]))
def _search(texts: pa.Array) -> pa.Array:
    pairs = [find(t.as_py()) for t in texts]
    columns = [
        pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in p[side]] for p in pairs], _SPAN) for side in (0, 1)
    ]
    return pa.StructArray.from_arrays(columns, names=["base", "found"])


def with_spans(df: DataFrame, text: str = "text", base: str = "base", found: str = "found") -> DataFrame:
    """Add the spans of every text: arrays of ``struct<kind, start, end>``, kinds numbered as in ``KINDS``.

    Columns named like the new ones are replaced, all others stay.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (base, found)]
    rows = df.select(*kept, _search(F.col(f"`{text}`")).alias("__pii"))
    return rows.select(*kept, F.col("__pii.base").alias(base), F.col("__pii.found").alias(found))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
    )
