"""Removal of personal data from text columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.functions import fixed
from talkmill.functions.columns import ColumnLike, bind, col, literal_replacement, sub, unicode_re
from talkmill.session import checked_broadcast

TOKEN_PATTERN = "[а-яёА-ЯЁ]{2,}"


def _link(c: Column) -> Column:
    return c.contains("://") | c.contains("www.")


def _at_sign(c: Column) -> Column:
    return c.contains("@")


def _spoken_at(c: Column) -> Column:
    return c.rlike(unicode_re(r"\s(?:собака|доллар|at|эт)\s", ignore_case=True))


def _digit(c: Column) -> Column:
    return c.rlike(r"(?U)\d")


def _cyrillic(c: Column) -> Column:
    """The second range holds letter forms that equal plain ones when case is ignored."""
    return c.rlike("[\u0400-\u052f\u1c80-\u1c8f]")


# What a text must hold for a rule of ``fixed.REDACTIONS`` to match at all. No placeholder brings it into a text.
NEEDS = (_link, _at_sign, _spoken_at, _digit, _digit, _cyrillic, _digit, _digit, _digit)

_MAIL = r"[a-zA-Z0-9_.+\-]+@"
_FIRST = "[#iI\u0130\u0131№\u0400-\u04ff\u1c80-\u1c8f]"  # first characters of a contract word, and what equals them without case


def _quick(kind: str, pattern: str) -> str:
    """The same matches with fewer tries: a mail name from its start or the last match on, a contract word at a fitting character."""
    if kind == "email" and pattern.startswith(_MAIL):
        name = r"(?:\G|(?<![a-zA-Z0-9_.+\-]))[a-zA-Z0-9_.+\-]++@"
        return name + pattern[len(_MAIL) :]
    return f"(?=(?-iu:{_FIRST})){pattern}" if kind == "contract" else pattern


def _where(c: Column, needs: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` for texts that can match; the others are only looked through once."""
    return bind(c, lambda x: F.when(needs(x), change(x)).otherwise(x))


def redact_pii(
    text: ColumnLike,
    placeholders: Mapping[str, str] = fixed.PLACEHOLDERS,
    kinds: Sequence[str] | None = None,
) -> Column:
    """Replace links, mail addresses, phones, IPs, contract and long numbers, in fixed order."""

    def changed(c: Column, rules) -> Column:
        for kind, pattern, ignore_case in rules:
            c = sub(c, _quick(kind, pattern), literal_replacement(placeholders[kind]), ignore_case)
        return c

    out = col(text)
    wanted = [(needs, rule) for needs, rule in zip(NEEDS, fixed.REDACTIONS, strict=True) if kinds is None or rule[0] in kinds]
    for needs, group in groupby(wanted, lambda pair: pair[0]):
        rules = [rule for _, rule in group]
        out = _where(out, needs, lambda c: changed(c, rules))  # noqa: B023
    return out


def redact_one(text: ColumnLike, rule: int) -> Column:
    """Apply a single rule of the redaction list."""
    kind, pattern, ignore_case = fixed.REDACTIONS[rule]
    return _where(col(text), NEEDS[rule], lambda c: sub(c, _quick(kind, pattern), literal_replacement(fixed.PLACEHOLDERS[kind]), ignore_case))


def redact_legal_orgs(text: ColumnLike) -> Column:
    return sub(text, fixed.ORG_LEGAL, fixed.PLACEHOLDERS["ORG"], ignore_case=True)


def redact_triggered_orgs(text: ColumnLike) -> Column:
    """Replace the capitalised name after words such as "company"; the word itself stays."""
    pattern = r"(\b(?:" + fixed.ORG_TRIGGERS + r")\s+[«\"]?)(" + fixed.ORG_NAME + r")([»\"]?)"
    return sub(text, pattern, "$1" + fixed.PLACEHOLDERS["ORG"] + "$3")


def redact_orgs(text: ColumnLike) -> Column:
    return _where(col(text), _cyrillic, lambda c: redact_triggered_orgs(redact_legal_orgs(c)))


def _any_of(words: Sequence[str]) -> str:
    """Alternation grouped by first letter, so that a word start rules out most of it at once."""
    groups: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        groups.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + "(?:" + "|".join(map(re.escape, rest)) + ")" for c, rest in groups.items()]
    return f"(?:{'|'.join(parts)})"


def redact_names(text: ColumnLike, names: Sequence[str] = tuple(fixed.FIRST_NAMES)) -> Column:
    """Replace whole Cyrillic words whose lower case is a known first name."""
    pattern = "(?<![а-яё])(?=[а-яё])" + _any_of(names) + "(?![а-яё])"
    return _where(col(text), _cyrillic, lambda c: sub(c, pattern, fixed.PLACEHOLDERS["PER"], ignore_case=True))


def redact_spans(
    df: DataFrame,
    spans: DataFrame,
    text: str = "text",
    row_id: str = "row_id",
    out: str | None = None,
) -> DataFrame:
    """Replace entity spans ``(row_id, start, end, type)`` by their placeholder.

    Spans are applied from right to left so that offsets stay valid. Types outside the entity
    table are ignored. The spans of one text meet in one array, never those of several.
    """
    kind = F.create_map(
        *[F.lit(x) for t, k in fixed.ENTITY_KINDS.items() for x in (t, fixed.PLACEHOLDERS[k])]
    )
    marks = (
        spans.select(row_id, "start", "end", F.element_at(kind, F.col("type")).alias("token"))
        .where("token is not null")
        .groupBy(row_id)
        .agg(F.collect_list(F.struct("start", "end", "token")).alias("__marks"))
    )
    redacted = F.aggregate(
        F.sort_array(F.coalesce("__marks", F.array()), asc=False),
        F.col(text),
        lambda acc, m: F.overlay(
            acc, m["token"], (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")
        ),
    )
    joined = df.join(marks, row_id, "left")
    return joined.withColumn(out or text, redacted).drop("__marks")


def replace_words(
    df: DataFrame,
    dictionary: DataFrame,
    text: str = "text",
    out: str | None = None,
    token: str = TOKEN_PATTERN,
    protected: Sequence[str] = tuple(fixed.PLACEHOLDERS.values()),
) -> DataFrame:
    """Replace words by a dictionary ``(form, replacement)``; all else stays in place.

    Words inside a protected token (a placeholder) are skipped. Forms are matched in lower case. A
    text is known by its hash, so copies are looked up once and no row needs a key of its own. Only
    the distinct words of a text are shuffled to the dictionary, and the words found come back as
    one map per text; the text itself is rebuilt in place. The dictionary may be of any size.
    """
    out = out or text
    keep = _any_of(protected) if protected else ""
    pattern = unicode_re(f"({keep})|({token})" if keep else f"(?!)()|({token})")
    pairs = dictionary.select(F.lower("form").alias("__form"), "replacement").groupBy("__form").agg(
        F.min("replacement").alias("__new")
    )
    rows = df.withColumn("__key", F.sha2(F.col(text), 256))
    words = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)), F.lower)
    asked = rows.select("__key", F.explode(F.array_distinct(words)).alias("__form")).where("__form <> ''")
    # A small dictionary meets the words before any shuffle, so only words found are shuffled.
    hits = (
        asked.join(checked_broadcast(pairs), "__form")
        .distinct()
        .groupBy("__key")
        .agg(F.map_from_entries(F.collect_list(F.struct("__form", "__new"))).alias("__map"))
    )
    joined = rows.join(hits, "__key", "left")

    def rebuilt(b: Column) -> Column:
        def swapped(match: Column, i: Column) -> Column:
            word = F.get(b["words"], i)
            new = F.coalesce(F.try_element_at(F.col("__map"), F.lower(word)), match)
            return F.concat(F.when(word == "", match).otherwise(new), F.get(b["between"], i + 1))

        return F.concat(F.get(b["between"], F.lit(0)), F.array_join(F.transform(b["matches"], swapped), ""))

    found = F.struct(
        F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("matches"),
        F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)).alias("words"),
        F.split(F.col(text), pattern, -1).alias("between"),
    )
    new = F.when(F.col("__map").isNull(), F.col(text)).otherwise(bind(found, rebuilt))
    kept = [c for c in df.columns if c != out]
    position = df.columns.index(out) if out in df.columns else len(kept)
    columns = [F.col(f"`{c}`") for c in kept]
    columns.insert(position, new.alias(out))
    return joined.select(*columns)


def redact_names_by_lemma(
    df: DataFrame,
    lemmas: DataFrame,
    text: str = "text",
    names: Sequence[str] = tuple(fixed.FIRST_NAMES),
) -> DataFrame:
    """Replace words whose lemma is a first name; ``lemmas`` holds ``(form, lemma)``.

    A form without an entry counts as its own lemma.
    """
    session = df.sparkSession
    own = session.createDataFrame([(n, n) for n in names], "form string, lemma string")
    known = own.join(lemmas.select(F.lower("form").alias("form")), "form", "left_anti")
    hits = lemmas.select("form", "lemma").unionByName(known).where(F.col("lemma").isin(list(names)))
    table = hits.select("form", F.lit(fixed.PLACEHOLDERS["PER"]).alias("replacement"))
    return replace_words(df, table, text)


def lemmatise(df: DataFrame, lemmas: DataFrame, text: str = "text") -> DataFrame:
    """Replace words by their lemma; punctuation, spacing and placeholders stay."""
    table = lemmas.select("form", F.col("lemma").alias("replacement"))
    return replace_words(df, table, text, token=r"\w+")


def redaction_flags(text: ColumnLike) -> dict[str, Column]:
    """One boolean per placeholder kind of the raw text, for reports."""
    hits: dict[str, Column] = {}
    for kind, pattern, ignore_case in fixed.REDACTIONS:
        found = col(text).rlike(unicode_re(pattern, ignore_case))
        hits[kind] = hits[kind] | found if kind in hits else found
    return hits
