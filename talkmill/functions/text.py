"""Normalisation, noise removal, lengths, truncation and windows of text columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from talkmill.functions import fixed
from talkmill.functions.columns import (
    SPACE,
    WORD,
    ColumnLike,
    bind,
    col,
    collapse_spaces,
    is_blank,
    strip,
    sub,
    unicode_re,
    unit_hash,
)
from talkmill.functions.redact import redact_names, redact_orgs, redact_pii, redact_spans, lemmatise

# Characters that NFKC leaves alone and that never combine with a neighbour. Text made only of
# these needs no trip to Python: ASCII, quotes and dashes, Latin-1 letters, basic Cyrillic.
NFKC_STABLE = (
    r"\x00-\x7F\u00AB\u00BB\u00C0-\u00FF\u0400-\u0482\u048A-\u052F"
    r"\u2013\u2014\u2018\u2019\u201C-\u201E"
)
ERROR_PREFIX = "[TRANSCRIPTION_ERROR"
NO_SPACE = r"[^\s\x1c-\x1f]"
LAST_COUNTED = 500  # words that one pattern looks for
SLICE = 256  # texts that are held a second time while Python works on a batch


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """By slices, so that only a few texts are Python strings at a time."""

    def changed(part: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string())

    parts = [changed(texts.slice(begin, SLICE)) for begin in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _may_change(c: Column) -> Column:
    """Whether a text has a character outside the stable ones.

    Runs of the common single ranges are taken out first; a class of many ranges is slow to test
    and then sees only what is left.
    """
    for common in (r"[\x00-\x7F]+", r"[\u0400-\u0482]+", r"[\u00C0-\u00FF]+"):
        c = F.regexp_replace(c, common, "")
    return (c != "") & c.rlike(f"[^{NFKC_STABLE}]")


def nfkc(text: ColumnLike) -> Column:
    """Unicode NFKC. Only texts with a character that may change are sent to Python.

    ``text`` stands in the result twice; give it as a plain column where it is costly.
    """
    c = col(text)
    sent = bind(c, lambda x: F.when(_may_change(x), x))
    return F.coalesce(_nfkc(sent), c)


def normalise(
    text: ColumnLike, newline_to_space: bool = False, unicode_form: bool = True
) -> Column:
    """NFKC, no control characters, lower case, no technical symbols, short repeats, one space.

    Newlines and tabs are control characters and go away without leaving a space;
    ``newline_to_space`` turns them into spaces first.
    """
    c = nfkc(text) if unicode_form else col(text)
    if newline_to_space:
        c = F.regexp_replace(c, r"[\n\r\t]", " ")
    c = F.lower(F.regexp_replace(c, r"\p{C}", ""))
    c = F.regexp_replace(c, r"[\\|@#$%^&*=+<>~`]", " ")
    c = F.regexp_replace(c, r"([^\n])\1{3,}", "$1$1")
    return collapse_spaces(c)


def clean_text(
    text: ColumnLike, names: Sequence[str] = tuple(fixed.FIRST_NAMES), **normalise_options
) -> Column:
    """Whole per-row chain without entity spans: redact, hide organisations and names, normalise.

    Blank text gives ``""``; a text that reports a failed transcription passes unchanged.
    """
    c = col(text)
    done = normalise(redact_names(redact_orgs(redact_pii(c)), names), **normalise_options)
    return F.when(is_blank(c), "").when(c.startswith(ERROR_PREFIX), c).otherwise(done)


def clean_table(
    df: DataFrame,
    text: str = "text",
    row_id: str = "row_id",
    spans: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    names: Sequence[str] = tuple(fixed.FIRST_NAMES),
    **normalise_options,
) -> DataFrame:
    """As ``clean_text``, with entity spans (offsets into the redacted text) and lemmas as tables.

    The redacted text is a column of its own, so the chain runs once however often the Unicode step
    looks at it.
    """
    if spans is None and lemmas is None:
        hidden = redact_names(redact_orgs(redact_pii(text)), names)
        plain = is_blank(text) | F.col(text).startswith(ERROR_PREFIX)
        work = df.withColumn("__hidden", F.when(~plain, hidden))
        done = F.when(is_blank(text), "").when(F.col("__hidden").isNull(), F.col(text))
        return work.withColumn(text, done.otherwise(normalise("__hidden", **normalise_options))).drop("__hidden")
    work = df.withColumn("__raw", F.col(text)).withColumn(text, redact_pii(text))
    if spans is not None:
        work = redact_spans(work, spans, text, row_id)
    work = work.withColumn(text, redact_names(redact_orgs(text), names))
    if lemmas is not None:
        work = lemmatise(work, lemmas, text)
    done = normalise(text, **normalise_options)
    result = (
        F.when(is_blank("__raw"), "")
        .when(F.col("__raw").startswith(ERROR_PREFIX), F.col("__raw"))
        .otherwise(done)
    )
    return work.withColumn(text, result).drop("__raw")


def token_count(text: ColumnLike) -> Column:
    """Number of words between whitespace; 0 for blank text."""
    return F.regexp_count(col(text), F.lit(unicode_re(NO_SPACE + "+")))


def too_short(text: ColumnLike, min_tokens: int = 3) -> Column:
    """Whether a text has fewer than ``min_tokens`` words; a text is read up to the last word that decides it."""
    c = col(text)
    if not 0 < min_tokens <= LAST_COUNTED:
        return ~c.startswith(ERROR_PREFIX) & (token_count(c) < min_tokens)
    enough = unicode_re(rf"\A{SPACE}*+(?:{NO_SPACE}++{SPACE}++){{{min_tokens - 1}}}{NO_SPACE}")
    return ~c.startswith(ERROR_PREFIX) & ~c.rlike(enough)


def flag_text(flag: ColumnLike) -> Column:
    """Boolean as the text form that data-set files carry."""
    return F.when(col(flag), "True").otherwise("False")


def remove_noise(
    text: ColumnLike, phrases: Sequence[str] = tuple(fixed.NOISE_PHRASES)
) -> Column:
    """Replace filler phrases by a space, in order, then trim punctuation at both ends."""
    c = col(text)
    for phrase in phrases:
        c = sub(c, phrase, " ", ignore_case=True)
    return strip(sub(strip_ends(c), SPACE + "{2,}", " "))


def strip_ends(text: ColumnLike) -> Column:
    """Text without spaces and punctuation at both ends."""
    c = sub(text, r"^[\s\x1c-\x1f,.:;!?\-]+", "")
    return sub(c, r"[\s\x1c-\x1f,.:;!?\-]+\z", "")


def clean_filename(name: ColumnLike) -> Column:
    """Keep the leading call time; a name without one stays as it is."""
    c = col(name)
    stamp = F.regexp_extract(strip(c), r"^(\d{4}-\d{2}-\d{2}__\d{2}-\d{2}-\d{2})", 1)
    return F.when(stamp == "", c).otherwise(stamp)


def call_time(name: ColumnLike) -> Column:
    """Call time of a file name as a timestamp, null if the name has none."""
    return F.try_to_timestamp(
        F.substring(strip(name), 1, 20), F.lit("yyyy-MM-dd'__'HH-mm-ss")
    )


def normalise_for_wer(text: ColumnLike) -> Column:
    """Lower case, one letter for е and ё, and only Cyrillic, Latin, digits and single spaces."""
    c = F.translate(strip(F.lower(col(text))), "ё", "е")
    c = sub(c, r"[^\w\s]", " ")
    return collapse_spaces(sub(c, r"[^а-яa-z0-9\s]", " "))


def normalise_for_match(text: ColumnLike) -> Column:
    c = F.translate(strip(F.lower(col(text))), "ё", "е")
    return collapse_spaces(sub(c, r"[^\w\s]", " "))


def estimate_tokens(text: ColumnLike) -> Column:
    """Words plus single punctuation marks; at least 1 for text that is not blank."""
    c = col(text)
    n = F.regexp_count(c, F.lit(unicode_re(r"\w+|[^\w\s]")))
    return F.when(is_blank(c), 0).otherwise(F.greatest(n, F.lit(1)))


def keyword_flags(text: ColumnLike) -> tuple[Column, Column]:
    """1.0 / 0.0 for commercial and for technical wording."""
    c = col(text)
    return tuple(
        c.rlike(unicode_re(p, ignore_case=True)).cast("double")
        for p in (fixed.COMMERCIAL_WORDS, fixed.TECHNICAL_WORDS)
    )


def word_tokens(text: ColumnLike) -> Column:
    """Lower-case words of two or more characters."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"([{WORD}]{{2,}})"), F.lit(1))


def word_ngrams(tokens: ColumnLike, low: int = 1, high: int = 1) -> Column:
    """Word n-grams of all orders from ``low`` to ``high``, joined by one space.

    ``tokens`` may be an expression; it is computed once per row, not once per n-gram.
    """
    none = F.array().cast("array<string>")

    def all_orders(t):
        def grams(n):
            starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
            joined = F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
            return F.when(F.size(t) >= n, joined).otherwise(none)

        orders = [t if n == 1 else grams(n) for n in range(low, high + 1)]
        return orders[0] if len(orders) == 1 else F.concat(*orders)

    if high == 1 or isinstance(tokens, str):
        return all_orders(col(tokens))
    return bind(tokens, all_orders)


def term_counts(terms: ColumnLike) -> Column:
    """Distinct terms of an array and how often each occurs, as ``array<struct<term, tf>>``.

    Equal terms lie side by side after a sort, so a count is the distance between run starts. It
    needs no shuffle, because a text is a single row.
    """

    def starts(s):
        fresh = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return F.when(F.size(s) > 0, fresh).otherwise(F.array().cast("array<int>"))

    def counted(s):
        def cell(at):
            def one(begin, i):
                end = F.coalesce(F.get(at, i + 1), F.size(s))
                return F.struct(
                    F.get(s, begin).alias("term"), (end - begin).cast("long").alias("tf")
                )

            return F.transform(at, one)

        return bind(starts(s), cell)

    return bind(F.sort_array(col(terms)), counted)


def truncate_tokens(tokens: ColumnLike, max_length: int, strategy: str = "head") -> Column:
    """Keep ``max_length`` tokens: the head, or half head (rounded up) and half tail."""
    name = strategy.strip().lower().replace("-", "_")
    if name not in ("head", "head_tail", "middle_cut"):
        raise ValueError(f"unknown truncation '{strategy}': use head, head_tail or middle_cut")
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    t = col(tokens)
    if name == "head":
        return F.slice(t, 1, max_length)
    head = (max_length + 1) // 2
    tail = max_length - head
    kept = F.slice(t, 1, head)
    if tail:
        kept = F.concat(kept, F.slice(t, -tail, tail))
    return F.when(F.size(t) > max_length, kept).otherwise(t)


def snippet(text: ColumnLike, length: int = 300, mark: str = "…") -> Column:
    c = col(text)
    cut = F.substring(c, 1, length)
    return F.when(F.length(c) > length, F.concat(cut, F.lit(mark))).otherwise(c) if mark else cut


def char_windows(
    df: DataFrame,
    text: str = "text",
    row_id: str = "row_id",
    char_window: int = 2000,
    short_ratio: float = 0.15,
    min_short_chars: int = 100,
    seed: int = 42,
) -> DataFrame:
    """Text windows of a corpus: ``len // char_window`` (at least 1) per text.

    A share of the windows is shorter. Size and start come from a hash of text id, window number
    and seed. Only the cut pieces are exploded, the text itself is not repeated.
    """
    length = F.length(text)

    def draw(i, salt):
        return unit_hash(F.col(row_id).cast("string"), i.cast("string"), F.lit(f"{seed}{salt}"))

    def window(i):
        span = char_window - min_short_chars + 1
        short = F.lit(min_short_chars) + F.floor(draw(i, "n") * span)
        size = F.when(draw(i, "s") < short_ratio, short).otherwise(char_window).cast("int")
        room = F.greatest(length - size, F.lit(0))
        start = F.floor(draw(i, "p") * (room + 1)).cast("int")
        return F.struct(
            i.alias("window_no"),
            start.alias("start"),
            F.substring(F.col(text), start + 1, size).alias("chunk"),
        )

    count = F.greatest(F.floor(length / F.lit(max(1, char_window))), F.lit(1)).cast("int")
    return (
        df.where(~is_blank(text))
        .select(row_id, F.explode(F.transform(F.sequence(F.lit(0), count - 1), window)).alias("w"))
        .select(row_id, "w.window_no", "w.start", "w.chunk")
    )
