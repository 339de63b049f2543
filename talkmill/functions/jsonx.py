"""Model answers: JSON objects inside free text, field checks, chat-completion bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions import fixed
from talkmill.functions.columns import ColumnLike, bind, col, collapse_spaces, strip
from talkmill.functions.text import estimate_tokens, normalise_for_match

VARIANT_MAP = "map<string,variant>"


def strict_json(raw: ColumnLike) -> Column:
    """Variant of a text that is one JSON value and nothing else; null otherwise.

    The parser stops after the first value. Inside a list and inside an object the rest of the
    text must be well formed as well, so trailing words make one of the two wraps fail.
    """
    c = col(raw)
    listed = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>"
    )
    named = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return bind(listed, lambda v: F.when((F.size(v) == 1) & named.isNotNull(), F.element_at(v, 1)))


def json_fields(value: ColumnLike) -> Column:
    """Map of a variant object; null for any other value."""
    return F.try_variant_get(col(value), "$", VARIANT_MAP)


def strip_code_fence(raw: ColumnLike) -> Column:

    def unfenced(c):
        opened = F.regexp_replace(c, r"(?iU)^```(?:json)?\s*", "")
        body = strip(F.regexp_replace(opened, r"(?U)\s*```\z", ""))
        return F.when(c.startswith("```"), body).otherwise(c)

    return bind(strip(raw), unfenced)


def extract_json_object(raw: ColumnLike) -> Column:
    """Fields of the JSON object in an answer, as a map of variants.

    If the whole answer is JSON it decides: an object gives its fields, anything else null. Only
    an answer that does not parse is searched from its first ``{`` to its last ``}``.
    """

    def inner(c):
        found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
        return F.when(F.contains(c, F.lit("{")), json_fields(strict_json(found)))

    def fields(c):
        return bind(
            strict_json(c), lambda w: F.when(w.isNotNull(), json_fields(w)).otherwise(inner(c))
        )

    return bind(strip_code_fence(raw), fields)


def variant_kind(value: ColumnLike) -> Column:
    """``STRING``, ``BIGINT``, ``OBJECT<...>``, ``ARRAY<...>``, ``VOID``, ...; null if missing."""
    return F.schema_of_variant(col(value))


def variant_text(value: ColumnLike) -> Column:
    return F.try_variant_get(col(value), "$", "string")


def is_present(value: ColumnLike) -> Column:
    """False for null, blank or "unknown"-like text, and empty lists and objects."""
    v = col(value)

    def filled(kind):
        words = bind(
            F.lower(strip(variant_text(v))), lambda t: (t != "") & ~t.isin(fixed.ABSENT_WORDS)
        )
        return (
            F.when(kind == "VOID", False)
            .when(kind == "STRING", words)
            .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
            .when(kind.startswith("OBJECT"), F.size(json_fields(v)) > 0)
            .otherwise(True)
        )

    return bind(F.coalesce(variant_kind(v), F.lit("VOID")), filled)


def completeness(fields: ColumnLike, required: Sequence[str]) -> Column:
    """Share of required fields that are filled; 1 if none is required, 0 without an object."""
    m = col(fields)
    if not required:
        return F.when(m.isNull(), 0.0).otherwise(1.0)
    filled = sum(
        (F.coalesce(is_present(F.try_element_at(m, F.lit(f))), F.lit(False)).cast("int") for f in required),
        F.lit(0),
    )
    return F.when(m.isNull(), 0.0).otherwise(filled / F.lit(float(len(required))))


def text_field(raw: ColumnLike, names: Sequence[str] = tuple(fixed.TEXT_FIELDS)) -> Column:
    """First field of a JSON object that holds text, with spaces collapsed; null if none does."""
    m = json_fields(strict_json(raw))
    picks = []
    for name in names:
        v = F.try_element_at(m, F.lit(name))
        text = variant_text(v)
        picks.append(F.when((variant_kind(v) == "STRING") & (strip(text) != ""), text))
    return collapse_spaces(F.coalesce(*picks))


def _text_list(value: Column) -> Column:
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), variant_text)
    kept = F.filter(F.transform(items, lambda t: F.coalesce(t, F.lit("None"))), lambda t: strip(t) != "")
    kind = variant_kind(value)
    return F.when(kind == "STRING", F.array(variant_text(value))).when(
        kind.startswith("ARRAY"), kept
    )


def expected_keywords(value: ColumnLike) -> Column:
    """Keyword list of a reference entry: a text, a list, or an object that holds one."""
    v = col(value)
    inner = [_text_list(F.try_element_at(json_fields(v), F.lit(f))) for f in fixed.REFERENCE_FIELDS]
    return F.coalesce(_text_list(v), *inner)


def keywords_match(value: ColumnLike, keywords: ColumnLike) -> Column:
    """The answer is filled and holds every keyword; without keywords a filled answer passes."""
    v = col(value)
    asked = F.filter(col(keywords), lambda k: strip(k) != "")
    hit = bind(
        normalise_for_match(variant_text(v)),
        lambda said: F.forall(asked, lambda k: F.contains(said, normalise_for_match(k))),
    )
    return F.coalesce(is_present(v), F.lit(False)) & F.coalesce(hit, F.lit(True))


def completion_text(body: ColumnLike) -> Column:
    """Text of the first choice of a chat-completion body: a string, or its text parts."""
    v = F.try_parse_json(col(body))
    content = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text"),
        lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")),
    )
    kind = variant_kind(content)
    return F.when(kind == "STRING", variant_text(content)).when(
        kind.startswith("ARRAY"), F.array_join(texts, "\n")
    )


def completion_tokens(body: ColumnLike) -> Column:
    """Reported number of tokens, or an estimate from the text if none is reported."""
    used = F.try_variant_get(F.try_parse_json(col(body)), "$.usage.completion_tokens", "variant")
    whole = F.when(variant_kind(used) == "BIGINT", F.try_variant_get(used, "$", "int"))
    return F.coalesce(whole, estimate_tokens(completion_text(body)))
