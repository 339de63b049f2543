import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkmill.llm import pii_deobfuscation as pii
from talkmill.llm.queries import op8_pii_deobfuscation
from talkmill.llm.registry import table

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, digits[::-1]))]
    return sum(doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [
                True,
                all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else False,
                16 <= len(digits) <= 19 and luhn(digits),
                8 <= len(digits) <= 15,
            ][kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    None, "", " ", "a@b.c@d.e.f", "a@b@c.d", "x..y@-.-", "@@@", "a@b", "1.2.3.4.5", "300.1.2.3.4", "001.002.003.0255", "1" * 900 + ".2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112", "5" * 40, "+1 (988) 555-2485", "+1--", "+12345678901234567",
    "é😀 bob@x.org 10.0.0.1", "a.b+c%d@e-f.g " * 300, "9" * 1500, "+" * 5000, "a" * 1500 + "@", "x@y.z.",
]


@pytest.mark.parametrize("text", ODD)
def test_fixed_patterns(text):
    assert pii.detect(text or "") == brute(text)
    base, found = pii.find(text)
    assert base == brute(text) and set(base) <= set(found)


@pytest.mark.parametrize(
    "text, kind, piece",
    [
        ("mail bob.smith (at) mail [dot] example [dot] com now", "email", "bob.smith (at) mail [dot] example [dot] com"),
        ("write to anna at example dot com today", "email", "anna at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ａ＠ｂ.com", "email", "ａ＠ｂ.com"),
        ("to bo​b@x.org", "email", "bo​b@x.org"),
        ("😀 ip 10 dot 0 dot 0 dot 1!", "ip", "10 dot 0 dot 0 dot 1"),
        ("call plus one five five five one two three four", "phone", "plus one five five five one two three four"),
        ("karte vier eins eins eins 1 1 1 1 1 1 1 1 1 1 1 1 ok", "card", "vier eins eins eins 1 1 1 1 1 1 1 1 1 1 1 1"),
        ("＋1 988 555 2485", "phone", "＋1 988 555 2485"),
    ],
)
def test_disguises(text, kind, piece):
    _, found = pii.find(text)
    assert (kind, piece) in [(pii.KINDS[k], text[a:b]) for k, a, b in found]


@pytest.mark.parametrize("hint", ["", " at this point we wait", " it is (at) most", " a dot "])
@pytest.mark.parametrize(
    "kind, piece",
    [
        ("email", "anna at example.com"),
        ("email", "anna arroba mail.example.org"),
        ("email", "anna ät example.de"),
        ("email", "anna chez example.fr"),
        ("email", "anna at example dot com"),
        ("email", "anna (at) example.com"),
        ("ip", "10 dot 0 dot 0 dot 1"),
    ],
)
def test_unrelated_words_do_not_decide(kind, piece, hint):
    text = f"write to {piece}, please{hint}"
    _, found = pii.find(text)
    assert (kind, piece) in [(pii.KINDS[k], text[a:b]) for k, a, b in found]


def test_spoken_hosts_need_a_known_last_label():
    assert pii.find("look at main.py and at v2.10") == ([], [])


@pytest.mark.parametrize("between", [" ", ", ", ",", "-", "  ", " -"])
@pytest.mark.parametrize("around", ["{}", "call ({}) now", "call:\n{}\n"])
def test_separators_of_spelled_digits(between, around):
    piece = "plus " + between.join("one five five five one two three four".split())
    text = around.format(piece)
    _, found = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in found] == [("phone", piece)]


@pytest.mark.parametrize(
    "text", ["me at the dot of it", "look at this one two", "un dos", "one two three four", "l'un des deux", "f(at) (x.) [.]"]
)
def test_plain_prose_is_left_alone(text):
    assert pii.find(text) == ([], [])


def test_very_long_texts_take_linear_time():
    for text in ("9" * 300_000, "+" * 300_000, "a" * 300_000 + "@", "x." * 150_000, "un " * 100_000, "a at b dot " * 30_000):
        assert pii.find(text)[0] == []


def test_offsets_survive_edits():
    m = pii.Mapped("ab​cd efg")
    m.rewrite([(2, 3, "")])
    m.rewrite([(0, 1, "xyz"), (4, 5, "")])
    assert m.text == "xyzbcdefg"
    assert [m.source(i, i + 1) for i in range(9)] == [(0, 1)] * 3 + [(1, 2), (3, 4), (4, 5), (6, 7), (7, 8), (8, 9)]


def test_query(spark, tmp_path):
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = op8_pii_deobfuscation(spark, "/root/testdata/sf0.01").collect()
    df = spark.createDataFrame(list(enumerate(ODD * 2)), "doc_id long, text string").withColumn("base", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    odd = op8_pii_deobfuscation(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and len(odd) == 2 * len(ODD)
    for found, source in ((rows, texts), (odd, dict(enumerate(ODD * 2)))):
        for r in found:
            want = brute(source[r.doc_id])
            spans = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want]
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, *_ in want) for i in range(4))
            assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
            assert set(spans) <= set(r.spans.split(",")) | {""}
    # Invented prose has no disguises.
    assert sum(len(x) for r in rows for x in [r.spans.split(",")] if r.spans) == sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([], "text string, found int")
    out = pii.with_spans(df)
    assert out.columns == ["text", "base", "found"] and out.count() == 0


def test_letters_that_fold_to_ascii():
    """Every letter that matches an ASCII one where case is ignored, in every word and pattern."""
    folds = [chr(c) for c in range(0x80, 0x110000) if re.fullmatch("[a-z]", chr(c), re.I)]
    assert {"\u017f", "\u212a"} <= set(folds)
    for letter in folds:
        for text in ("six six six six six six six six", "five six kilo six zero", "anna at kiss dot info", "plus six six six seven one two three four"):
            for plain in "iksIKS":
                odd = text.replace(plain, letter)
                base, found = pii.find(odd)
                assert set(base) <= set(found) and all(0 <= a < b <= len(odd) for _, a, b in found)
    assert pii.find("plus \u017fix one two three four five six seven")[1] == [(3, 0, 42)]


@given(st.text(st.one_of(st.characters(), st.sampled_from(list("ſİıK+@. -sixoneatdot()[]0123"))), max_size=60), st.sampled_from(["", " at ", " six six ", "@", "+1 "]))
@settings(max_examples=400, deadline=None)
def test_any_text(text, part):
    text = text + part + text
    base, found = pii.find(text)
    assert base == pii.detect(text) and set(base) <= set(found)
    assert found == sorted(found) and all(0 <= a < b <= len(text) for _, a, b in found)
