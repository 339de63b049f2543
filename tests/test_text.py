import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from talkmill.functions import columns, fixed, redact, text
from talkmill.functions.columns import unicode_re
from talkmill.functions.numbers import exact_round, fixed_text


def one(spark, value, column):
    rows = spark.createDataFrame([(v,) for v in value], "x string").select(column.alias("y"))
    return [r.y for r in rows.collect()]


PII = {
    "Звоните +7 (999) 123-45-67 или a.b@ex.com": "Звоните [ТЕЛЕФОН] или [EMAIL]",
    "хост 10.0.0.1 https://x.ru/a?b": "хост [IP] [ССЫЛКА]",
    "договор № 12345": "договор [НОМЕР_ДОГОВОРА]",
    "тикет A1234-56": "[НОМЕР_ДОГОВОРА]",
    "код 123456789": "код [НОМЕР]",
    "12345678901": "[НОМЕР]",
    "версия 2 0 0 1": "версия 2 0 0 1",
    "номер версии 2.0": "номер версии 2.0",
    "1-7-8-7-5-5-1": "[ТЕЛЕФОН]",
    "один два три четыре пять шесть семь дом": "[ТЕЛЕФОН]дом",
    "а бэ русская эм собака я точка ру": None,
    "и в а н собака м точка ру": "[EMAIL]очка ру",
}


def python_redact(value):
    for kind, pattern, ignore_case in fixed.REDACTIONS:
        value = re.sub(pattern, fixed.PLACEHOLDERS[kind], value, flags=re.I if ignore_case else 0)
    return value


def test_redaction(spark):
    got = one(spark, list(PII), redact.redact_pii("x"))
    for value, result in zip(PII, got):
        assert result == python_redact(value)
        assert PII[value] in (None, result)


def test_redaction_is_stable(spark):
    first = [python_redact(v) for v in PII]
    assert one(spark, first, redact.redact_pii("x")) == first


def test_names_and_organisations(spark):
    assert one(spark, ["звонил Иван, иванов и ОЛЕГ"], redact.redact_names("x")) == [
        "звонил [ИМЯ], иванов и [ИМЯ]"
    ]
    assert one(spark, ["компания Ромашка Плюс звонит"], redact.redact_orgs("x")) == [
        "компания [ОРГАНИЗАЦИЯ]"
    ]
    assert one(spark, ["звонит ООО Ромашка, добрый день"], redact.redact_orgs("x")) == [
        "звонит [ОРГАНИЗАЦИЯ], добрый день"
    ]
    assert one(spark, ["компания хочет"], redact.redact_orgs("x")) == ["компания хочет"]


def test_spans(spark):
    df = spark.createDataFrame([(1, "Иван в Москве"), (2, "без имён")], "row_id long, text string")
    spans = spark.createDataFrame(
        [(1, 0, 4, "PER"), (1, 7, 13, "LOC"), (1, 5, 6, "MISC")],
        "row_id long, start int, end int, type string",
    )
    got = {r.row_id: r.text for r in redact.redact_spans(df, spans).collect()}
    assert got == {1: "[ИМЯ] в [АДРЕС]", 2: "без имён"}


def test_dictionary_words(spark):
    df = spark.createDataFrame(
        [(1, "Звонил Ивану, [ИМЯ]  клиентам!\nИВАНУ"), (2, ""), (3, None), (4, "мимо [ИМЯ")], "row_id long, text string"
    )
    words = spark.createDataFrame(
        [("ивану", "иван"), ("клиентам", "клиент"), ("имя", "ПЛОХО")], "form string, replacement string"
    )
    got = {r.row_id: r.text for r in redact.replace_words(df, words).collect()}
    assert got == {1: "Звонил иван, [ИМЯ]  клиент!\nиван", 2: "", 3: None, 4: "мимо [ПЛОХО"}


def test_dictionary_with_marks_and_repeated_ids(spark):
    """Combining marks end a word, as in Python; rows that share an id keep their own texts."""
    rows = [(1, "q\u0308r a x"), (1, "the x"), (1, "y the"), (1, "the x"), (2, "The THE thee")]
    df = spark.createDataFrame(rows, "row_id long, text string")
    words = spark.createDataFrame([("q", "Q"), ("r", "R"), ("the", "a"), ("q\u0308r", "Z")], "form string, lemma string")
    got = sorted((r.row_id, r.text) for r in redact.lemmatise(df, words).collect())
    assert got == sorted([(1, "Q\u0308R a x"), (1, "a x"), (1, "y a"), (1, "a x"), (2, "a a thee")])
    assert "CartesianProduct" not in redact.lemmatise(df, words)._jdf.queryExecution().executedPlan().toString()


def test_words_end_at_combining_marks(spark):
    import re

    from talkmill.functions import text as t

    texts = ["q\u0308r ab cd_1 e", "naïve cafe\u0301s", "x² ①② ab"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = [r[0] for r in df.select(t.word_tokens("text")).collect()]
    assert got == [re.findall(r"\b\w\w+\b", x.lower()) for x in texts]

def test_names_by_lemma(spark):
    df = spark.createDataFrame([(1, "Позвали Ивана и Олега, олегу нет")], "row_id long, text string")
    lemmas = spark.createDataFrame([("ивана", "иван"), ("олегу", "олег")], "form string, lemma string")
    got = redact.redact_names_by_lemma(df, lemmas).first().text
    assert got == "Позвали [ИМЯ] и Олега, [ИМЯ] нет"


NORMAL = {
    "Привет,\nмир": "привет,мир",
    "АААААа !!!! ок": "аа !! ок",
    "Цена 100% + налог": "цена 100 налог",
    "«Ромашка»  \tДБ": "«ромашка» дб",
    "ааа бббб": "ааа бб",
    "[ТЕЛЕФОН] x": "[телефон] x",
    "ﬁ①": "fi1",
    "№5…": "no5...",
    "й й": "й й",
}


def python_normalise(value):
    value = unicodedata.normalize("NFKC", value)
    value = "".join(c for c in value if unicodedata.category(c)[0] != "C").lower()
    value = re.sub(r"[\\|@#$%^&*=+<>~`]", " ", value)
    value = re.sub(r"(.)\1{3,}", r"\1\1", value)
    return re.sub(r"\s+", " ", value).strip()


def test_normalise(spark):
    got = one(spark, list(NORMAL), text.normalise("x"))
    assert got == [python_normalise(v) for v in NORMAL] == list(NORMAL.values())
    assert one(spark, got, text.normalise("x")) == got
    assert one(spark, ["а\nб"], text.normalise("x", newline_to_space=True)) == ["а б"]


def test_characters_kept_from_python_are_stable():
    stable = re.compile(f"[{text.NFKC_STABLE}]")
    kept = [c for c in map(chr, range(0x3000)) if stable.match(c)]
    assert len(kept) > 400
    for c in kept:
        assert unicodedata.normalize("NFKC", c) == c
        assert unicodedata.combining(c) == 0
        assert unicodedata.normalize("NFKC", "и" + c) == "и" + c


def test_whole_chain(spark):
    rows = ["", "  ", "[TRANSCRIPTION_ERROR: +79991234567]", "Я Иван из ООО Ромашка, тел 89991234567"]
    assert one(spark, rows, text.clean_text("x")) == [
        "", "", "[TRANSCRIPTION_ERROR: +79991234567]", "я [имя] из [организация], тел [телефон]",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row_id long, text string")
    spans = spark.createDataFrame([(3, 2, 6, "PER")], "row_id long, start int, end int, type string")
    lemmas = spark.createDataFrame([("из", "ИЗ")], "form string, lemma string")
    got = {r.row_id: r.text for r in text.clean_table(df, spans=spans, lemmas=lemmas).collect()}
    assert got[3] == "я [имя] из [организация], тел [телефон]"
    assert got[2] == rows[2] and got[0] == got[1] == ""


def test_short(spark):
    rows = ["", "a b c", "[TRANSCRIPTION_ERROR: x]", " a  b "]
    assert one(spark, rows, text.flag_text(text.too_short("x"))) == ["True", "False", "False", "True"]
    assert one(spark, rows, text.token_count("x")) == [len(r.split()) for r in rows]


def python_noise(value):
    for p in fixed.NOISE_PHRASES:
        value = re.sub(p, " ", value, flags=re.I)
    value = re.sub(r"^[\s,.:;!?\-]+", "", value)
    value = re.sub(r"[\s,.:;!?\-]+$", "", value)
    return re.sub(r"\s{2,}", " ", value).strip()


def test_noise(spark):
    rows = [
        "Добрый день, слушаю вас. Хорошо, нет, нет нет! Мне нужна лицензия, спасибо вам.",
        "ЗДРАВСТВУЙТЕ! Готова помочь?", "[TRANSCRIPTION_ERROR] хорошо", "хорошее дело", "",
        "Если у вас будут ещё вопросы - обращайтесь, до свидания", "чем могу помочь\nпонятно код 5",
    ]
    assert one(spark, rows, text.remove_noise("x")) == [python_noise(r) for r in rows]


def test_file_names(spark):
    rows = ["2024-01-02__03-04-05_x.mp3", "call1.mp3", " 2024-01-02__03-04-05", ""]
    assert one(spark, rows, text.clean_filename("x")) == [
        "2024-01-02__03-04-05", "call1.mp3", "2024-01-02__03-04-05", "",
    ]
    times = one(spark, rows, text.call_time("x").cast("string"))
    assert times[0] == "2024-01-02 03:04:05" and times[1] is None


def test_match_and_estimate(spark):
    assert one(spark, ["Ёж,  «Ёлка»-2_a!"], text.normalise_for_wer("x")) == ["еж елка 2 a"]
    assert one(spark, ["Ёж,  «Ёлка»-2_a!"], text.normalise_for_match("x")) == ["еж елка 2_a"]
    assert one(spark, ["Привет, мир! x_1", " ", "!"], text.estimate_tokens("x")) == [5, 0, 1]


def test_keyword_flags(spark):
    com, tech = text.keyword_flags("x")
    rows = ["Хочу купить ЛИЦЕНЗИЮ", "установка кластера, не работает", "привет"]
    assert one(spark, rows, com) == [1.0, 0.0, 0.0]
    assert one(spark, rows, tech) == [0.0, 1.0, 0.0]


def test_tokens_and_truncation(spark):
    rows = ["Мой код a bb ccc_1 Bb"]
    tokens = text.word_tokens("x")
    assert one(spark, rows, tokens) == [["мой", "код", "bb", "ccc_1", "bb"]]
    assert one(spark, rows, text.word_ngrams(tokens, 1, 2))[0][5:] == [
        "мой код", "код bb", "bb ccc_1", "ccc_1 bb",
    ]
    assert one(spark, ["aa"], text.word_ngrams(text.word_tokens("x"), 1, 3)) == [["aa"]]
    assert one(spark, rows, text.truncate_tokens(tokens, 3, "middle-cut")) == [["мой", "код", "bb"]]
    assert one(spark, rows, text.truncate_tokens(tokens, 4, "head_tail")) == [["мой", "код", "ccc_1", "bb"]]
    assert one(spark, rows, text.truncate_tokens(tokens, 9, "head_tail"))[0] == ["мой", "код", "bb", "ccc_1", "bb"]
    with pytest.raises(ValueError):
        text.truncate_tokens(tokens, 3, "tail")


def test_windows(spark):
    body = "абвгд" * 100
    df = spark.createDataFrame([(1, body), (2, "мало"), (3, " ")], "row_id long, text string")
    rows = text.char_windows(df, char_window=50, short_ratio=0.3, min_short_chars=5).collect()
    assert sum(r.row_id == 1 for r in rows) == 10 and sum(r.row_id == 2 for r in rows) == 1
    for r in rows:
        if r.row_id == 1:
            assert 5 <= len(r.chunk) <= 50 and body[r.start:r.start + len(r.chunk)] == r.chunk
    assert len({len(r.chunk) for r in rows if r.row_id == 1}) > 1
    again = text.char_windows(df, char_window=50, short_ratio=0.3, min_short_chars=5).collect()
    assert sorted(rows) == sorted(again)


def test_decimals(spark):
    values = [0.25, 0.35, 0.125, 2.675, 1234.05, 0.05, 1e-9, 0.0, 87.5, 3.5, 7.25, 99.995]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(fixed_text("x", 1).alias("a"), fixed_text("x", 3).alias("b"), exact_round("x", 2).alias("c")).collect()
    assert [tuple(r) for r in got] == [("%.1f" % v, "%.3f" % v, round(v, 2)) for v in values]


def test_snippet(spark):
    assert one(spark, ["абвг", "аб"], text.snippet("x", 3)) == ["абв…", "аб"]
    assert one(spark, ["абвг"], text.snippet("x", 3, "")) == ["абв"]


def test_long_runs_do_not_recurse(spark):
    runs = ["a " * 5000, "один " * 5000, "1 " * 5000, "нет " * 5000, "a" * 20000]
    got = one(spark, runs, text.remove_noise(redact.redact_pii("x")))
    assert got[1] == "[ТЕЛЕФОН]" and got[2] == "[ТЕЛЕФОН]" and got[3] == "" and len(got[4]) == 20000


PLAIN_RULES = [(k, unicode_re(p, i), fixed.PLACEHOLDERS[k]) for k, p, i in fixed.REDACTIONS]


def test_rules_run_only_on_texts_that_can_match_and_find_the_same(spark):
    bits = [
        "а", "б ", " at ", "собака", "x", " ", "\n", "+7 (912) 345-67-89", "9 1 1 2 3 4 5", "один два три четыре пять шесть семь ",
        "1.2.3.4", "договор 12345", "ID a1234", "ı", "# 123x", "a.b@c.de1@f.gh", "@", "http://a.b", "www.x", "12345678", "٣٤٥٦٧٨٩٠",
        "с ᲂ ", "точка ру", "как", "ſ", "İd 123",
    ]
    rng = random.Random(3)
    rows = [("".join(rng.choices(bits, k=rng.randint(0, 12))),) for _ in range(800)] + [(None,)]
    df = spark.createDataFrame(rows, "text string")
    plain = F.col("text")
    for _, pattern, token in PLAIN_RULES:
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(token))
    got = df.select("text", plain.alias("plain"), redact.redact_pii("text").alias("quick")).collect()
    assert all(r["plain"] == r["quick"] for r in got) and sum(r["plain"] != r["text"] for r in got if r["text"]) > 300
    # Rules stand behind a condition.
    assert str(redact.redact_pii("text")).count("CASE WHEN") + str(redact.redact_names("text")).count("CASE WHEN") >= 5


def test_white_space_and_short_texts_as_before(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices([" ", "  ", "\t", "\x1c", "\xa0", " ", "a", "bc", "."], k=rng.randint(0, 14))),) for _ in range(500)]
    df = spark.createDataFrame([*rows, (None,), ("[TRANSCRIPTION_ERROR x",)], "text string")
    runs = F.btrim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "), F.lit(" "))
    checks = [columns.collapse_spaces("text").eqNullSafe(runs)]
    for n in (0, 1, 2, 3, 5, 501):
        plain = ~F.col("text").startswith("[TRANSCRIPTION_ERROR") & (text.token_count("text") < n)
        checks.append(text.too_short("text", n).eqNullSafe(plain))
    assert df.where(~F.forall(F.array(*checks), lambda x: x)).isEmpty()
    assert "regexp_count" not in str(text.too_short("text", 50))


def test_unicode_step_holds_a_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    sizes, plain = [], pa.array
    monkeypatch.setattr(text.pa, "array", lambda values, *more: (sizes.append(len(values)), plain(values, *more))[1])
    found = text._nfkc.func(plain(["ｆｕｌｌ", None, "①"] * 1000))
    assert max(sizes) <= 256 and found.to_pylist() == ["full", None, "1"] * 1000


def test_a_small_dictionary_meets_the_words_before_the_shuffle(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, None), (1, "the cat")], "row_id long, text string")
    pairs = spark.createDataFrame([("the", "a")], "form string, lemma string")
    done = redact.lemmatise(docs, pairs)
    assert sorted(r["text"] or "" for r in done.collect()) == ["", "a cat", "a cat"]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
