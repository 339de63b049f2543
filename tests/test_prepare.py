import pytest

from talkmill.plans import prepare

ROWS = [
    (0, "звоните +7 999 123-45-67 мне сейчас", "старое"),
    (1, "звоните +7 999 123-45-67 мне сейчас", "б"),
    (2, "[TRANSCRIPTION_ERROR: x]", ""),
    (3, "  ", "в"),
    (4, "добрый день, спасибо", "г"),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "row_id long, text string, raw string")


def test_cleaning(rows):
    got = {r.row_id: r for r in prepare.clean_transcripts(rows, start_row=1).collect()}
    assert got[0].text == ROWS[0][1] and got[1].text == "звоните [телефон] мне сейчас"
    assert [got[i].too_short for i in range(5)] == ["", "False", "False", "True", "False"]
    assert got[0].text_original == ""
    assert got[1].text_original == ROWS[1][1]
    again = {r.row_id: r.text for r in prepare.clean_transcripts(rows, "raw").collect()}
    assert again[1] == "б" and again[2] == ""
    with pytest.raises(ValueError, match="zz"):
        prepare.clean_transcripts(rows, "zz")


def test_spans_and_start(spark, rows):
    spans = spark.createDataFrame([(1, 0, 7, "PER")], "row_id long, start int, end int, type string")
    got = {r.row_id: r.text for r in prepare.clean_transcripts(rows, start_row=1, spans=spans).collect()}
    assert got[1] == "[имя] [телефон] мне сейчас" and got[0] == ROWS[0][1]


def test_noise_and_report(rows):
    noisy = prepare.clean_noise(rows)
    got = {r.row_id: (r.text, r.too_short, r.text_before_noise_clean) for r in noisy.collect()}
    assert got[4] == ("спасибо", "True", ROWS[4][1]) and got[2][1] == "False"
    r = prepare.preparation_report(noisy).first()
    assert (r.total, r.short, r.empty, r.errors, r.ok, r.ok_reference) == (5, 2, 1, 1, 2, 1)
    assert prepare.noise_preview(rows).columns == ["row_id", "before", "after"]


def test_blank_labels_are_one_group(spark):
    from talkmill.operators import labels

    df = spark.createDataFrame([("a",), (" ",), ("",), (None,), ("\t",)], "label string")
    assert {r.label: r.n for r in labels.label_counts(df, "label").collect()} == {"a": 1, "": 4}


def test_empty_results_are_errors(spark):
    import pytest

    from talkmill.operators import labels

    df = spark.createDataFrame([("x", ""), ("", "a"), ("y", " ")], "text string, call_purpose string")
    with pytest.raises(ValueError, match="evaluation rows"):
        labels.eval_rows(df, "text", "call_purpose")
    with pytest.raises(ValueError, match="class"):
        labels.drop_rare_classes(df, "call_purpose", 5)
    with pytest.raises(ValueError, match="rows"):
        labels.drop_rare_classes(df.where("text = 'x'"), "call_purpose", 1)


def test_missing_columns_are_named(spark):
    import pytest

    from talkmill.operators import labels

    df = spark.createDataFrame([("f.mp3", "t", "a")], "filename string, text string, call_purpose string")
    with pytest.warns(UserWarning, match="priority"):
        assert labels.keep_ready_rows(df).count() == 1


def test_one_redaction_chain(spark):
    """The chain of a cleaned table stands in the plan once, whatever the Unicode step asks of it."""
    from talkmill.functions import text

    df = spark.range(1).selectExpr("cast(id as string) AS text")
    plan = text.clean_table(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[ТЕЛЕФОН]") <= 3  # three rules write it


def test_broadcast_by_bytes(spark):
    from talkmill.session import checked_broadcast

    small, big = spark.range(10), spark.range(1000).selectExpr("id", "repeat('x', 100) AS pad")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(checked_broadcast(small)) and "broadcast" not in plan(checked_broadcast(big, 1000))


def test_seen_keys_are_forgotten(spark, tmp_path):
    from talkmill.streaming import calls

    rows = [(i % 5, f"2024-01-0{1 + i // 10} 00:00:00") for i in range(20)]
    df = spark.createDataFrame(rows, "k long, at string").selectExpr("k", "cast(at AS timestamp) AS at")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = calls.arriving(spark, f"{tmp_path}/in", df.schema)
    calls.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", once_per="k", within=("at", "1 hour")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("k").distinct().count() == 5
