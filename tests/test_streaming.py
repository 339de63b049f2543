import pytest

from talkmill.plans.speech_queries import streamed_preparation
from talkmill.sources.tables import transcript_rows
from talkmill.streaming import calls


def test_each_file_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))

    def arrive(rows):
        transcript_rows(spark.createDataFrame(rows, "filename string, text string")).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        stream = calls.arriving(spark, inbox, spark.read.parquet(inbox).schema)
        calls.write_stream(calls.prepare_calls(stream), out, state, once_per="filename").awaitTermination()
        return {r.filename: (r.text, r.too_short, r.text_original) for r in spark.read.parquet(out).collect()}

    arrive([("2024-01-02__03-04-05_a.mp3", "Добрый день! Это Иван, +7 999 123-45-67, не работает кластер"), ("b", "хорошо")])
    first = run()
    assert first["2024-01-02__03-04-05"][:2] == ("это [имя], [телефон], не работает кластер", False)
    assert first["b"][:2] == ("", True)
    arrive([("c", "новый звонок по лицензии"), ("b", "повтор имени файла")])
    second = run()
    assert set(second) == {"2024-01-02__03-04-05", "b", "c"} and second["b"] == first["b"]
    assert run() == second


def test_routes(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    rows = [(1, "non_spam", .9, "hr", .7), (2, "spam", .6, "hr", .9), (3, "non_spam", .95, "it", .85)]
    df = spark.createDataFrame(rows, "row_id long, spam_pred string, spam_conf double, intent_pred string, intent_conf double")
    df.write.parquet(inbox)
    calls.route_stream(calls.arriving(spark, inbox, df.schema), out, state).awaitTermination()
    got = {r.row_id: (r.route, r.y_pred) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("review", "hr"), 2: ("review", "spam"), 3: ("auto", "it")}


@pytest.mark.parametrize("files", [0, 3])
def test_streamed_table(spark, tmp_path, files):
    """The table may be one file or a folder of several."""
    rows = [(n, "de" if n % 3 else "en", None if n == 4 else "word " * (n * 20)) for n in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    if files:
        df.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        df.toPandas().to_parquet(tmp_path / "documents.parquet", index=False)
    df.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.lang: (r.n_rows, r.short) for r in streamed_preparation(spark, str(tmp_path)).collect()}
    assert got == {"de": (6, 3), "en": (3, 1)}
