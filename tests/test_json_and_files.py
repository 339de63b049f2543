import json

import pytest
from pyspark.sql import functions as F

from talkmill.functions import jsonx, transcript
from talkmill.operators import responses
from talkmill.sources import files, tables


def one(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


def as_dict(column):
    return F.transform_values(column, lambda k, v: F.to_json(v))


def python_object(raw):
    raw = raw.strip()
    if raw.startswith("```"):
        body = raw[3:]
        body = body[4:] if body[:4].lower() == "json" else body
        raw = body.strip()
        raw = raw[:-3].strip() if raw.endswith("```") else raw
    try:
        obj = json.loads(raw)
        return obj if isinstance(obj, dict) else None
    except ValueError:
        pass
    a, b = raw.find("{"), raw.rfind("}")
    try:
        obj = json.loads(raw[a:b + 1]) if 0 <= a < b else None
        return obj if isinstance(obj, dict) else None
    except ValueError:
        return None


ANSWERS = [
    '```json\n{"a": 1}\n```', 'text {"a":1} tail', '[{"a":1}]', "{bad", "", '{"a":1} {"b":2}',
    '"x" {"a":1}', '1] {"a":2}', '{"a":{"b":[1,"}"]}}', "```\n{}```", "null", '{"a":1}] x', "1,2",
    '1} {"a":3}', 'so: {"a":\n"x"}', '{"a":1,}', "```JSON {\"q\": true}",
]


def test_json_objects(spark):
    got = one(spark, ANSWERS, as_dict(jsonx.extract_json_object("x")))
    want = [python_object(a) for a in ANSWERS]
    assert [None if g is None else {k: json.loads(v) for k, v in g.items()} for g in got] == want


def test_presence(spark):
    values = ['" N/A "', "[]", "{}", "null", '" "', "0", "false", '"x"', "[0]", '{"a":null}', "1.5", '"unknown"']
    got = one(spark, values, jsonx.is_present(F.parse_json("x")))
    assert got == [False] * 5 + [True] * 6 + [False]


def test_text_field_and_keywords(spark):
    rows = ['{"text":" ","body":" a \\n b "}', '{"text":1,"content":"c"}', '{"zz":"q"}', "[1]"]
    assert one(spark, rows, jsonx.text_field("x")) == ["a b", "c", None, None]
    refs = ['"один"', '["a"," ",2]', '{"problem_keywords":["k"]}', '{"problem":"p","problem_keywords":["k"]}', "5", '{"problem":5}']
    assert one(spark, refs, jsonx.expected_keywords(F.parse_json("x"))) == [
        ["один"], ["a", "2"], ["k"], ["p"], None, None,
    ]


def test_completion(spark):
    rows = [
        json.dumps({"choices": [{"message": {"content": "Привет, мир"}}], "usage": {"completion_tokens": 7}}),
        json.dumps({"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}}]}),
        json.dumps({"choices": []}),
    ]
    assert one(spark, rows, jsonx.completion_text("x")) == ["Привет, мир", "a\nb", None]
    assert one(spark, rows, jsonx.completion_tokens("x"))[:2] == [7, 2]


SEGMENTS = "array<struct<start:double,end:double,speaker:string,text:string>>"


def test_transcripts(spark):
    df = spark.createDataFrame(
        [([(0.0, 3.5, None, " а "), (3.5, 7.2, "S1", "б"), (7.25, 8.0, "S0", "в"), (8.0, 9.0, "S2", "г")],)],
        f"s {SEGMENTS}",
    )
    row = df.select(
        transcript.plain_transcript("s").alias("p"),
        transcript.timed_transcript("s").alias("t"),
        transcript.speaker_transcript("s").alias("k"),
        transcript.role_transcript("s").alias("r"),
        transcript.role_transcript("s", first_is_caller=False).alias("q"),
    ).first()
    assert row.p == "а б в г"
    assert row.t.startswith("[0.0-3.5] а | [3.5-7.2] б | [7.2-8.0] в")
    assert row.k.startswith("[0.0-3.5] UNKNOWN: а | [3.5-7.2] S1: б")
    assert row.r == "[0.0-3.5] UNKNOWN: а | [3.5-7.2] звонящий: б | [7.2-8.0] ответчик: в | [8.0-9.0] S2: г"
    assert "ответчик: б" in row.q and "звонящий: в" in row.q


def test_table_round_trip(spark, tmp_path):
    raw = 'filename;text;priority\na.mp3;"line 1\nline ""2""; x";NA\nb.mp3;null;\nc.mp3;None;"high"\n'
    (tmp_path / "t.csv").write_text(raw, encoding="utf-8")
    df = tables.read_table(spark, str(tmp_path / "t.csv"), ";")
    want = [("a.mp3", 'line 1\nline "2"; x', ""), ("b.mp3", "", ""), ("c.mp3", "", "high")]
    assert [tuple(r) for r in df.orderBy("filename").collect()] == want
    tables.write_table(df, str(tmp_path / "out"), ";")
    back = tables.read_table(spark, str(tmp_path / "out"), ";")
    assert sorted(tuple(r) for r in back.collect()) == sorted(want)


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "calls")
    tables.append_new(spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "filename string, text string"), path)
    tables.append_new(spark.createDataFrame([("b", "9"), ("c", "3")], "filename string, text string"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    base = tables.transcript_rows(spark.read.parquet(path))
    assert base.columns[-1] == "assigned_group" and base.where("call_purpose = ''").count() == 3


def test_cases(spark, tmp_path):
    for b in ("small", "large"):
        (tmp_path / b).mkdir()
    (tmp_path / "small" / "c1.txt").write_text(" a \n b ", encoding="utf-8")
    (tmp_path / "small" / "c2.json").write_text('{"transcript": "из json"}', encoding="utf-8")
    (tmp_path / "large" / "c3.md").write_text("  ", encoding="utf-8")
    (tmp_path / "large" / "c4.pdf").write_text("no", encoding="utf-8")
    got = files.read_cases(spark, str(tmp_path), ["small", "large"])
    assert sorted((r.bucket, r.case_id, r.text) for r in got.collect()) == [
        ("small", "small/c1", "a b"), ("small", "small/c2", "из json"),
    ]
    (tmp_path / "small" / "c1.json").write_text('{"text": "x"}', encoding="utf-8")
    with pytest.raises(ValueError, match="repeated"):
        files.read_cases(spark, str(tmp_path), ["small", "large"])
    (tmp_path / "large" / "c5.json").write_text('{"zz": "x"}', encoding="utf-8")
    with pytest.raises(ValueError, match="without a text"):
        files.read_cases(spark, str(tmp_path), ["small", "large"])


def test_truth_and_references(spark, tmp_path):
    (tmp_path / "gt.json").write_text(
        '{"a@0": {"file":"a","start_ms":0,"duration_ms":5,"text":"т"}, "b": {"file":"b","start_ms":1,"duration_ms":5,"text":""}}',
        encoding="utf-8",
    )
    assert [tuple(r) for r in files.read_truth(spark, str(tmp_path / "gt.json")).collect()] == [("a@0", "a", 0, 5, "т")]
    (tmp_path / "ref.json").write_text('{"small/c1": "сбой", "small/c2": {"problem_keywords": ["a", ""]}, "x": 4}', encoding="utf-8")
    got = {r.case_id: r.keywords for r in files.read_references(spark, str(tmp_path / "ref.json")).collect()}
    assert got == {"small/c1": ["сбой"], "small/c2": ["a"]}


def test_rttm(spark, tmp_path):
    turns = spark.createDataFrame([("f1", 1.5, 2.0005, "S0"), ("f1", 0.0, 1.0, "S1"), ("f2", 3.0, 1.0, "S0")],
                                  "file_id string, start double, dur double, speaker string")
    files.write_rttm(turns, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r" / "file_id=f1").glob("*.txt")))
    assert text == "SPEAKER f1 1 0.000 1.000 <NA> <NA> S1 <NA> <NA>\nSPEAKER f1 1 1.500 %.3f <NA> <NA> S0 <NA> <NA>\n" % 2.0005
    (tmp_path / "one.rttm").write_text(text + "\nNOISE x\n")
    back = files.read_rttm(spark, str(tmp_path / "one.rttm")).orderBy("start").collect()
    assert [(r.file_id, r.start, r.speaker) for r in back] == [("f1", 0.0, "S1"), ("f1", 1.5, "S0")]


def test_intervals(spark):
    lines = spark.createDataFrame(
        [("f", 1, 0.0, "0-5.2:B 5.5 – 12=a 9-8:c"), ("f", 2, 30.0, "0-1:c 2-3:A"), ("g", 1, 0.0, "1-2:x"), ("g", 2, 0.0, "junk")],
        "file_id string, line_no int, offset_sec double, line string",
    )
    got = sorted((r.file_id, r.start, r.end, r.speaker) for r in files.parse_intervals(lines).collect())
    assert got == [
        ("f", 0.0, 5.2, "SPEAKER_00"), ("f", 5.5, 12.0, "SPEAKER_01"), ("f", 30.0, 31.0, "SPEAKER_02"),
        ("f", 32.0, 33.0, "SPEAKER_01"), ("g", 1.0, 2.0, "SPEAKER_00"),
    ]


REPORT = {
    "consulting": (0.875, 16), "cooperation": (0.8780487804878049, 20), "courses": (0.9375, 17),
    "license": (0.8333333333333334, 18), "portal_access": (0.9523809523809523, 10),
}


@pytest.mark.parametrize("as_list", [True, False])
def test_run_logs(spark, tmp_path, as_list):
    from talkmill.operators.metrics import weighted_roll_up

    body = {k: {"precision": 1, "recall": 1.0, "f1-score": f, "support": float(n)} for k, (f, n) in REPORT.items()}
    body.update({"accuracy": 0.9, "macro avg": {"f1-score": 0.1, "support": 81.0}})
    models = [{"model": "m", "group": "g", "f1_weighted": 0.8892, "_report": body}]
    (tmp_path / "run_log.json").write_text(json.dumps(models if as_list else {"models": models}))
    logs = files.read_run_logs(spark, str(tmp_path / "run_log.json"))
    assert logs.first().f1_weighted == 0.8892
    row = weighted_roll_up(files.run_log_reports(logs), ["model"]).first()
    assert row.f1_weighted == pytest.approx(0.8891640139946373, abs=1e-12)
    assert row.f1_macro == pytest.approx(0.895252613240418, abs=1e-12)
    assert row.support == 81


def test_comparisons(spark, tmp_path):
    from talkmill.operators.report import merged_leaderboard

    for d, f1 in (("a", 0.5), ("b", 0.7)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "comparison.csv").write_text(f"model,f1_weighted,notes\nm1,{f1},\nm2,0.6,007\n")
    table = files.read_comparisons(spark, [str(tmp_path / "a"), str(tmp_path / "b" / "comparison.csv")])
    board = merged_leaderboard([table]).collect()
    assert [(r.model, r.f1_weighted) for r in board][0] == ("m1", 0.7) and len(board) == 4
    best = merged_leaderboard([table], best_only=True).collect()
    assert [(r.model, r.f1_weighted, r.source_dir[-1]) for r in best] == [("m1", 0.7, "b"), ("m2", 0.6, "a")]


def test_responses(spark):
    rows = spark.createDataFrame(
        [
            ("m", "small", "c1", '{"problem":"Сбой ЁЛКИ!","priority":"high"}', 2.0, 10),
            ("m", "small", "c2", '```json\n{"problem":"n/a","priority":null}\n```', 1.0, 5),
            ("m", "large", "c3", "нет json", 0.0, 0),
            ("n", "large", "c3", '{"problem":"другое","priority":"low"}', 4.0, 8),
        ],
        "model string, bucket string, case_id string, raw_response string, elapsed_sec double, completion_tokens int",
    )
    refs = spark.createDataFrame([("c1", ["елки", " "]), ("c3", ["сбой"])], "case_id string, keywords array<string>")
    scored = responses.score_responses(rows, refs, ["problem", "priority"])
    got = {(r.model, r.case_id): (r.json_ok, r.problem_ok, r.completeness, r.tokens_per_sec) for r in scored.collect()}
    assert got == {("m", "c1"): (1, 1, 1.0, 5.0), ("m", "c2"): (1, 0, 0.0, 5.0), ("m", "c3"): (0, 0, 0.0, 0.0), ("n", "c3"): (1, 0, 1.0, 2.0)}
    s = {r.model: r for r in responses.model_summary(scored).collect()}
    assert (s["m"].avg_response_sec, s["m"].tokens_per_sec, s["m"].completeness, s["m"].json_ok, s["m"].problem_ok) == (1.0, 5.0, 0.333, "2/3", "1/3")
    wide = {r.model: (r.small, r.large) for r in responses.bucket_latency(scored, ["small", "large"]).collect()}
    assert wide == {"m": (1.5, 0.0), "n": (None, 4.0)}


def test_truth_lines(spark, tmp_path):
    rows = [("a@0", "a", 0, 5, "т\n\"x\""), ("b@1", "b", 1, 5, "")]
    df = spark.createDataFrame(rows, "seg_id string, file string, start_ms long, duration_ms long, text string")
    files.write_truth(df, str(tmp_path / "t"))
    assert [tuple(r) for r in files.read_truth(spark, str(tmp_path / "t"), lines=True).collect()] == rows[:1]


def test_rttm_files_are_written_by_the_tasks(spark, tmp_path):
    """Every file has its folder, named as Spark names one, and no folder is moved at the end of the job."""
    ids = ["a/b=1", "50%", "", None, *[f"f{i:03d}" for i in range(60)]]
    rows = [(f, float(t), 1.0, "S") for f in ids for t in (2, 0, 1)]
    turns = spark.createDataFrame(rows, "file_id string, start double, dur double, speaker string")
    path = tmp_path / "r"
    (path / "file_id=old").mkdir(parents=True)
    (path / "file_id=old" / "part-0.txt").write_text("SPEAKER old 1 0 1 <NA> <NA> S <NA> <NA>\n")
    files.write_rttm(turns, str(path))
    folders = {p.name for p in path.iterdir() if p.is_dir()}
    assert folders == {"file_id=a%2Fb%3D1", "file_id=50%25", "file_id=__HIVE_DEFAULT_PARTITION__", *[f"file_id=f{i:03d}" for i in range(60)]}
    # Spark's committer names its files after the job.
    assert {p.name.removeprefix("part-").removesuffix(".txt").isdigit() for p in path.glob("*/part-*")} == {True}
    back = files.read_rttm(spark, f"{path}/*").where("file_id like 'f%' or file_id like 'a%' or file_id like '50%'")
    assert sorted((r.file_id, r.start) for r in back.collect()) == sorted((f, t) for f, t, *_ in rows if f)
    lines = "".join(p.read_text() for p in sorted((path / "file_id=f007").glob("*.txt"))).splitlines()
    assert [line.split()[3] for line in lines] == ["0.000", "1.000", "2.000"]
