"""Queries over segments, speech scores, model answers, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkmill.functions import jsonx, transcript
from talkmill.functions.text import too_short
from talkmill.operators import diarize, responses, speech
from talkmill.plans import sample_tables as sample
from talkmill.plans.registry import query, round6, table, texts
from talkmill.plans.sample_tables import HYPOTHESES_SQL, TURNS_SQL
from talkmill.plans.score_queries import BASE, _STAGES, _stages, _top, report_sql
from talkmill.plans.text_queries import WORDS_SQL, normalised_sql, redacted_sql
from talkmill.session import shared_folder
from talkmill.sources import files, tables
from talkmill.streaming import calls as streams


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Transcripts ------------------------------------------------------------------------------------

def _segments(spark, sf_dir):
    """Turns of a conversation as one array; a conversation is a short list of turns."""
    cell = F.struct("seg_idx", "start", "end", "speaker", "text")
    turns = sample.turns(spark, sf_dir)
    return turns.groupBy("file_id").agg(F.sort_array(F.collect_list(cell)).alias("segments"))


_CLOCK = "'[' || format('{:.1f}', \"start\") || '-' || format('{:.1f}', \"end\") || '] '"


@query(
    f"""WITH {TURNS_SQL}
    SELECT file_id, sha1(trim(string_agg(trim(text), ' ' ORDER BY seg_idx))) AS plain_hash,
           sha1(string_agg({_CLOCK} || trim(text), ' | ' ORDER BY seg_idx)) AS timed_hash,
           sha1(string_agg({_CLOCK} || speaker || ': ' || trim(text), ' | ' ORDER BY seg_idx)) AS speaker_hash
    FROM turns GROUP BY file_id"""
)
def timed_transcript(spark, sf_dir):
    return _segments(spark, sf_dir).select(
        "file_id",
        F.sha1(transcript.plain_transcript("segments")).alias("plain_hash"),
        F.sha1(transcript.timed_transcript("segments")).alias("timed_hash"),
        F.sha1(transcript.speaker_transcript("segments")).alias("speaker_hash"),
    )


@query(
    f"""WITH {TURNS_SQL},
    o AS (SELECT file_id, speaker, row_number() OVER (PARTITION BY file_id ORDER BY min(seg_idx)) AS place FROM turns GROUP BY file_id, speaker),
    r AS (SELECT t.*, CASE place WHEN 1 THEN 'звонящий' WHEN 2 THEN 'ответчик' ELSE speaker END AS role FROM turns t JOIN o USING (file_id, speaker))
    SELECT file_id, sha1(string_agg({_CLOCK} || role || ': ' || trim(text), ' | ' ORDER BY seg_idx)) AS role_hash FROM r GROUP BY file_id"""
)
def role_transcript(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    return rows.select("file_id", F.sha1(transcript.role_transcript("segments")).alias("role_hash"))


@query(
    f"""WITH {TURNS_SQL},
    l AS (SELECT *, lag(speaker) OVER w IS DISTINCT FROM speaker AS fresh FROM turns WINDOW w AS (PARTITION BY file_id ORDER BY "start", seg_idx)),
    r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY file_id ORDER BY "start", seg_idx) AS run FROM l),
    m AS (SELECT *, max("end") OVER (PARTITION BY file_id, run ORDER BY "start", seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    o AS (SELECT *, sum((reach IS NULL OR "start" - reach > 3.5)::INT) OVER (PARTITION BY file_id ORDER BY "start", seg_idx) AS island FROM m)
    SELECT file_id, speaker, round(min("start"), 6) AS "start", round(max("end") - min("start"), 6) AS dur FROM o GROUP BY file_id, speaker, island"""
)
def merge_segments(spark, sf_dir):
    merged = diarize.merge_turns(sample.turns(spark, sf_dir), 3.5)
    return round6(merged.select("file_id", "speaker", "start", "dur"))


@query(
    f"""WITH {TURNS_SQL}, {HYPOTHESES_SQL}
    SELECT t.file_id, t.seg_idx AS l_seg_idx, f.system AS r_system, f.speaker AS r_speaker,
           round(least(t."end", f."end") - greatest(t."start", f."start"), 6) AS overlap
    FROM turns t JOIN found f ON t.file_id = f.file_id AND t."start" < f."end" AND f."start" < t."end" """
)
def overlap_join(spark, sf_dir):
    turns = sample.turns(spark, sf_dir).drop("text")
    pairs = diarize.overlap_join(turns, sample.hypotheses(spark, sf_dir), width=16.0)
    return round6(pairs.select("file_id", "l_seg_idx", "r_system", "r_speaker", "overlap"))


_DER = f"""
WITH {TURNS_SQL}, {HYPOTHESES_SQL},
ref AS (SELECT system, file_id, "start" AS s, "end" AS e, speaker FROM turns JOIN (SELECT DISTINCT system, file_id FROM found) USING (file_id)),
hyp AS (SELECT system, file_id, "start" AS s, "end" AS e, speaker FROM found WHERE "end" > "start"),
zone AS (SELECT system, file_id, b - 0.125 AS s, b + 0.125 AS e FROM (SELECT system, file_id, unnest([s, e]) AS b FROM ref)),
cut AS (SELECT DISTINCT system, file_id, t FROM (SELECT system, file_id, unnest([s, e]) AS t FROM ref UNION ALL
        SELECT system, file_id, unnest([s, e]) FROM hyp UNION ALL SELECT system, file_id, unnest([s, e]) FROM zone)),
cell AS (SELECT system, file_id, t AS a, lead(t) OVER (PARTITION BY system, file_id ORDER BY t) AS b FROM cut),
live AS (SELECT c.*, (SELECT list_sort(list(DISTINCT speaker)) FROM ref r WHERE r.system = c.system AND r.file_id = c.file_id AND r.s <= c.a AND c.a < r.e) AS r,
                (SELECT list_sort(list(DISTINCT speaker)) FROM hyp h WHERE h.system = c.system AND h.file_id = c.file_id AND h.s <= c.a AND c.a < h.e) AS h,
                (SELECT count(*) FROM zone z WHERE z.system = c.system AND z.file_id = c.file_id AND z.s <= c.a AND c.a < z.e) AS x
         FROM cell c WHERE b IS NOT NULL),
good AS (SELECT *, b - a AS d, coalesce(len(r), 0) AS nr, coalesce(len(h), 0) AS nh FROM live WHERE x = 0 AND coalesce(len(r), 0) <= 1),
pair AS (SELECT system, file_id, rr, hh, sum(d) AS d FROM (SELECT system, file_id, d, rr, unnest(h) AS hh FROM (SELECT *, unnest(r) AS rr FROM good)) GROUP BY ALL),
names AS (SELECT system, file_id, list_sort(list(DISTINCT hh)) AS hs FROM pair GROUP BY ALL),
orders AS (SELECT * FROM (VALUES (1,2,3),(1,3,2),(2,1,3),(2,3,1),(3,1,2),(3,2,1)) v(user_, assistant_, system_)),
best AS (SELECT system, file_id, max(total) AS hit FROM (
    SELECT p.system, p.file_id, user_, assistant_, sum(CASE WHEN list_position(hs, hh) = CASE rr WHEN 'user' THEN user_ WHEN 'assistant' THEN assistant_ ELSE system_ END THEN d ELSE 0 END) AS total
    FROM pair p JOIN names USING (system, file_id), orders GROUP BY ALL) GROUP BY ALL),
errors AS (SELECT system, file_id, sum(nr * d) AS total, sum(greatest(nr - nh, 0) * d) AS missed, sum(greatest(nh - nr, 0) * d) AS false_alarm,
           sum(least(nr, nh) * d) - coalesce(max(hit), 0) AS confusion FROM good LEFT JOIN best USING (system, file_id) GROUP BY system, file_id)"""


@query(
    f"""{_DER} SELECT system, file_id, round(total, 6) AS total, round(missed, 6) AS missed, round(false_alarm, 6) AS false_alarm,
    round(confusion, 6) AS confusion FROM errors"""
)
def der_files(spark, sf_dir):
    truth, found = sample.turns(spark, sf_dir), sample.hypotheses(spark, sf_dir)
    both = truth.join(found.select("system", "file_id").distinct(), "file_id")
    return round6(diarize.diarization_errors(both, found, ["system", "file_id"]))


@query(
    f"""{_DER}, p AS (SELECT system, format('{{:.2f}}', (missed + false_alarm + confusion) / total * 100)::DOUBLE AS der,
      format('{{:.2f}}', missed / total * 100)::DOUBLE AS ms, format('{{:.2f}}', false_alarm / total * 100)::DOUBLE AS fa,
      format('{{:.2f}}', confusion / total * 100)::DOUBLE AS sc FROM errors)
    SELECT system, count(*) AS n_files, format('{{:.2f}}', avg(der))::DOUBLE AS "DER", format('{{:.2f}}', avg(ms))::DOUBLE AS "MS",
           format('{{:.2f}}', avg(fa))::DOUBLE AS "FA", format('{{:.2f}}', avg(sc))::DOUBLE AS "SC", 0.25::DOUBLE AS "RTF" FROM p GROUP BY system"""
)
def system_table(spark, sf_dir):
    """Mean errors per system."""
    truth, found = sample.turns(spark, sf_dir), sample.hypotheses(spark, sf_dir)
    errors = diarize.system_errors(truth, found)
    runs = found.select("system", "file_id").distinct().withColumns({"time": F.lit(1.0), "audio_sec": F.lit(4.0)})
    table_ = diarize.system_table(errors, runs)
    return table_.select("system", "n_files", "DER", "MS", "FA", "SC", "RTF")


# Recognition errors -----------------------------------------------------------------------------

_WER_TEXT = "trim(regexp_replace(lower(text), '[^а-яa-z0-9]+', ' ', 'g'))"

# m1 drops every fifth word, m2 swaps every seventh word for one that never occurs: the smallest
# number of edits is known without an edit distance.
_ASR = f"""
WITH ref AS (SELECT conv_id || '-' || turn AS seg_id, conv_id, {_WER_TEXT} AS t FROM conversations),
w AS (SELECT seg_id, conv_id, t, string_split(t, ' ') AS w FROM ref WHERE t <> ''),
e AS (SELECT 'm1' AS model, seg_id, conv_id, len(w) AS n, len(w) // 5 AS edits FROM w
      UNION ALL SELECT 'm2', seg_id, conv_id, len(w), len(w) // 7 FROM w)"""


def _recognised(spark, sf_dir):
    rows = texts(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        F.concat_ws("-", "conv_id", "turn").alias("seg_id"), "text", F.length("text").alias("chars")
    )
    from talkmill.functions.text import normalise_for_wer

    words = F.split(normalise_for_wer("text"), " ")
    dropped = F.filter(words, lambda w, i: i % 5 != 4)
    swapped = F.transform(words, lambda w, i: F.when(i % 7 == 6, F.concat(F.lit("qqzz"), i)).otherwise(w))
    hyps = F.array(
        F.struct(F.lit("m1").alias("model"), F.array_join(dropped, " ").alias("hypothesis")),
        F.struct(F.lit("m2").alias("model"), F.array_join(swapped, " ").alias("hypothesis")),
    )
    found = rows.select("seg_id", "chars", F.inline(hyps)).withColumns(
        {"time": F.col("chars") / 100.0, "audio_sec": F.col("chars") / 20.0}
    )
    return speech.scored_segments(found.drop("chars"), rows.select("seg_id", "text"))


@query(f"{_ASR} SELECT model, seg_id, edits::INT AS word_edits, n::INT AS ref_words FROM e")
def wer_pairs(spark, sf_dir):
    return _recognised(spark, sf_dir).select("model", "seg_id", "word_edits", "ref_words")


@query(
    f"""{_ASR} SELECT model, format('{{:.2f}}', sum(edits) / sum(n)::DOUBLE * 100)::DOUBLE AS "WER", 0.2::DOUBLE AS "RTF", count(*) AS n_samples
    FROM e GROUP BY model"""
)
def recognition_table(spark, sf_dir):
    """Word error rates by model; ``character_table`` has the characters."""
    rates = speech.error_rates(_recognised(spark, sf_dir))
    return rates.select("model", "WER", "RTF", "n_samples")


@query(
    f"""{_ASR}, c AS (SELECT length(t) AS n FROM w)
    SELECT 'm3' AS model, format('{{:.2f}}', sum(n // 9) / sum(n)::DOUBLE * 100)::DOUBLE AS "CER", count(*) AS n_samples FROM c"""
)
def character_table(spark, sf_dir):
    """Character error rate where every ninth character is one that never occurs."""
    from talkmill.functions.text import normalise_for_wer

    rows = texts(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    clean = rows.select(F.concat_ws("-", "conv_id", "turn").alias("seg_id"), normalise_for_wer("text").alias("text"))
    swapped = F.regexp_replace("text", r"(?s)(.{8}).", "$1ё")
    found = clean.select(F.lit("m3").alias("model"), "seg_id", swapped.alias("hypothesis"), F.lit(1.0).alias("time"))
    return speech.error_rates(speech.scored_segments(found, clean), None).select("model", "CER", "n_samples")


@query(
    f"""{_ASR}, r AS (SELECT e.*, t, edits / n::DOUBLE AS wer,
        array_to_string(CASE model WHEN 'm1' THEN list_filter(w, lambda x, i: (i - 1) % 5 <> 4)
          ELSE list_transform(w, lambda x, i: CASE WHEN (i - 1) % 7 = 6 THEN 'qqzz' || (i - 1) ELSE x END) END, ' ') AS h
      FROM e JOIN w USING (seg_id))
    SELECT model, rank::INT AS rank, seg_id, round(wer, 6) AS wer, sha1(t) AS reference, sha1(h) AS hypothesis FROM (
      SELECT *, row_number() OVER (PARTITION BY model ORDER BY wer DESC, t DESC, h DESC, seg_id DESC) AS rank FROM r) WHERE rank <= 20"""
)
def worst_segments(spark, sf_dir):
    """The twenty worst segments of each model."""
    worst = speech.worst_segments(_recognised(spark, sf_dir), 20)
    return round6(worst.withColumns({c: F.sha1(c) for c in ("reference", "hypothesis")}))


@query(
    """
    WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents)
    SELECT doc_id, (n // 11)::INT AS char_edits, round(n // 11 * 100.0 / n, 6) AS cer FROM d"""
)
def cer_pairs(spark, sf_dir):
    """Documents against a copy without every eleventh character: the edits are the characters lost."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    cut = F.regexp_replace("text", r"(?s)(.{10}).", "$1")
    edits = speech.char_edits("text", cut)
    rows = docs.select("doc_id", edits.alias("char_edits"), F.length("text").alias("n"))
    # An empty text has no rate: not a number, as in SQL, where Spark's own division is an error.
    cer = F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.col("char_edits") * 100.0 / F.col("n"))
    return round6(rows.select("doc_id", "char_edits", cer.alias("cer")))


# Model answers ----------------------------------------------------------------------------------

_ANSWERS = """
answers AS (
  SELECT event_type AS model, CASE user_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS bucket,
         event_id AS case_id, value AS elapsed_sec, (event_id % 40)::INT AS completion_tokens,
         (props ->> '$.k')::INT AS k, event_id % 6 AS form FROM events),
scored AS (
  SELECT *, form NOT IN (3, 4) AS json_ok, form NOT IN (3, 4) AND (event_id_even OR k % 2 = 0) AS problem_ok,
         CASE WHEN form IN (3, 4) THEN 0 WHEN form = 5 THEN 0.5 ELSE 1.0 END::DOUBLE AS completeness
  FROM (SELECT *, case_id % 2 = 0 AS event_id_even FROM answers))"""


def _answers(spark, sf_dir):
    """Answers in several forms: plain, fenced, with words around, in a list, broken, half filled."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"problem": "Сбой №'), k, F.lit('!", "k": '), k, F.lit("}"))
    half = F.concat(F.lit('{"problem": "Сбой №'), k, F.lit('!", "k": " N/A "}'))
    form = n % 6
    raw = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Ответ: "), body, F.lit(" готово")))
        .when(form == 3, F.concat(F.lit("["), body, F.lit("]")))
        .when(form == 4, F.concat(body.substr(1, 9), F.lit(" обрыв")))
        .otherwise(half)
    )
    third = F.col("user_id") % 3
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("event_type").alias("model"),
        F.when(third == 0, "small").when(third == 1, "medium").otherwise("large").alias("bucket"),
        n.alias("case_id"),
        raw.alias("raw_response"),
        F.col("value").alias("elapsed_sec"),
        (n % 40).cast("int").alias("completion_tokens"),
    )
    # Odd cases expect the even number at or below theirs, which only even numbers contain.
    asked = events.where("event_id % 2 = 1").select(
        n.alias("case_id"),
        F.array(
            F.lit("сбой"),
            F.when(k.cast("int") % 2 == 0, k).otherwise(F.lit("нет такого")),
            F.lit(" "),
        ).alias("keywords"),
    )
    return responses.score_responses(rows, asked, ["problem", "k"])


@query(
    f"""WITH {_ANSWERS}
    SELECT model, bucket, case_id, json_ok::INT AS json_ok, problem_ok::INT AS problem_ok, round(completeness, 6) AS completeness,
           round(coalesce(completion_tokens / nullif(elapsed_sec, 0), 0), 6) AS tokens_per_sec FROM scored"""
)
def scored_answers(spark, sf_dir):
    scored = _answers(spark, sf_dir)
    return round6(
        scored.select("model", "bucket", "case_id", "json_ok", "problem_ok", "completeness", "tokens_per_sec")
    )


@query(
    f"""WITH {_ANSWERS}
    SELECT model, format('{{:.3f}}', avg(elapsed_sec))::DOUBLE AS avg_response_sec,
           format('{{:.2f}}', sum(completion_tokens) / sum(elapsed_sec))::DOUBLE AS tokens_per_sec,
           format('{{:.3f}}', avg(completeness))::DOUBLE AS completeness,
           sum(json_ok::INT) || '/' || count(*) AS json_ok, sum(problem_ok::INT) || '/' || count(*) AS problem_ok
    FROM scored GROUP BY model"""
)
def answer_summary(spark, sf_dir):
    return responses.model_summary(_answers(spark, sf_dir))


@query(
    f"""WITH {_ANSWERS}
    SELECT model, """ + ", ".join(
        f"format('{{:.3f}}', avg(elapsed_sec) FILTER (bucket = '{b}'))::DOUBLE AS {b}" for b in ("small", "medium", "large")
    ) + " FROM scored GROUP BY model"
)
def latency_pivot(spark, sf_dir):
    return responses.bucket_latency(_answers(spark, sf_dir), ["small", "medium", "large"])


@query(
    r"""
    SELECT conv_id, turn, sha1(text) AS text_hash, CASE WHEN turn % 2 = 0 THEN 7
           ELSE greatest(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 1) END::INT AS tokens
    FROM conversations"""
)
def completion_bodies(spark, sf_dir):
    """Texts taken back out of chat-completion bodies, as a string or as parts."""
    text, turn = F.col("text"), F.col("turn")
    whole = F.to_json(F.struct(F.struct(text.alias("content")).alias("message")))
    part = F.struct(F.lit("text").alias("type"), text.alias("text"))
    other = F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))
    parts = F.to_json(F.struct(F.struct(F.array(other, part).alias("content")).alias("message")))
    body = F.when(
        turn % 2 == 0,
        F.concat(F.lit('{"choices": ['), whole, F.lit('], "usage": {"completion_tokens": 7}}')),
    ).otherwise(F.concat(F.lit('{"choices": ['), parts, F.lit("]}")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))
    return rows.select(
        "conv_id", "turn",
        F.sha1(jsonx.completion_text("body")).alias("text_hash"),
        jsonx.completion_tokens("body").alias("tokens"),
    )


@query(
    r"SELECT doc_id, sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash FROM documents"
)
def json_text_fields(spark, sf_dir):
    """Texts under one of several field names, some beside a blank or a number."""
    n, text = F.col("doc_id"), F.col("text")
    raw = (
        F.when(n % 3 == 0, F.to_json(F.struct(text.alias("text"), F.lit("no").alias("body"))))
        .when(n % 3 == 1, F.to_json(F.struct(F.lit("  ").alias("text"), text.alias("content"))))
        .otherwise(F.to_json(F.struct(F.lit(1).alias("transcript"), text.alias("message"))))
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return docs.select("doc_id", F.sha1(jsonx.text_field("raw")).alias("text_hash"))


# Files and streams ------------------------------------------------------------------------------

@query(
    """SELECT doc_id::VARCHAR AS doc_id, sha1(text) AS text_hash,
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS lang FROM documents"""
)
def table_round_trip(spark, sf_dir):
    """Documents written as a delimited file and read back: line breaks, quotes and NA words."""
    path = _folder(spark, "table")
    lang = F.when(F.col("doc_id") % 8 == 0, "NaN").when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("lang"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", lang.alias("lang"))
    tables.write_table(docs, path, ";")
    back = tables.read_table(spark, path, ";")
    return back.select("doc_id", F.sha1("text").alias("text_hash"), "lang")


@query(
    f"""WITH {TURNS_SQL}
    SELECT file_id::VARCHAR AS file_id, speaker, format('{{:.3f}}', "start")::DOUBLE AS "start",
           format('{{:.3f}}', "end" - "start")::DOUBLE AS dur FROM turns"""
)
def rttm_round_trip(spark, sf_dir):
    turns = sample.turns(spark, sf_dir).withColumn("dur", F.col("end") - F.col("start"))
    path = _folder(spark, "rttm")
    files.rttm_lines(turns.withColumn("file_id", F.col("file_id").cast("string"))).select("value").write.text(path)
    return files.read_rttm(spark, path).select("file_id", "speaker", "start", "dur")


@query(
    f"""WITH {TURNS_SQL},
    o AS (SELECT file_id, speaker, row_number() OVER (PARTITION BY file_id ORDER BY min(seg_idx)) - 1 AS place FROM turns GROUP BY file_id, speaker)
    SELECT file_id, printf('SPEAKER_%02d', place) AS speaker, round("start" + 100, 6) AS "start",
           round(format('{{:.3f}}', "end")::DOUBLE + 100, 6) AS "end" FROM turns JOIN o USING (file_id, speaker)"""
)
def dictated_turns(spark, sf_dir):
    """Turns written as dictated intervals, one line per turn, and parsed again."""
    from talkmill.functions.numbers import fixed_text

    letter = F.when(F.col("speaker") == "user", "u").when(F.col("speaker") == "system", "S").otherwise("a")
    line = F.concat(fixed_text("start", 3), F.lit(" - "), fixed_text("end", 3), F.lit(": "), letter, F.lit(" 5-4:zz"))
    lines = sample.turns(spark, sf_dir).select(
        "file_id", F.col("seg_idx").alias("line_no"), F.lit(100.0).alias("offset_sec"), line.alias("line")
    )
    return round6(files.parse_intervals(lines).select("file_id", "speaker", "start", "end"))


@query(
    """
    SELECT 's' || conv_id || '-' || turn AS seg_id, 'f' || conv_id AS file, turn * 4000 AS start_ms, sha1(text) AS text_hash
    FROM conversations WHERE role <> 'system'"""
)
def ground_truth(spark, sf_dir):
    """Segments written as one JSON object per file and read back; blank ones are left out."""
    entry = F.struct(
        F.concat(F.lit("f"), "conv_id").alias("file"),
        (F.col("turn") * 4000).alias("start_ms"),
        F.lit(4000).alias("duration_ms"),
        F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("text"),
    )
    key = F.concat(F.lit("s"), "conv_id", F.lit("-"), "turn")
    rows = table(spark, sf_dir, "conversations").select(key.alias("seg_id"), entry.alias("e"))
    path = _folder(spark, "truth")
    files.write_truth(rows.select("seg_id", "e.*"), path)
    truth = files.read_truth(spark, path, lines=True)
    return truth.select("seg_id", "file", "start_ms", F.sha1("text").alias("text_hash"))


@query("SELECT doc_id::VARCHAR AS filename, sha1(text) AS text_hash FROM documents")
def resumed_append(spark, sf_dir):
    """Documents appended in two runs; the second run holds them all and adds only the new ones."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filename"), "text", "lang")
    path = _folder(spark, "calls")
    tables.append_new(tables.transcript_rows(docs.where("lang = 'en'")), path)
    tables.append_new(tables.transcript_rows(docs), path)
    return spark.read.parquet(path).select("filename", F.sha1("text").alias("text_hash"))


@query(
    """
    SELECT 'u' || user_id AS model, round(max(value), 2) AS f1_weighted, first(notes ORDER BY value DESC) AS notes
    FROM (SELECT user_id, value, CASE WHEN event_type IN (SELECT event_type FROM (SELECT DISTINCT event_type FROM events) ORDER BY 1 LIMIT 1) THEN '007' ELSE '' END AS notes FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) = 1) GROUP BY user_id"""
)
def comparison_files(spark, sf_dir):
    """A comparison file per event type, read with numbers inferred and notes as text, best row per model."""
    from talkmill.operators.report import merged_leaderboard

    paths = []
    events = table(spark, sf_dir, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # one file each
    for kind in kinds:
        note = "007" if kind == kinds[0] else None
        rows = events.where(F.col("event_type") == kind)
        path = _folder(spark, kind) + "/comparison.csv"
        rows.select(
            F.concat(F.lit("u"), "user_id").alias("model"),
            F.col("value").alias("f1_weighted"),
            F.lit(note).cast("string").alias("notes"),
        ).write.option("header", True).csv(path)
        paths.append(path)
    best = merged_leaderboard([files.read_comparisons(spark, paths)], best_only=True)
    return best.select("model", F.round("f1_weighted", 2).alias("f1_weighted"), "notes")


@query(
    f"""{BASE}, {report_sql('top', 'model')} SELECT model, n, errors, accuracy, f1_weighted FROM quality"""
)
def summary_files(spark, sf_dir):
    """Metrics written as nested JSON and read back."""
    from talkmill.operators.metrics import summary

    scores = round6(summary(_top(spark, sf_dir), ["model"]))
    path = _folder(spark, "summary")
    tables.write_summary(scores.select("model", F.struct("n", "errors", "accuracy", "f1_weighted").alias("metrics")), path)
    schema = "model string, metrics struct<n:bigint,errors:bigint,accuracy:double,f1_weighted:double>"
    return spark.read.schema(schema).json(path).select("model", "metrics.*")


@query(
    f"""
    WITH c AS (SELECT lang, {normalised_sql(redacted_sql('text'))} AS t FROM documents)
    SELECT lang, count(*) AS n_rows, sum(length(t))::BIGINT AS chars, count(*) FILTER ({WORDS_SQL.format('t')} < 50) AS short
    FROM c GROUP BY lang"""
)
def streamed_preparation(spark, sf_dir):
    """Documents prepared as they arrive, each once, and counted from the written rows."""
    source = table(spark, sf_dir, "documents")
    out, state = _folder(spark, "prepared"), _folder(spark, "state")
    # The table is a file or a folder of files; Spark streams either from a pattern, a plain path has to be a folder.
    arriving = streams.arriving(spark, f"{sf_dir}/{{documents}}.parquet", source.schema, spark.sparkContext.defaultParallelism)
    prepared = streams.prepare_calls(arriving.select("doc_id", "lang", "text"), 50, phrases=False)
    # Each file is read once and ids are unique, so no ids are kept as state.
    streams.write_stream(prepared, out, state).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.length("text")).alias("chars"),
        F.count_if(too_short("text", 50)).alias("short"),
    )


@query(
    f"""{BASE}, {_STAGES}, r AS (SELECT y_pred, CASE WHEN y_pred <> 'spam' AND confidence >= 0.2 THEN 'auto' ELSE 'review' END AS route FROM routed)
    SELECT route, y_pred, count(*) AS n FROM r GROUP BY ALL"""
)
def streamed_routing(spark, sf_dir):
    """Classified calls routed as they arrive, one folder per route."""
    inbox, out, state = (_folder(spark, n) for n in ("inbox", "routed", "state"))
    _stages(spark, sf_dir).write.parquet(inbox)
    arriving = streams.arriving(spark, inbox, spark.read.parquet(inbox).schema)
    streams.route_stream(arriving, out, state, 0.2).awaitTermination()
    return spark.read.parquet(out).groupBy("route", "y_pred").agg(F.count("*").alias("n"))
