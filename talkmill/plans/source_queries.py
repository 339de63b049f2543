"""Queries over written files, manifests, logs, fold manifests and second-level checks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from talkmill.functions import text
from talkmill.operators import ensemble, split
from talkmill.operators.metrics import summary
from talkmill.plans import models, sample_tables as sample, train
from talkmill.plans.model_queries import _parts, _SPLIT_SQL
from talkmill.plans.models import Spec
from talkmill.plans.registry import query, round6, table, texts
from talkmill.plans.sample_tables import TRUTH_SQL, TURNS_SQL
from talkmill.plans.score_queries import report_sql
from talkmill.plans.speech_queries import _folder
from talkmill.sources import files, tables

_SPACES = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("SELECT doc_id, lang, sha1(text) AS text_hash FROM documents WHERE lang <> 'de'")
def snapshot_rows(spark, sf_dir):
    """Prepared rows saved as columnar files and read with a filter that reaches the scan."""
    path = _folder(spark, "snapshot")
    tables.save_snapshot(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.parquet(path).where("lang <> 'de'").select("doc_id", "lang", F.sha1("text").alias("text_hash"))


@query(f"SELECT 'item=' || item_id AS bucket, sha1({_SPACES}) AS text_hash FROM benchmark")
def case_files(spark, sf_dir):
    """Benchmark items as one JSON file each, found again as cases of their folders."""
    path = _folder(spark, "cases")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    items.write.partitionBy("item").json(path)
    return files.read_cases(spark, path, ["*"]).select("bucket", F.sha1("text").alias("text_hash"))


@query(
    """
    SELECT item_id::VARCHAR AS case_id, CASE item_id % 3 WHEN 0 THEN text[1:40] WHEN 1 THEN lower(text[1:20]) || '|zz' ELSE text[1:10] END AS keywords
    FROM benchmark"""
)
def reference_manifest(spark, sf_dir):
    """Reference entries as a text, a list, and an object that holds one, in manifests of a hundred items."""
    n, body = F.col("item_id"), F.col("text")
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.lit(1 << 20))
    bare = lambda c: F.regexp_replace(quoted(c), r"\}$", "")
    entry = (
        F.when(n % 3 == 0, bare(F.substring(body, 1, 40)))
        .when(n % 3 == 1, F.concat(F.lit("["), bare(F.lower(F.substring(body, 1, 20))), F.lit(', " ", "zz"]')))
        .otherwise(F.concat(F.lit('{"problem_keywords": '), bare(F.substring(body, 1, 10)), F.lit("}")))
    )
    line = F.concat(F.lit('"'), n, F.lit('": '), entry)
    items = table(spark, sf_dir, "benchmark").select(F.floor(n / 100).alias("part"), line.alias("line"))
    path = _folder(spark, "manifest")
    whole = items.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("line"), ", "), F.lit("}")).alias("value"))
    whole.write.partitionBy("part").text(path)
    entries = files.read_references(spark, path + "/*")
    return entries.select("case_id", F.array_join("keywords", "|").alias("keywords"))


@query(
    f"""WITH {TURNS_SQL}
    SELECT file_id::VARCHAR AS file_id, speaker, format('{{:.3f}}', "start")::DOUBLE AS "start",
           format('{{:.3f}}', "end" - "start")::DOUBLE AS dur FROM turns"""
)
def rttm_files(spark, sf_dir):
    """Turns written as one folder of RTTM per file and read from all of them."""
    turns = sample.turns(spark, sf_dir).withColumn("dur", F.col("end") - F.col("start"))
    path = _folder(spark, "rttm-files")
    files.write_rttm(turns.withColumn("file_id", F.col("file_id").cast("string")), path)
    return files.read_rttm(spark, path + "/*").select("file_id", "speaker", "start", "dur")


@query(
    """
    SELECT 'e' || event_id AS model, 'c' || user_id % 3 AS label, round(value / 1000, 6) AS precision, (user_id % 50)::BIGINT AS support,
           CASE WHEN event_id % 400 < 200 THEN 'list' ELSE 'object' END AS form, round(value, 6) AS train_sec
    FROM events"""
)
def run_logs(spark, sf_dir):
    """Run logs of two hundred records each, as lists and as objects, read back with their class reports."""
    n = F.col("event_id")
    label = F.concat(F.lit("c"), F.col("user_id") % 3)
    cell = lambda value, support: F.struct(value.alias("precision"), value.alias("recall"), value.alias("f1-score"), support.alias("support"))
    entry = F.create_map(label, cell(F.col("value") / 1000, F.col("user_id") % 50), F.lit("macro avg"), cell(F.lit(1.0), F.lit(1).cast("long")))
    record = F.struct(F.concat(F.lit("e"), n).alias("model"), F.col("value").alias("train_sec"), entry.alias("report"))
    logs = table(spark, sf_dir, "events").groupBy(F.floor(n / 200).alias("log")).agg(F.collect_list(record).alias("models"))
    listed = F.to_json("models")
    value = F.when(F.col("log") % 2 == 0, listed).otherwise(F.concat(F.lit('{"models": '), listed, F.lit("}")))
    path = _folder(spark, "logs")
    logs.select(F.when(F.col("log") % 2 == 0, "list").otherwise("object").alias("form"), "log", value.alias("value")).write.partitionBy("form", "log").text(path)
    read = files.read_run_logs(spark, path + "/*/*")
    reports = files.run_log_reports(read).select("model", "label", "precision", "support")
    form = F.regexp_extract("source_dir", "form=([a-z]+)", 1).alias("form")
    return round6(reports.join(read.select("model", form, "train_sec"), "model"))


@query(
    """
    SELECT c AS rows, e AS error, (SELECT count(*) FROM documents) AS n FROM (VALUES ('same', ''),
      ('other k', 'fold manifest was built for 4 folds, not 5'), ('changed text', 'fold manifest does not match the rows'),
      ('missing row', 'fold manifest expects ' || (SELECT count(*) FROM documents) || ' rows, the table has ' || (SELECT count(*) - 1 FROM documents))) v(c, e)"""
)
def manifest_checks(spark, sf_dir):
    """A saved fold manifest against the rows it was made for, and against others."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label"))
    path = _folder(spark, "folds")
    split.fold_manifest(split.k_folds(docs, "label", 4), "label").write.parquet(path)
    manifest = spark.read.parquet(path)
    first = docs.agg(F.min("row_id")).first()[0]
    changed = docs.withColumn("text", F.when(F.col("row_id") == first, "other").otherwise(F.col("text")))
    out = []
    for name, rows, k in (("same", docs, 4), ("other k", docs, 5), ("changed text", changed, 4), ("missing row", docs.where(F.col("row_id") != first), 4)):
        try:
            split.check_manifest(manifest, rows, "label", k)
            out.append((name, ""))
        except ValueError as error:
            out.append((name, str(error)))
    return spark.createDataFrame(out, "rows string, error string").withColumn("n", F.lit(docs.count()).cast("long"))


@query(
    f"""WITH {TRUTH_SQL}, l AS (SELECT DISTINCT y_true FROM truth)
    SELECT 'fits' AS stacker, 'm2,m0' AS outcome, (SELECT count(*) FROM l) AS labels
    UNION ALL SELECT 'lacks a label', 'labels the stacker has not seen: [''' || (SELECT min(y_true) FROM l) || ''']', (SELECT count(*) FROM l)
    UNION ALL SELECT 'lacks a model', 'stacker expects models [''m9''], which are not among [''m0'', ''m2'']', (SELECT count(*) FROM l)"""
)
def stacker_checks(spark, sf_dir):
    """Metadata of second levels against the models at hand and the labels of all rows."""
    truth = sample.truth(spark, sf_dir)
    labels = sorted(r[0] for r in truth.select("y_true").distinct().collect())  # one per class
    cases = {
        "fits": ensemble.stacker_metadata("logreg", ["m2", "m0"], labels),
        "lacks a label": ensemble.stacker_metadata("logreg", ["m2", "m0"], labels[1:]),
        "lacks a model": ensemble.stacker_metadata("logreg", ["m0", "m9"], labels),
    }
    out = []
    for name, metadata in cases.items():
        try:
            out.append((name, ",".join(ensemble.check_stacker(json.loads(json.dumps(metadata)), ["m0", "m2"], truth)), len(labels)))
        except ValueError as error:
            out.append((name, str(error), len(labels)))
    return spark.createDataFrame(out, "stacker string, outcome string, labels long")


@query("SELECT doc_id, sha1(text) AS text_hash FROM documents")
def compatibility_forms(spark, sf_dir):
    """Texts written in full-width and circled characters, brought back by Unicode normalisation."""
    plain = "".join(chr(c) for c in range(0x21, 0x7F))
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    odd = F.translate("text", plain, wide)
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").withColumn("odd", odd)
    return docs.select("doc_id", F.sha1(text.nfkc("odd")).alias("text_hash"))


def _bayes_sql(name: str, alpha: float) -> str:
    """Scores of naive Bayes with another smoothing for every held-out row and class."""
    return f"""
    {name}_theta AS (SELECT label, term, ln(coalesce(c, 0) + {alpha}) - ln(t + {alpha} * (SELECT count(*) FROM vocab)) AS w
              FROM classes CROSS JOIN vocab LEFT JOIN counts USING (label, term) JOIN totals USING (label)),
    {name} AS (SELECT '{name}' AS model, p.row_id, p.label AS y_true, k.label AS label,
                      ln(k.n + {alpha}) + coalesce((SELECT sum(t.tf * h.w) FROM terms t JOIN {name}_theta h USING (term)
                                                WHERE t.row_id = p.row_id AND h.label = k.label), 0) AS s
               FROM parts p CROSS JOIN classes k WHERE held)"""


@query(
    f"""
    WITH {_SPLIT_SQL},
    vocab AS (SELECT term FROM terms JOIN parts USING (row_id) WHERE NOT held GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 15000),
    classes AS (SELECT label, count(*) AS n FROM parts WHERE NOT held GROUP BY label),
    counts AS (SELECT label, term, sum(tf) AS c FROM terms JOIN parts USING (row_id) JOIN vocab USING (term) WHERE NOT held GROUP BY ALL),
    totals AS (SELECT label, sum(c) AS t FROM counts GROUP BY label),
    {_bayes_sql('nb1', 0.1)}, {_bayes_sql('nb2', 50.0)},
    every AS (SELECT *, s - max(s) OVER w AS d FROM (SELECT * FROM nb1 UNION ALL SELECT * FROM nb2) WINDOW w AS (PARTITION BY model, row_id)),
    probs AS (SELECT model, row_id, y_true, label, exp(d) / sum(exp(d)) OVER (PARTITION BY model, row_id) AS p FROM every),
    single AS (SELECT model, 'base' AS method, row_id, y_true, first(label ORDER BY p DESC, label) AS y_pred FROM probs GROUP BY ALL),
    mean AS (SELECT row_id, y_true, label, round(avg(p), 12) AS p FROM probs GROUP BY ALL),
    votes AS (SELECT * FROM single UNION ALL
              SELECT 'Ensemble (soft)', 'soft', row_id, y_true, first(label ORDER BY p DESC, label) FROM mean GROUP BY row_id, y_true),
    {report_sql('votes', 'model, method')}
    SELECT * FROM quality"""
)
def voting(spark, sf_dir):
    """Two classical models and their soft vote on held-out rows."""
    fit, test = _parts(spark, sf_dir)
    catalogue = {f"nb{i}": Spec("counts", "multinomial_nb", options={"smoothing": a}) for i, a in ((1, 0.1), (2, 50.0))}
    _, quality, _ = train.voting_ensemble(fit, test, catalogue)
    return round6(quality)
