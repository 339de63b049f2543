"""Queries over text: redaction, normalisation, lengths, tokens and label columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import fixed, redact, text
from talkmill.functions.columns import strip, unicode_re
from talkmill.operators import labels, metrics, split
from talkmill.plans import features, prepare
from talkmill.plans.registry import query, round6, table, texts
from talkmill.plans.sample_tables import CALLS_SQL, calls

RULE_NAMES = "url email dictated_email phone dictated_phone spelled_phone ip contract digits".split()


def _dialect(pattern: str, ignore: bool) -> str:
    """A redaction pattern for the checking engine.

    It has no possessive repeats, which only save time here, no lookahead (``#\\s*(?=\\w)`` is followed by a word character anyway),
    and its ``\\w`` knows ASCII only.
    """
    plain = pattern.replace("}+", "}").replace(r"(?=\w)", "").replace(r"[\w", r"[\p{L}\p{N}_")
    return ("(?i)" if ignore else "") + plain


RULES = [
    (name, _dialect(pattern, ignore), fixed.PLACEHOLDERS[kind])
    for name, (kind, pattern, ignore) in zip(RULE_NAMES, fixed.REDACTIONS)
]


def redacted_sql(column: str) -> str:
    out = column
    for _, pattern, token in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{token}', 'g')"
    return out


def normalised_sql(column: str) -> str:
    """Normalisation for text that NFKC leaves alone; long repeats go character by character."""
    lowered = f"lower(regexp_replace({column}, '\\pC', '', 'g'))"
    spaced = f"regexp_replace({lowered}, '[\\\\|@#$%^&*=+<>~`]', ' ', 'g')"
    squeezed = (
        f"list_reduce(list_distinct(string_split({spaced}, '')), "
        "lambda acc, c: regexp_replace(acc, '(?:' || regexp_escape(c) || '){4,}', "
        "replace(c, '\\', '\\\\') || replace(c, '\\', '\\\\'), 'g'), "
        f"{spaced})"
    )
    return f"trim(regexp_replace({squeezed}, '\\s+', ' ', 'g'))"


WORDS_SQL = r"len(regexp_extract_all({0}, '\S+'))"


@query(
    f"""
    WITH r AS (SELECT lang, text, {redacted_sql('text')} AS clean FROM documents)
    SELECT lang, count(*) AS n_rows, count(*) FILTER (text <> clean) AS redacted,
           count(*) FILTER (contains(clean, '[EMAIL]')) AS with_email,
           count(*) FILTER (contains(clean, '[ТЕЛЕФОН]')) AS with_phone,
           count(*) FILTER (contains(clean, '[IP]')) AS with_ip,
           count(*) FILTER (contains(clean, '[НОМЕР]')) AS with_number,
           count(*) FILTER ({WORDS_SQL.format('clean')} < 50) AS short,
           sum({WORDS_SQL.format('clean')})::BIGINT AS tokens
    FROM r GROUP BY lang"""
)
def prep_report(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "lang", "text")
    clean = docs.withColumn("clean", redact.redact_pii("text"))

    def holds(token):
        return F.count_if(F.contains("clean", F.lit(token)))

    return clean.groupBy("lang").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("text") != F.col("clean")).alias("redacted"),
        holds("[EMAIL]").alias("with_email"),
        holds("[ТЕЛЕФОН]").alias("with_phone"),
        holds("[IP]").alias("with_ip"),
        holds("[НОМЕР]").alias("with_number"),
        F.count_if(text.too_short("clean", 50)).alias("short"),
        F.sum(text.token_count("clean")).alias("tokens"),
    )


@query(f"SELECT doc_id, sha1({redacted_sql('text')}) AS clean_hash FROM documents")
def pii_redact(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.sha1(redact.redact_pii("text")).alias("clean_hash"))


@query(
    "SELECT source, " + ", ".join(
        f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}" for n, p, _ in RULES
    ) + " FROM documents GROUP BY source"
)
def pii_counts(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "source", "text")
    hits = [
        F.count_if(F.col("text").rlike(unicode_re(pattern, ignore))).alias(name)
        for name, (_, pattern, ignore) in zip(RULE_NAMES, fixed.REDACTIONS)
    ]
    return docs.groupBy("source").agg(*hits)


@query(
    r"""
    SELECT page_id, regexp_replace(url, 'https?://\S+|www\.\S+', '[ССЫЛКА]', 'g') AS url,
           sha1(regexp_replace(html, 'https?://\S+|www\.\S+', '[ССЫЛКА]', 'g')) AS html_hash
    FROM pages"""
)
def url_redact(spark, sf_dir):
    pages = texts(spark, sf_dir, "pages", "page_id", "url", "html")
    return pages.select(
        "page_id",
        redact.redact_one("url", 0).alias("url"),
        F.sha1(redact.redact_one("html", 0)).alias("html_hash"),
    )


@query(
    """
    WITH words AS (SELECT doc_id, text, string_split(text, ' ')[1] AS w FROM documents)
    SELECT doc_id, sha1('[ИМЯ]' || text[length(w) + 1:]) AS text_hash FROM words"""
)
def span_redact(spark, sf_dir):
    """The first word of every text is given as a person, its second letter as an ignored type."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.length(F.get(F.split("text", " "), F.lit(0)))
    spans = docs.select("doc_id", F.lit(0).alias("start"), size.alias("end"), F.lit("PER").alias("type"))
    other = docs.select("doc_id", F.lit(1).alias("start"), F.lit(2).alias("end"), F.lit("MISC").alias("type"))
    done = redact.redact_spans(docs, spans.unionByName(other), row_id="doc_id")
    return done.select("doc_id", F.sha1("text").alias("text_hash"))


@query(
    r"""
    WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS w FROM documents)
    SELECT doc_id, sha1(array_to_string(list_transform(w, lambda x: CASE lower(x) WHEN 'the' THEN 'a'
      WHEN 'and' THEN 'or' WHEN 'été' THEN 'être' WHEN 'für' THEN 'vor' ELSE x END), '')) AS text_hash FROM p"""
)
def lemma_replace(spark, sf_dir):
    """Words replaced by a dictionary; other words, spacing and punctuation stay in place."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    words = [("the", "a"), ("and", "or"), ("été", "être"), ("für", "vor")]
    pairs = spark.createDataFrame(words, "form string, lemma string")
    done = redact.lemmatise(docs, pairs)
    return done.select("doc_id", F.sha1("text").alias("text_hash"))


@query(f"SELECT doc_id, sha1({normalised_sql('text')}) AS text_hash FROM documents")
def normalised_text(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.sha1(text.normalise("text")).alias("text_hash"))


@query(
    f"""
    WITH c AS (SELECT doc_id, {normalised_sql(redacted_sql('text'))} AS t FROM documents)
    SELECT doc_id, sha1(t) AS text_hash, {WORDS_SQL.format('t')} < 50 AS too_short FROM c"""
)
def clean_documents(spark, sf_dir):
    """The whole per-row chain: redaction, organisations and names, normalisation, length flag."""
    docs = text.clean_table(texts(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("text", "t")
    return docs.select("doc_id", F.sha1("t").alias("text_hash"), text.too_short("t", 50).alias("too_short"))


@query(
    f"""
    WITH c AS (SELECT doc_id, text, {normalised_sql(redacted_sql('text'))} AS t FROM documents)
    SELECT doc_id, sha1(CASE WHEN doc_id < 500 THEN text ELSE t END) AS text_hash,
           CASE WHEN doc_id < 500 THEN '' ELSE sha1(text) END AS original_hash,
           CASE WHEN doc_id < 500 THEN '' WHEN {WORDS_SQL.format('t')} < 50 THEN 'True' ELSE 'False' END AS too_short FROM c"""
)
def partial_reprocess(spark, sf_dir):
    """Rows before a start row stay as they are, later rows are processed."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    done = prepare.clean_transcripts(docs, row_id="doc_id", start_row=500, min_tokens=50)
    kept = F.col("text_original") == ""
    return done.select(
        "doc_id",
        F.sha1("text").alias("text_hash"),
        F.when(kept, "").otherwise(F.sha1("text_original")).alias("original_hash"),
        "too_short",
    )


PHRASES = [r"\bthe\s+(?:the\s+)?of\b", r"\band\s+the\b", r"\bthat\b", r"\bfor\s+(?:a\b)?"]


def _noise_sql() -> str:
    out = "text"
    for p in PHRASES:
        out = f"regexp_replace({out}, '(?i){p}', ' ', 'g')"
    out = f"regexp_replace({out}, '^[\\s,.:;!?\\-]+', '')"
    out = f"regexp_replace({out}, '[\\s,.:;!?\\-]+$', '')"
    return f"trim(regexp_replace({out}, '\\s{{2,}}', ' ', 'g'))"


@query(
    f"""
    WITH c AS (SELECT doc_id, {_noise_sql()} AS t FROM documents)
    SELECT doc_id, sha1(t) AS text_hash, {WORDS_SQL.format('t')} < 60 AS too_short FROM c"""
)
def noise_removed(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.remove_noise("text", PHRASES).alias("t"))
    return docs.select("doc_id", F.sha1("t").alias("text_hash"), text.too_short("t", 60).alias("too_short"))


@query(
    f"""
    WITH t AS (SELECT lang, {WORDS_SQL.format('text')} AS n FROM documents)
    SELECT lang, count(*) AS n, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median,
           round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95,
           round(quantile_cont(n, 0.99), 6) AS p99, max(n)::INT AS max
    FROM t GROUP BY lang"""
)
def token_lengths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", text.token_count("text").alias("n_tokens"))
    return round6(metrics.length_summary(docs, "n_tokens", ["lang"]))


@query(
    f"""
    WITH t AS (SELECT {WORDS_SQL.format('text')} AS n FROM documents)
    SELECT threshold, (SELECT count(*) FROM t WHERE n > threshold) AS longer,
           round((SELECT count(*) FROM t WHERE n > threshold) / (SELECT count(*) FROM t)::DOUBLE, 6) AS share
    FROM (VALUES (128), (256), (512)) v(threshold)"""
)
def length_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(text.token_count("text").alias("n"))
    return round6(metrics.length_coverage(docs, "n"))


@query(
    r"""
    SELECT doc_id, greatest(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 1)::INT AS tokens,
           sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS flat_hash
    FROM documents"""
)
def token_estimate(spark, sf_dir):
    from talkmill.functions.columns import collapse_spaces

    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(
        "doc_id",
        text.estimate_tokens("text").alias("tokens"),
        F.sha1(collapse_spaces("text")).alias("flat_hash"),
    )


@query(
    r"""
    SELECT doc_id,
           sha1(trim(regexp_replace(lower(text), '[^а-яa-z0-9]+', ' ', 'g'))) AS wer_hash,
           sha1(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS match_hash
    FROM documents"""
)
def comparison_forms(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(
        "doc_id",
        F.sha1(text.normalise_for_wer("text")).alias("wer_hash"),
        F.sha1(text.normalise_for_match("text")).alias("match_hash"),
    )


@query(
    r"""
    WITH f AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d__%H-%M-%S') || '_a.mp3'
                                ELSE 'call' || event_id END AS name FROM events)
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN name[:20] ELSE name END AS filename,
           CASE WHEN event_id % 2 = 0 THEN replace(name[:10] || ' ' || replace(name[13:20], '-', ':'), '__', ' ') END AS call_time
    FROM f"""
)
def file_names(spark, sf_dir):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'__'HH-mm-ss"), F.lit("_a.mp3"))
    name = F.when(F.col("event_id") % 2 == 0, stamp).otherwise(F.concat(F.lit("call"), "event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return rows.select(
        "event_id",
        text.clean_filename("name").alias("filename"),
        text.call_time("name").cast("string").alias("call_time"),
    )


@query(
    f"""
    WITH t AS (SELECT lang, regexp_matches(text, '(?i){fixed.COMMERCIAL_WORDS}') AS c,
                      regexp_matches(text, '(?i){fixed.TECHNICAL_WORDS}') AS t FROM documents)
    SELECT lang, sum(c::INT)::DOUBLE AS commercial, sum(t::INT)::DOUBLE AS technical FROM t GROUP BY lang"""
)
def keyword_counts(spark, sf_dir):
    commercial, technical = text.keyword_flags("text")
    docs = texts(spark, sf_dir, "documents", "lang", "text")
    return docs.groupBy("lang").agg(
        F.sum(commercial).alias("commercial"), F.sum(technical).alias("technical")
    )


@query(
    r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)
    SELECT doc_id, sha1(array_to_string(w[:128], ' ')) AS head_hash,
           sha1(array_to_string(CASE WHEN len(w) > 129 THEN list_concat(w[:65], w[-64:]) ELSE w END, ' ')) AS cut_hash
    FROM t"""
)
def truncated_tokens(spark, sf_dir):
    words = F.regexp_extract_all(F.col("text"), F.lit(r"((?U)\S+)"), F.lit(1))
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", words.alias("w"))

    def digest(strategy, n):
        return F.sha1(F.array_join(text.truncate_tokens("w", n, strategy), " "))

    return docs.select(
        "doc_id", digest("head", 128).alias("head_hash"), digest("middle_cut", 129).alias("cut_hash")
    )


def _u(salt: str) -> str:
    return (
        f"(('0x' || substr(sha1(concat_ws(chr(31), doc_id::VARCHAR, i::VARCHAR, '42{salt}')), 1, 8))::BIGINT"
        " / 4294967296.0::DOUBLE)"
    )


@query(
    f"""
    WITH d AS (SELECT doc_id, text, length(text) AS n,
                      unnest(range(greatest(length(text) // 500, 1))) AS i FROM documents),
    s AS (SELECT *, CASE WHEN {_u('s')} < 0.15 THEN 100 + floor({_u('n')} * 401)::INT ELSE 500 END AS size FROM d),
    p AS (SELECT *, floor({_u('p')} * (greatest(n - size, 0) + 1))::INT AS "start" FROM s)
    SELECT doc_id, i::INT AS window_no, "start", sha1(substr(text, "start" + 1, size)) AS chunk_hash FROM p"""
)
def char_windows(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    cut = text.char_windows(docs, row_id="doc_id", char_window=500)
    return cut.select("doc_id", "window_no", "start", F.sha1("chunk").alias("chunk_hash"))


TERMS_SQL = r"""
terms AS (
  SELECT doc_id AS row_id, w, len(w) AS n FROM
    (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)),
grams AS (
  SELECT row_id, unnest(w) AS term FROM terms
  UNION ALL
  SELECT row_id, unnest(list_transform(range(1, n), lambda i: w[i] || ' ' || w[i + 1])) FROM terms)"""


@query(
    f"""
    WITH {TERMS_SQL}
    SELECT term, count(*) AS corpus_count, count(DISTINCT row_id) AS df FROM grams
    GROUP BY term ORDER BY corpus_count DESC, term LIMIT 15000"""
)
def top_terms(spark, sf_dir):
    """The 15,000 most frequent words and word pairs, ties by term."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return features.vocabulary(docs, high=2, max_features=15_000)


@query(f"WITH {TERMS_SQL} SELECT row_id, term, count(*) AS tf FROM grams GROUP BY ALL")
def ngram_counts(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "row_id")
    return features.term_rows(docs, high=2)


@query(
    f"""
    WITH {TERMS_SQL},
    tf AS (SELECT row_id, term, count(*) AS tf FROM grams GROUP BY ALL),
    df AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2
           ORDER BY total DESC, term LIMIT 5000),
    w AS (SELECT row_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w
          FROM tf JOIN df USING (term))
    SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM w"""
)
def tfidf_weights(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "row_id")
    return round6(features.tfidf_rows(docs, high=2, max_features=5000, min_df=2))


# Labels -----------------------------------------------------------------------------------------

ALIASES = {"click": "interaction", "view": "view", "purchase": "sale"}
_EVENT_SQL = """
  SELECT CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'click' THEN 'interaction'
              WHEN event_type = 'purchase' THEN 'sale' ELSE event_type END AS label FROM events"""


def _event_labels(spark, sf_dir):
    messy = F.concat(F.lit(" "), F.upper("event_type"), F.lit("\t"))
    return table(spark, sf_dir, "events").select(messy.alias("event_type"))


@query(f"SELECT label, count(*) AS n FROM ({_EVENT_SQL}) GROUP BY label")
def label_normalise(spark, sf_dir):
    rows = _event_labels(spark, sf_dir)
    label = labels.normalise_label("event_type", ALIASES, ["error"])
    return labels.label_counts(rows.select(label.alias("event_type")), "event_type")


@query("SELECT event_type AS label, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1")
def unknown_labels(spark, sf_dir):
    return labels.unknown_labels(_event_labels(spark, sf_dir), "event_type", ALIASES, ["error"])


@query(
    """
    SELECT stage, label, count(*) AS n FROM (
      SELECT 'before' AS stage, event_type AS label FROM events
      UNION ALL SELECT 'after', CASE event_type WHEN 'signup' THEN 'purchase' WHEN 'view' THEN 'click' ELSE event_type END FROM events)
    GROUP BY ALL"""
)
def remap_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return labels.remap_counts(events, "event_type", {"signup": "purchase", "view": "click"})


@query(
    """
    SELECT source AS label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS percent
    FROM documents GROUP BY source"""
)
def class_distribution(spark, sf_dir):
    return round6(labels.class_distribution(table(spark, sf_dir, "documents"), "source"))


@query(
    """
    SELECT source AS label, count(*) AS n,
           round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT source) FROM documents) * count(*))::DOUBLE, 6) AS weight
    FROM documents GROUP BY source"""
)
def class_weights(spark, sf_dir):
    return round6(metrics.class_weights(table(spark, sf_dir, "documents"), "source"))


@query(
    f"""
    WITH {CALLS_SQL}, n AS (
      SELECT row_id, CASE WHEN lower(trim(priority)) IN ('?', '-', 'ge', '') THEN '' ELSE lower(trim(priority)) END AS priority,
             lower(trim(call_purpose)) AS call_purpose, assigned_group FROM calls)
    SELECT priority, call_purpose, count(*) AS n_rows, count(DISTINCT assigned_group) AS n_groups FROM n GROUP BY ALL"""
)
def normalised_labels(spark, sf_dir):
    rows = labels.normalise_labels(calls(spark, sf_dir))
    return rows.groupBy("priority", "call_purpose").agg(
        F.count("*").alias("n_rows"), F.count_distinct("assigned_group").alias("n_groups")
    )


@query(f"WITH {CALLS_SQL} SELECT row_id FROM calls WHERE trim(is_training_sample) = '1'")
def training_rows(spark, sf_dir):
    return labels.training_rows(calls(spark, sf_dir)).select("row_id")


@query(
    f"""
    WITH {CALLS_SQL}
    SELECT CASE WHEN filename LIKE '2024-%' THEN filename[:20] ELSE filename END AS filename, sha1(text) AS text_hash,
           call_purpose, priority, assigned_group AS assig_group
    FROM calls WHERE trim(call_purpose) <> ''"""
)
def ready_rows(spark, sf_dir):
    ready = labels.keep_ready_rows(calls(spark, sf_dir))
    return ready.withColumn("text", F.sha1("text")).withColumnRenamed("text", "text_hash")


@query(
    f"""
    WITH {CALLS_SQL}
    SELECT count(*) AS before, count(*) FILTER (trim(call_purpose) = '') AS dropped,
           count(*) FILTER (trim(call_purpose) <> '') AS after FROM calls"""
)
def ready_counts(spark, sf_dir):
    return labels.ready_counts(calls(spark, sf_dir))


@query(
    f"""
    WITH {CALLS_SQL}, n AS (SELECT row_id, assigned_group FROM calls WHERE lower(trim(call_purpose)) <> 'spam')
    SELECT row_id, assigned_group FROM n
    WHERE assigned_group IN (
        SELECT assigned_group FROM n GROUP BY 1
        HAVING count(*) >= (SELECT ceil(count(*) / count(DISTINCT assigned_group)) FROM n))"""
)
def rare_class_filter(spark, sf_dir):
    """Classes of at least the mean size, so some are left whatever the data."""
    rows = calls(spark, sf_dir)
    kept = rows.where(F.lower(strip("call_purpose")) != "spam")
    mean = kept.agg(F.ceil(F.count("*") / F.count_distinct("assigned_group"))).first()[0]
    rows = labels.dataset_variant(rows, "multiclass", "assigned_group", min_samples=mean or 1)
    return rows.select("row_id", "assigned_group")


@query(
    f"""
    WITH {CALLS_SQL}, n AS (SELECT trim(call_purpose) AS label FROM calls)
    SELECT label, count(*) AS n FROM n WHERE label <> '' GROUP BY label HAVING count(*) >= 5"""
)
def multiclass_with_spam(spark, sf_dir):
    rows = labels.dataset_variant(calls(spark, sf_dir), "multiclass_with_spam")
    return labels.label_counts(rows, "call_purpose")


@query(
    f"""
    WITH {CALLS_SQL}
    SELECT CASE lower(trim(call_purpose)) WHEN 'spam' THEN 'spam' ELSE 'non_spam' END AS label, count(*) AS n
    FROM calls WHERE trim(call_purpose) <> '' GROUP BY 1"""
)
def binary_variant(spark, sf_dir):
    return labels.label_counts(labels.dataset_variant(calls(spark, sf_dir), "binary_spam"), "call_purpose")


@query(
    """
    SELECT doc_id, source FROM documents
    WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""
)
def eval_semi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    seen = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return labels.only_known_labels(docs, seen, "source").select("doc_id", "source")


@query(
    """
    SELECT DISTINCT source FROM documents
    WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""
)
def unseen_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    seen = docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return labels.unseen_labels(docs, seen, "source")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.new_rows(docs, table(spark, sf_dir, "labels"), "doc_id")


@query(
    f"""
    WITH {CALLS_SQL}
    SELECT trim(call_purpose) AS call_purpose, count(*) AS n FROM calls WHERE trim(call_purpose) <> '' GROUP BY 1"""
)
def eval_rows(spark, sf_dir):
    rows = labels.eval_rows(calls(spark, sf_dir), "text", "call_purpose")
    return rows.groupBy("call_purpose").agg(F.count("*").alias("n"))


@query(
    f"""
    WITH {CALLS_SQL}, c AS (SELECT {WORDS_SQL.format('text')} AS n, text FROM calls)
    SELECT count(*) AS total, count(*) FILTER (n < 40) AS short, count(*) FILTER (trim(text) = '') AS empty,
           count(*) FILTER (starts_with(text, '[TRANSCRIPTION_ERROR')) AS errors,
           count(*) - count(*) FILTER (n < 40) AS ok,
           count(*) - count(*) FILTER (n < 40) - count(*) FILTER (trim(text) = '') AS ok_reference FROM c"""
)
def preparation_counts(spark, sf_dir):
    return prepare.preparation_report(calls(spark, sf_dir), min_tokens=40)


# Texts that start with a Russian phrase made for one rule, and what the rule leaves of it.
RUSSIAN = [
    ("Звонил Иван, иванов и ОЛЕГ.", "Звонил [ИМЯ], иванов и [ИМЯ]."),
    ("Это компания Ромашка Плюс.", "Это компания [ОРГАНИЗАЦИЯ]."),
    ("Звонит ООО Ромашка, добрый.", "Звонит [ОРГАНИЗАЦИЯ], добрый."),
    ("Мой договор № 12345.", "Мой договор [НОМЕР_ДОГОВОРА]."),
    ("Почта: и в а н собака м р.", "Почта: [EMAIL]."),
    ("Номер один два три четыре пять шесть семь. Да.", "Номер [ТЕЛЕФОН]. Да."),
    ("Тикет A1234-56, обращение 7891.", "[НОМЕР_ДОГОВОРА], [НОМЕР_ДОГОВОРА]."),
    ("Тел +7 (999) 123-45-67.", "Тел [ТЕЛЕФОН]."),
]


def _prefixed(pairs, side):
    cases = " ".join(f"WHEN {i} THEN '{p[side]}'" for i, p in enumerate(pairs))
    return f"CASE doc_id % {len(pairs)} {cases} END"


def _with_prefix(spark, sf_dir, pairs):
    kinds = F.array(*[F.lit(p[0]) for p in pairs])
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    start = F.get(kinds, (F.col("doc_id") % len(pairs)).cast("int"))
    return docs.select("doc_id", F.concat(start, F.lit("\n"), "text").alias("text"))


@query(
    f"""SELECT doc_id, {_prefixed(RUSSIAN, 1)} || chr(10) || sha1({redacted_sql('text')}) AS clean FROM documents"""
)
def russian_redaction(spark, sf_dir):
    """Redaction of numbers, mail, organisations and names in texts with a Russian first line."""
    docs = _with_prefix(spark, sf_dir, RUSSIAN)
    clean = redact.redact_names(redact.redact_orgs(redact.redact_pii("text")))
    parts = docs.select("doc_id", F.split(clean, "\n", 2).alias("p"))
    return parts.select("doc_id", F.concat(F.get("p", F.lit(0)), F.lit("\n"), F.sha1(F.get("p", F.lit(1)))).alias("clean"))


FILLER = [
    ("Добрый день! Слушаю вас.", ""),
    ("Здравствуйте, чем могу вам помочь? ", ""),
    ("Нет, нет нет. Хорошо. Номер,", "Номер,"),
    ("Переключаю, подождите пожалуйста минуту: ", "Переключаю, :"),
]


@query(
    rf"""WITH c AS (SELECT doc_id, {_prefixed(FILLER, 1)} AS head,
        regexp_replace(regexp_replace(regexp_replace(text, '^[\s,.:;!?\-]+', ''), '[\s,.:;!?\-]+$', ''), '\s{{2,}}', ' ', 'g') AS body FROM documents)
    SELECT doc_id, sha1(CASE head WHEN '' THEN body ELSE head || ' ' || body END) AS text_hash FROM c
    WHERE body <> ''"""
)
def russian_filler(spark, sf_dir):
    """The fixed filler phrases removed from texts that start with some of them."""
    kinds = F.array(*[F.lit(p[0]) for p in FILLER])
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    start = F.get(kinds, (F.col("doc_id") % len(FILLER)).cast("int"))
    said = docs.select("doc_id", F.concat(start, F.lit(" "), text.strip_ends("text")).alias("text"))
    done = said.where(text.strip_ends("text") != "").select("doc_id", F.sha1(text.remove_noise("text")).alias("text_hash"))
    return done


# Sampling ---------------------------------------------------------------------------------------

_KEYED = """
keyed AS (
  SELECT doc_id, source, text, sha1(concat_ws(chr(31), source, text, doc_id::VARCHAR, '42')) AS k FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS rank,
         count(*) OVER (PARTITION BY source) AS n FROM keyed)"""


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


@query(
    f"""
    WITH {_KEYED}
    SELECT doc_id, source, CASE WHEN rank <= floor(n * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS split FROM ranked"""
)
def strat_split(spark, sf_dir):
    rows = split.hold_out(_documents(spark, sf_dir), "source", row_id="doc_id")
    return rows.select("doc_id", "source", "split")


@query(f"WITH {_KEYED} SELECT doc_id, ((rank - 1) % 5 + 1)::INT AS fold FROM ranked")
def strat_folds(spark, sf_dir):
    return split.k_folds(_documents(spark, sf_dir), "source", 5, row_id="doc_id").select("doc_id", "fold")


@query(
    f"""
    WITH {_KEYED}
    SELECT sha1(source || chr(31) || text) AS row_hash, source AS label, ((rank - 1) % 5 + 1)::INT AS fold,
           count(*) AS n FROM ranked GROUP BY ALL"""
)
def fold_manifest(spark, sf_dir):
    folds = split.k_folds(_documents(spark, sf_dir), "source", 5, row_id="doc_id")
    return split.fold_manifest(folds, "source")


@query(
    f"""
    WITH {_KEYED}, top AS (SELECT max(n) AS m FROM ranked)
    SELECT doc_id, copy_no::INT AS copy_no, CASE copy_no WHEN 0 THEN 'original' ELSE 'oversample' END AS _aug_source
    FROM (SELECT doc_id, unnest(range(1 + ((m - n) // n) + CASE WHEN rank <= (m - n) % n THEN 1 ELSE 0 END)) AS copy_no
          FROM ranked, top)"""
)
def oversampled_rows(spark, sf_dir):
    rows = split.oversample(_documents(spark, sf_dir), "source", row_id="doc_id")
    return rows.select("doc_id", "copy_no", "_aug_source")


@query(
    """
    WITH c AS (SELECT lang AS label, count(*) AS before FROM documents GROUP BY lang)
    SELECT label, before, (SELECT max(before) FROM c) AS after, (SELECT max(before) FROM c) - before AS synthetic FROM c"""
)
def oversample_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return split.oversample_summary(split.oversample(docs, "lang", row_id="doc_id"), "lang")


_POISSON = " ".join(
    f"WHEN u < {sum(__import__('math').exp(-1) / __import__('math').factorial(j) for j in range(k + 1))!r}::DOUBLE THEN {k}"
    for k in range(16)
)


@query(
    f"""
    WITH b AS (SELECT doc_id, source, bag,
                      sha1(concat_ws(chr(31), doc_id::VARCHAR, bag::VARCHAR, '42')) AS k FROM documents, range(1, 4) t(bag)),
    u AS (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b),
    w AS (SELECT *, CASE {_POISSON} ELSE 16 END AS w FROM u),
    f AS (SELECT *, max(w) OVER (PARTITION BY bag, source) AS top,
                 row_number() OVER (PARTITION BY bag, source ORDER BY k, doc_id) AS rn FROM w),
    x AS (SELECT *, CASE WHEN top = 0 AND rn = 1 THEN 1 ELSE w END AS weight FROM f)
    SELECT bag::INT AS bag, doc_id, source, weight::INT AS weight FROM x"""
)
def bootstrap_oob(spark, sf_dir):
    """Weight of every row in every bag; weight 0 is out of bag."""
    bagged = split.bootstrap(_documents(spark, sf_dir).drop("text"), "source", 3, row_id="doc_id")
    return bagged.select("bag", "doc_id", "source", "weight")


@query(
    f"""
    WITH {_KEYED}
    SELECT source, rank::INT AS rank, doc_id,
           sha1(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END) AS text_hash
    FROM ranked WHERE rank <= 5"""
)
def class_samples(spark, sf_dir):
    rows = split.class_samples(_documents(spark, sf_dir), "source", 5, row_id="doc_id")
    return rows.select("source", "rank", "doc_id", F.sha1("text").alias("text_hash"))


@query(
    f"""
    WITH {_KEYED}
    SELECT rank::INT AS rank, CASE source WHEN 'src1' THEN 0 ELSE 1 END::INT AS place, doc_id
    FROM ranked WHERE rank <= 4 AND source IN ('src1', 'src2')"""
)
def paired_samples(spark, sf_dir):
    rows = split.paired_samples(_documents(spark, sf_dir), "source", "src1", "src2", 4, row_id="doc_id")
    return rows.select("rank", "place", "doc_id")


@query(
    """
    SELECT doc_id FROM documents WHERE length(text) > 20
    ORDER BY sha1(concat_ws(chr(31), text, doc_id::VARCHAR, '42')), doc_id LIMIT 5"""
)
def dry_run_rows(spark, sf_dir):
    return split.dry_run_sample(_documents(spark, sf_dir), row_id="doc_id").select("doc_id")


def _draw(salt: str) -> str:
    return f"('0x' || substr(sha1(concat_ws(chr(31), file, slot::VARCHAR, '42{salt}')), 1, 8))::BIGINT"


@query(
    f"""
    WITH f AS (SELECT 'f' || conv_id AS file, (sum(length(text)) * 20)::BIGINT AS n FROM conversations GROUP BY conv_id),
    s AS (SELECT file, n, unnest(range((n - 3000) // 4500 + 1)) AS slot FROM f WHERE n >= 3000),
    g AS (SELECT file, least(slot * 4500 + {_draw('p')} % 1500, n - 3000) AS start_ms, {_draw('o')} AS o FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY o, start_ms) AS turn FROM g)
    SELECT file || '@' || start_ms AS id, file, start_ms, turn::INT AS turn FROM r WHERE turn <= 300
    ORDER BY turn, file LIMIT 300"""
)
def segment_sample(spark, sf_dir):
    spoken = F.sum(F.length("text")) * 20
    files = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("f"), "conv_id").alias("file")).agg(
        spoken.alias("length_ms")
    )
    return split.sample_segments(files, 100, 3000).select("id", "file", "start_ms", "turn")
