"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm import (
    cotraining,
    jaccard_join,
    merge_dropout,
    ngram_lm,
    order_minhash,
    page_diff,
    pii_deobfuscation,
    secret_scan,
    segment_search,
    source_mixing,
    token_alignment,
    toxicity,
    whitening,
)
from talkmill.llm.registry import QUERIES, SQL, query, table  # noqa: F401
from talkmill.session import checkpointed


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id"))
    rows = toxicity.score(docs.withColumn("held_out", toxicity.held_out("doc_id")), model, out="score", keep=["doc_id", "held_out"])
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op2_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text: those of the fixed patterns and those the Markov model adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = checkpointed(secret_scan.scanned(docs).select("doc_id", "base", "candidates"))
    model = secret_scan.fit(secret_scan.samples(rows))
    rows = rows.withColumn("found", secret_scan.all_spans(model))

    def count(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.col("found")).alias("spans"),
    )


@query(
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
               CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM pairs
    QUALIFY rank <= 10
    """
)
def op3_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector among all others."""
    return segment_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log probability of every text under the model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", ngram_lm.held_out("doc_id", 10))
    model = ngram_lm.fit(docs.where(~F.col("held_out")))
    out = ngram_lm.score(docs, model, keep=["doc_id", "held_out"])
    return out.select(
        "doc_id",
        "held_out",
        F.col("lm_n_tokens").alias("n_tokens"),
        F.col("lm_n_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("lm_base").alias("base_score"),
        F.col("lm_log10").alias("score"),
        F.col("lm_perplexity").alias("perplexity"),
    )


@query()
def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the text view, the page view and both; ``predicted`` 1 means keep."""
    rows = cotraining.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumnRenamed("id", "doc_id").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next text's are."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    docs = docs.withColumn("entries", order_minhash.signature(F.col("text")))
    rows = order_minhash.with_next(docs, "doc_id", ["text", "entries"])
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)),
    )
    rows = rows.withColumn("edited_entries", order_minhash.signature(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.fingerprint(F.col("entries")).alias("fingerprint"),
        order_minhash.fingerprint(F.col("edited_entries")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        order_minhash.likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, at five words and a similarity of 0.8."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_texts(docs).withColumnRenamed("id", "doc_id")


@query()
def op8_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text, plain and disguised."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii_deobfuscation.with_spans(docs)

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii_deobfuscation.KINDS)],
        F.sha2(pii_deobfuscation.written(F.col("base")), 256).alias("base_sha256"),
        pii_deobfuscation.written(F.col("found")).alias("spans"),
    )


@query()
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is drawn when sources are mixed at 0.95 of the full entropy, each at most four times."""
    plan = source_mixing.passes(table(spark, sf_dir, "documents"), entropy=0.95, repeats=4.0)
    return plan.select(
        F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "copies", "weight", "passes", "drawn"
    )


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@query()
def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text with a tenth of the merges dropped, and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = merge_dropout.encode(docs, VOCABULARY, dropout=0.1, seed=1, back="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"),
    )


BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and digest of the alignment of both tokenizations of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = token_alignment.align(docs, BYTE_VOCABULARY, VOCABULARY, keep=["doc_id"])
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.col("digest").alias("groups_sha256"),
    )


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading components of all vectors, scaled to variance one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model, keep=["vec_id"])
    shares = [float(e / model.trace) for e in model.values] if model else []
    one = F.posexplode("whitened").alias("k", "whitened")
    return rows.select("vec_id", "deviation", one).select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.lit(shares or [0.0]), F.col("k")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


@query()
def op12_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_diff.extract(pages, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
