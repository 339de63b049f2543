import re
from collections import Counter

import pytest
import sentencepiece  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from talkmill.llm import merge_dropout, source_mixing, toxicity
from talkmill.llm.queries import VOCABULARY
from tests.llm.test_jaccard_join import brute
from tests.llm.test_secret_scan import brute as secret_spans

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that went into and came out of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, before.collect(), docs.collect(), docs.columns))
    return {name: (a, b, c) for name, a, b, c in out}


def test_columns(stages):
    assert [c for *_, c in stages.values()] == [COLUMNS] * 4 + [[*COLUMNS, "ids"]]


def test_toxic_documents_go_and_others_stay(spark, stages):
    before, after, _ = stages["toxicity"]
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = Counter(r.doc_id for r in after)
    clean = [r.doc_id for r in before if known.get(r.doc_id) == 0]
    foul = [r.doc_id for r in before if known.get(r.doc_id) == 1]
    assert sum(i in left for i in clean) / len(clean) > 0.97
    assert sum(i in left for i in foul) / len(foul) < 0.5  # forty toxic texts to learn from
    assert set(left) <= {r.doc_id for r in before}


def test_one_of_each_class_stays(stages):
    before, after, _ = stages["near_duplicates"]
    want = {i for i, c, _, _ in brute([(r.doc_id, r.text) for r in before]) if i == c}
    assert Counter(r.doc_id for r in after) == Counter(want)


def test_secrets_are_masked(stages):
    before, after, _ = stages["secrets"]
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before) and not any(secret_spans(t) for t in texts.values())
    for r in before:
        if not secret_spans(r.text) and texts[r.doc_id] != r.text:
            pieces = texts[r.doc_id].split("[SECRET]")
            assert re.fullmatch(".+".join(map(re.escape, pieces)), r.text, re.S)
    changed = [r for r in after if "[SECRET]" in r.text]
    assert changed and all(r.n_chars == len(r.text) for r in changed)
    assert sum("[SECRET]" in r.text for r in after) < len(after) / 10


def test_sources_reach_their_weights(stages):
    before, after, _ = stages["mixing"]
    count = lambda rows: Counter({s: 0 for s in ()}) + Counter(
        x for r in rows for x in [r.source] * len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    )
    tokens, drawn = count(before), count(after)
    weights, _ = source_mixing.mixing_weights(dict(tokens), entropy=0.98, repeats=1.5)
    total = sum(drawn.values())
    longest = max(len(r.text.split()) for r in before) / total
    for s, w in weights.items():
        assert drawn[s] / total == pytest.approx(w, abs=0.01 + longest)
    assert {r.doc_id for r in before} == {r.doc_id for r in after}


def test_pieces_decode(stages):
    before, after, _ = stages["pieces"]
    with open(VOCABULARY, "rb") as f:
        vocabulary = merge_dropout.Vocabulary(f.read())
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    assert all(merge_dropout.decode(vocabulary, r.ids) == r.text for r in after if r.text)


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("ids").alias("p"))
    want = stages["pieces"][1]
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in want)
    assert len({(r.doc_id, r.h, r.p) for r in got.collect()}) == len({r.doc_id for r in want})


def test_odd_rows(spark, tmp_path):
    text = "one two three four five six seven eight nine ten " * 5
    rows = [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (1, "another text with the same id as others have", "en", "a", 5),
        (2, text + "end", "en", "b", 5), (None, text, "en", None, 5), (3, None, None, None, None), (4, "", "en", "a", 0),
        (5, "x" * 100_000, "en", "a", 1), (6, "password=abcdefgh1234 and plain words", "en", "a", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumn("key", F.lit("mine")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*COLUMNS, "key", "ids"]
    kept = {(r.doc_id, (r.text or "")[:30]) for r in out.collect()}
    assert kept == {
        (None, text[:30]), (1, "another text with the same id as others have"[:30]), (3, ""), (4, ""), (5, "x" * 30),
        (6, "[SECRET] and plain words"),
    }


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.SAMPLE_TEXTS > 0
