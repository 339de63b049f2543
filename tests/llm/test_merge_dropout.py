import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from talkmill.llm import merge_dropout as md
from talkmill.llm.arrays import text_bytes
from talkmill.llm.queries import VOCABULARY, op10_merge_dropout
from talkmill.llm.registry import table

SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "  x  y ", "é😀ß ▁ x", "\n\n a\tb", "a" * 3000, "x y" * 2000, "Hello  world", "▁", " ▁ ", "日本語 text",
    "\x00\x01", "same text of it", "same text of it",
]


@pytest.fixture(scope="module")
def vocabulary():
    with open(VOCABULARY, "rb") as f:
        return md.Vocabulary(f.read())


def encoded(vocabulary, texts, share, seed=1):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    ids, ends = md.encode_rows(vocabulary, data, offsets, np.arange(len(texts)), share, seed)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_without_dropout_as_the_library(spark, vocabulary):
    texts = [r.text for r in table(spark, SF, "documents").collect()] + [t for t in ODD if t and "▁" not in t]
    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    assert encoded(vocabulary, texts, 0.0) == sp.encode(texts)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_lossless(vocabulary, share):
    for t, ids in zip(ODD, encoded(vocabulary, ODD, share)):
        assert (md.decode(vocabulary, ids) if ids else "") == (t or "")


def test_steps_in_numpy_equal_the_heap(spark, vocabulary, monkeypatch):
    texts = [r.text for r in table(spark, SF, "documents").limit(40).collect()] + ODD
    together = encoded(vocabulary, texts, 0.2)
    monkeypatch.setattr(md, "WIDTHS", (1,))
    assert encoded(vocabulary, texts, 0.2) == together


def test_dropout_varies_and_repeats(vocabulary):
    texts = ["international understanding of the ordinary " * 5] * 30
    a = encoded(vocabulary, texts, 0.3)
    assert a == encoded(vocabulary, texts, 0.3) and a != encoded(vocabulary, texts, 0.3, seed=2)
    assert len({tuple(x) for x in a}) > 20
    plain = encoded(vocabulary, texts[:1], 0.0)[0]
    assert sum(map(len, a)) / len(a) > len(plain)
    assert all(md.decode(vocabulary, x) == texts[0] for x in a)
    # With every merge dropped only characters are left.
    assert len(encoded(vocabulary, ["abc d"], 1.0)[0]) == 6


def test_every_occurrence_is_drawn(vocabulary):
    """One word in many texts: its segmentations are not a fixed few, whatever the seed."""
    found = encoded(vocabulary, ["understanding"] * 20_000, 0.1)
    assert len({tuple(x) for x in found}) > 8
    # A space and one letter have one merge, which is skipped in a tenth of the texts.
    for seed in range(6):
        ids = [tuple(x) for x in encoded(vocabulary, ["a"] * 20_000, 0.1, seed)]
        whole = encoded(vocabulary, ["a"], 0.0)[0]
        assert len(whole) == 1
        assert abs(sum(len(x) > 1 for x in ids) / len(ids) - 0.1) < 0.02


def test_query(spark, tmp_path):
    rows = op10_merge_dropout(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count() and all(r.lossless for r in rows)
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    odd = op10_merge_dropout(spark, str(tmp_path)).collect()
    assert all(r.lossless for r in odd) and len(odd) == len(ODD)
    out = md.encode(df, VOCABULARY).orderBy("doc_id").collect()
    assert out[1].ids is None and out[0].ids == [] and md.encode(df, VOCABULARY).columns == ["doc_id", "text", "ids"]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert md.decoded(md.encode(df, VOCABULARY), VOCABULARY).count() == 0
