"""Plans of the operators: what must stay in the JVM, and that nothing pairs all rows with all."""

import pytest
from pyspark.sql import functions as F

from talkmill.llm import order_minhash, secret_scan
from talkmill.llm.queries import QUERIES
from talkmill.llm.registry import table

SF = "/root/testdata/sf0.001"
PYTHON = ("Python", "Pandas", "Arrow", "MapIn")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_have_no_python(spark):
    docs = table(spark, SF, "documents")
    scanned = secret_scan.scanned(docs)
    model = secret_scan.RandomStrings([0.5] * (secret_scan.EDGE + 1) ** 2, 0.0)
    spans = scanned.select("doc_id", secret_scan.redacted(F.col("text"), secret_scan.all_spans(model)).alias("t"))
    for df in (spans, QUERIES["op6_order_minhash"](spark, SF), QUERIES["op2_markov_secrets"](spark, SF)):
        assert not any(word in plan(df) for word in PYTHON)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_per_row_operators_do_not_shuffle(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    assert "Exchange" not in plan(secret_scan.scanned(docs))
    assert "Exchange" not in plan(docs.select(order_minhash.signature(F.col("text")).alias("s")))
    for name in ("op8_pii_deobfuscation", "op10_merge_dropout"):
        assert "Exchange" not in plan(QUERIES[name](spark, SF))


def test_texts_are_shuffled_once_for_the_next_document(spark):
    text = plan(QUERIES["op6_order_minhash"](spark, SF))
    assert text.count("Exchange hashpartitioning(__slice") <= 2  # the rows, and one row per slice
