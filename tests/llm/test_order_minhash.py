import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talkmill.llm import order_minhash
from talkmill.llm.queries import op6_order_minhash
from talkmill.llm.registry import table

SF = "/root/testdata/sf0.001"


def check(rows, docs):
    """Edited texts, lengths and fingerprints against the plain definition."""
    order = sorted(docs, key=lambda i: (i is None, -(i or 0)))
    after = dict(zip(order, order[1:] + order[:1]))
    prints, likes = {}, []
    assert len(rows) == len(docs)
    for r in rows:
        text, other = docs[r.doc_id] or "", docs[after[r.doc_id]] or ""
        t = len(text) // 3
        edited = text[: len(text) - t] + other[:t]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        likes.append((r, text, other, edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r, text, other, edited in likes:
        if edited in prints:
            assert r.edited_fingerprint == prints[edited]
        a, b = ({x[i : i + 10] for i in range(0, len(x), 10)} for x in (r.fingerprint, prints[other]))
        used = {x[:2] for x in a | b}
        assert r.near_next == pytest.approx(len(a & b) / len(used) if used else 1)
    return likes


def test_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    likes = check(op6_order_minhash(spark, SF).collect(), docs)
    near = [r.near_edited for r, text, *_ in likes if len(text) > 500]
    assert sum(near) / len(near) > 0.22  # about the square of the shared part, as pairs must agree
    assert sum(r.near_next for r, *_ in likes) / len(likes) < 0.1


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " ", "a", "a b", "a b c", "a b a b a b a b", "x" * 100_000, "é😀 ñ " * 500, "same text of it", "same text of it"]
    docs = {i * 1000 - 3000: t for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("next_text", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    check(op6_order_minhash(spark, str(tmp_path)).collect(), docs)


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "p q r"), (None, "p q r"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op6_order_minhash(spark, str(tmp_path)).collect()
    assert len(out) == 5 and len({r.fingerprint for r in out if r.doc_id == 5}) == 1
    # 7, 5, 5, null, null, and round again
    assert Counter(r.edited_sha256 for r in out if r.doc_id == 5) == Counter(
        hashlib.sha256(x.encode()).hexdigest() for x in ("a b c d a b", "a b c d p q")
    )


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op6_order_minhash(spark, str(tmp_path)).count() == 0


def brute_signature(spark, text):
    """Entries from occurrence-numbered k-mers, written out with sets and sorts."""
    import re

    units = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    one = lambda *xs: spark.range(1).select(F.xxhash64(*xs)).first()[0]
    h = [one(F.lit(u)) for u in units]
    unsigned = lambda x: x % (1 << 64)
    kmers = [unsigned(one(*[F.lit(x).cast("long") for x in h[i : i + 3]])) >> 24 for i in range(max(len(h) - 2, 1))]
    seen, numbered = Counter(), []
    for place, k in enumerate(kmers):
        value = unsigned(one(F.lit(k).cast("long"), F.lit(seen[k])))
        seen[k] += 1
        numbered.append((value >> 24, place))
    out = []
    for bucket in range(64):
        here = sorted(x for x in numbered if x[0] >> 34 == bucket)[:2]
        if here:
            here.sort(key=lambda x: x[1])
            value = unsigned(one(*[F.lit(x).cast("long") for x, _ in here]))
            out.append(bucket << 32 | value & 0xFFFFFFFF)
    return out


def test_signature_against_definition(spark):
    for text in ("a b c a b c a b c d", "one two"):
        df = spark.createDataFrame([(text,)], "text string")
        got = df.select(order_minhash.signature(F.col("text")).alias("s")).first().s
        assert sorted(got) == sorted(brute_signature(spark, text))


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    turned = words[200:] + words[:200]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:390] + ["new"] * 10), " ".join(turned))], "a string, b string, c string")
    s = {c: order_minhash.signature(F.col(c)) for c in "abc"}
    near, moved = df.select(order_minhash.likeness(s["a"], s["b"]), order_minhash.likeness(s["a"], s["c"])).first()
    assert near > 0.85 and moved < 0.75
