import hashlib
import random
import re

from pyspark.sql import functions as F

from talkmill.llm import secret_scan
from talkmill.llm.queries import op2_markov_secrets
from talkmill.llm.registry import table

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute(text):
    """Pattern spans in code points."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def same(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        spans = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        got = [s for s in r.spans.split(",") if s]
        assert [s for s in got if not s.startswith("random")] == spans
        yield r, [s for s in got if s.startswith("random")]


def test_query_against_finditer(spark):
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    extra = sum(len(x) for _, x in same(op2_markov_secrets(spark, "/root/testdata/sf0.01").collect(), texts))
    assert extra < len(texts) / 100  # invented prose is not taken for random strings


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    key = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n))
    stems = "order customer parameter configuration internal value report account create update table index".split()
    plain = " ".join(f"{a}_{b}_{c}" for a in stems for b in stems for c in stems[:4]) + " "
    texts = [None, "", " ", "password:token:secretvalue", "SECRET = 'abc' api-key=zzzzzzzz apikey: 'a.b=c/d+e_f'",
             "é😀 token=abcdef😀 " + "a" * 24, "AKIA" * 10, "password=" * 9, "ff" * 40_000, plain,
             "note " + key(40) + " here", *(f"token={key(32)} ordinary text" for _ in range(600))]
    texts += texts[:11]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = dict((r.doc_id, x) for r, x in same(op2_markov_secrets(spark, str(tmp_path)).collect(), texts))
    assert found[10] == ["random:5:45"] and not found[9]
    assert secret_scan.scanned(df, candidates="c").columns == ["doc_id", "text", "base", "c"]


def test_many_matches_and_redaction(spark):
    text = "x token=abcdefgh " * 3000
    df = secret_scan.scanned(spark.createDataFrame([(text,), ("plain",), (None,)], "text string"))
    spans = F.col("base")
    out = df.select(secret_scan.redacted(F.col("text"), spans).alias("t"), spans.alias("s")).collect()
    assert out[0].t == "x [SECRET] " * 3000 and out[1].t == "plain" and out[2].t is None
    assert [(s.start, s.rank, s.end) for s in out[0].s] == brute(text)


def test_empty(spark):
    df = secret_scan.scanned(spark.createDataFrame([], "doc_id long, text string"))
    model = secret_scan.fit(secret_scan.samples(df))
    assert model.ratios is None and df.select(secret_scan.all_spans(model)).count() == 0


def test_parts_beside_a_pattern(spark):
    """What a pattern span leaves of a run is judged like a run of its own; short rests are not."""
    rest = "q7Zk2Xv9Lp4Wd8Rt1Nb6Yc3Hs5Mf0Jg2Ua7Ei4Ko"
    access = "AKIA" + "ABCDEFGH12345678"
    rows = [
        f"x {access}/{rest} y", f"x {rest}/{access}/{rest} y", f"x {access}/short y", f"x {rest} y",
        f"token={access}/{rest} y", f"{'0123456789abcdef' * 2}-{rest}",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    scanned = secret_scan.scanned(df)
    parts = scanned.select("doc_id", "text", secret_scan.uncovered(F.col("base"), F.col("candidates")).alias("p")).orderBy("doc_id").collect()
    for r in parts:
        assert all(r.text[p.start : p.end] == p.value for p in r.p)
    values = [[p.value for p in r.p] for r in parts]
    assert values == [["/" + rest], [rest + "/", "/" + rest], [], [rest], [], ["-" + rest]]
    model = secret_scan.RandomStrings([1.0] * (secret_scan.EDGE + 1) ** 2, 0.0)
    spans = scanned.withColumn("s", secret_scan.all_spans(model)).orderBy("doc_id")
    hidden = [r.t for r in spans.select(secret_scan.redacted(F.col("text"), F.col("s")).alias("t")).collect()]
    assert all(rest not in t for t in hidden)
