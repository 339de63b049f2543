import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from talkmill.llm import source_mixing as mix
from talkmill.llm.queries import op9_source_mixing

SF = "/root/testdata/sf0.001"


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def test_entropy_target_is_met():
    tokens = {"a": 5000, "b": 1000, "c": 100, "d": 10}
    weights, exponent = mix.mixing_weights(tokens, entropy=0.9, repeats=1e9)
    assert 0 < exponent < 1 and sum(weights.values()) == pytest.approx(1)
    assert entropy(weights.values()) == pytest.approx(0.9 * math.log(4), abs=1e-9)
    raised = {s: n**exponent for s, n in tokens.items()}
    assert weights == pytest.approx({s: x / sum(raised.values()) for s, x in raised.items()})


def test_repetition_limit_goes_first():
    tokens = {"a": 5000, "b": 1000, "c": 100, "d": 10}
    weights, exponent = mix.mixing_weights(tokens, entropy=0.99, repeats=3.0)
    passes = mix._repeats(list(tokens.values()), list(weights.values()), None)
    assert max(passes) == pytest.approx(3.0, abs=1e-6) and min(passes) == pytest.approx(1.0)
    assert mix.mixing_weights({"a": 3, "b": 0, None: 3})[0] == {"a": 0.5, "b": 0.0, None: 0.5}
    assert mix.mixing_weights({}) == ({}, 1.0) and mix.mixing_weights({"a": 0}) == ({"a": 0.0}, 1.0)
    # A budget that no exponent meets leaves the shares as they are.
    assert mix.mixing_weights({"a": 10, "b": 5}, budget=1000, repeats=2)[1] == 1.0


def drawn_by_order(rows):
    """Draws by walking each source's permutation."""
    again = defaultdict(list)
    for r in rows:
        again[r.source].append(r)
    out = {}
    totals = {s: sum(r.tokens * r.copies for r in rs) for s, rs in again.items()}
    weights, _ = mix.mixing_weights(totals)
    used = [s for s in totals if weights[s] > 0]
    share = dict(zip(used, mix._repeats([totals[s] for s in used], [weights[s] for s in used], None)))
    for s, rs in again.items():
        whole = math.floor(share.get(s, 1.0) + 1e-9)
        rest = round(max(share.get(s, 1.0) - whole, 0) * totals[s])
        for r in sorted(rs, key=lambda r: ((r.order % (1 << 64)) , str(r.id), r.key)):
            times = whole * r.copies
            for _ in range(r.copies):
                times += rest > 0
                rest -= r.tokens
            out[s, r.id, r.key] = times
    return out


@pytest.mark.parametrize("bucket", [2000, 7])
def test_draws_follow_the_permutation(spark, monkeypatch, bucket):
    monkeypatch.setattr(mix, "BUCKET_ROWS", bucket)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix.passes(docs).collect()
    assert {(r.source, r.id, r.key): r.drawn for r in rows} == drawn_by_order(rows)
    assert len(rows) == docs.count() and min(r.drawn for r in rows) >= 1


def test_realised_shares(spark):
    rows = op9_source_mixing(spark, "/root/testdata/sf0.1").collect()
    drawn, weight = Counter(), {}
    for r in rows:
        drawn[r.source] += r.n_tokens * r.drawn
        weight[r.source] = r.weight
    total = sum(drawn.values())
    for s, w in weight.items():
        assert drawn[s] / total == pytest.approx(w, abs=0.002)
        assert all(r.drawn in (r.passes, r.passes + 1) for r in rows if r.source == s)


def test_token_count(spark):
    texts = [None, "", " \n", "a", " a  b\tc\n", "é 😀", "x" * 1000, "a b", "\x0b\x0ca"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(mix.token_count(F.col("text"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_odd_rows(spark):
    texts = [None, "", "a b", "a b", "c d e"] * 3 + ["w " * 50_000]
    rows = [(i // 2, t, [None, "hot", "s"][i % 3], i) for i, t in enumerate(texts)] + [(1, "a b", "hot", 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    out = mix.mixed(df)
    assert out.columns == df.columns
    want = {(r.id, r.source, r.key): r.drawn for r in mix.passes(df).collect()}
    got = Counter((r.doc_id, r.source, r.key) for r in out.withColumn("key", F.xxhash64("text")).collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    assert set(df.distinct().collect()) == set(out.distinct().collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix.passes(df).count() == 0 and mix.mixed(df).count() == 0


def test_budget_below_one_pass(spark):
    rows = [(i, "a b c d", "s") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mix.mixed(df, budget=120).count() == 30
