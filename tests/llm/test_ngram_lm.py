import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from talkmill.llm import ngram_lm
from talkmill.llm.queries import op4_kneser_ney
from talkmill.llm.registry import table

SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def discount(n):
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    of = lambda k: min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] else y * k
    return [0.0, of(1), of(2), of(3)]


def brute(rows):
    """Base and model scores by dictionaries."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    uni, pairs = Counter(), Counter()
    for i, text in rows:
        if not held[i]:
            seq = tokens(text)
            uni.update(seq)
            pairs.update(zip(["<s>", *seq[:-1]], seq))
    ways, follow = Counter(w for _, w in pairs), defaultdict(list)
    for (v, _), c in pairs.items():
        follow[v].append(c)
    d2, d1 = discount(Counter(pairs.values())), discount(Counter(ways.values()))
    n, size = sum(uni.values()), len(uni)
    rest = sum(d1[min(c, 3)] for c in ways.values()) / len(pairs)
    out = {}
    for i, text in rows:
        seq = tokens(text)
        base = sum(math.log10((uni[t] + 0.1) / (n + 0.1 * (size + 1))) for t in seq)
        logs = 0.0
        for v, w in zip(["<s>", *seq[:-1]], seq):
            low = max(ways[w] - d1[min(ways[w], 3)], 0) / len(pairs) + rest / (size + 1)
            if v in follow:
                c, all_c = pairs[v, w], sum(follow[v])
                left = sum(d2[min(x, 3)] for x in follow[v])
                low = (max(c - d2[min(c, 3)], 0) + left * low) / all_c
            logs += math.log10(low)
        out[i] = (held[i], len(seq), sum(uni[t] > 0 for t in seq), n, base, logs)
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-9)


def test_query_against_dictionaries(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    same(op4_kneser_ney(spark, SF).collect(), brute(rows))


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated texts, a text of one huge word, clashing extra columns."""
    long = "x" * 300_000
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n", "a b A b", "É é a", long, "a a a a", "a a a a"] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lm_log10", F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    same(op4_kneser_ney(spark, str(tmp_path)).collect(), brute(rows))
    model = ngram_lm.fit(df)
    out = ngram_lm.score(df, model)
    assert out.columns.count("lm_log10") == 1 and out.count() == len(rows)


def test_empty_table_and_no_training(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = ngram_lm.fit(df)
    assert ngram_lm.score(df, model).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ngram_lm.score(some, model).first().lm_log10 == 0


def test_probabilities_sum_to_one(spark):
    import numpy as np

    texts = ["a b c a b", "b c d", "a a b", "c b a d", "d"]
    model = ngram_lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"), shards=3)
    ids = np.arange(model.vocabulary)
    for before in [*ids, model.vocabulary]:
        logs = [model.log10(np.array([before, i]), np.array([0, 2]))[1] for i in [*ids, ngram_lm.UNKNOWN]] if before < model.vocabulary else [
            model.log10(np.array([i]), np.array([0, 1]))[0] for i in [*ids, ngram_lm.UNKNOWN]
        ]
        assert sum(10**x for x in logs) == pytest.approx(1, abs=1e-9)
