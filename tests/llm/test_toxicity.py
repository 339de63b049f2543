import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.llm import toxicity
from talkmill.llm.queries import op1_toxicity
from talkmill.llm.registry import table

FOUL = ["grumbleface", "nastyhead", "stinkbeard", "vilemouth"]


def texts(n, seed, share=0.3):
    """Ordinary sentences, some with a foul word or two."""
    rng = random.Random(seed)
    stems = ["tion", "the", "er", "an", "ing", "of", "ble", "re", "st", "on", "ou", "ha"]
    vocabulary = ["".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(400)]
    out, labels = [], []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 200))
        foul = rng.random() < share
        for _ in range(rng.randint(2, 4) if foul else 0):
            words.insert(rng.randrange(len(words)), rng.choice(FOUL).title())
        out.append(" ".join(words))
        labels.append(int(foul))
    return out, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*texts(600, 1), prior=0.3)


def scores(model, rows):
    return model.scores(*toxicity._buffer([t.lower() for t in rows]))


def test_held_out_accuracy(model):
    rows, labels = texts(400, 1 + 1)
    # The same words in new texts: another seed makes another vocabulary, so the foul words alone decide.
    found = scores(model, rows) >= 0.5
    assert (found == np.array(labels)).mean() > 0.9
    assert any(w.encode() in model.toxic for w in FOUL) and not any(w.encode() in model.ordinary for w in FOUL)


PHRASES = ["the house over there", "turn around right now", "your own people first"]


def phrase_texts(n, seed):
    """Sentences of one vocabulary; the toxic ones join some of its words to a phrase."""
    rng, fixed = random.Random(seed), random.Random(7)
    stems = ["tion", "the", "er", "an", "ing", "of", "ble", "re", "st", "on", "ou", "ha"]
    vocabulary = ["".join(fixed.choices(stems, k=fixed.randint(1, 3))) for _ in range(400)] + " ".join(PHRASES).split() * 2
    out, labels = [], []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 200))
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(PHRASES))
        out.append(" ".join(words))
        labels.append(int(toxic))
    return out, labels


def test_phrases_of_ordinary_words():
    model = toxicity.train(*phrase_texts(600, 1), prior=0.3)
    rows, labels = phrase_texts(400, 2)
    found, toxic = scores(model, rows) >= 0.5, np.array(labels) == 1
    assert found[toxic].mean() > 0.6 and found[~toxic].mean() < 0.15


def test_windows_cover_every_word():
    data, offsets = toxicity._buffer(["a b c d e", "", " \n", "one", "x" * 5000 + " y\tz"])
    spans, row = toxicity._windows(data, offsets, 2)
    raw = data.tobytes()
    got = [(int(r), raw[int(a) : int(a + n)].decode().split()) for (a, n), r in zip(spans, row)]
    assert got == [(0, ["a", "b"]), (0, ["c", "d"]), (0, ["e"]), (3, ["one"]), (4, ["x" * 5000, "y"]), (4, ["z"])]


def test_savings_as_single_compressions(model):
    """Both savings, the ratios summed from them and the logistic function, window by window."""
    rows = ["the nastyhead of the er an ing tion ble", "plain text of the day and more of it", "", "the vilemouth"]
    data, offsets = toxicity._buffer(rows)
    foul, own, row = model.savings(data, offsets)
    carrier = model.ordinary[toxicity.CARRIER]
    spans, _ = toxicity._windows(data, offsets, toxicity.WINDOW)
    found = {i: [] for i in range(len(rows))}
    for f, o, r, (a, n) in zip(foul, own, row, spans.astype(int)):
        window = carrier + data.tobytes()[a : a + n]
        plain, *saved = (len(toxicity._compressor(d).compress(window)) for d in (model.ordinary, model.toxic, model.trained))
        f2, o2 = (plain - s for s in saved)
        assert f == min(max(f2, 0), toxicity.TOP) and o == min(max(o2, -toxicity.REACH), toxicity.REACH)
        found[r].append((f, o))
    for r, score in enumerate(scores(model, rows)):
        total = sum(model.trained_ratios[o + toxicity.REACH] for _, o in found[r])
        n = len(found[r])
        x = [sum(model.ratios[f] for f, _ in found[r]), max([f for f, _ in found[r]], default=0)]
        x += [sum(f >= 3 for f, _ in found[r]), total, total / max(n, 1), max([0, *(o for _, o in found[r])]), np.log1p(n)]
        z = model.weights[0] + (np.array(x) - model.means) / model.scales @ model.weights[1:]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_sample_bound(spark):
    """Long texts train too; the bound is on all characters, and an id with many texts gives one."""
    rows, labels = texts(60, 9)
    docs = [(i, t if i % 7 else t * 150) for i, t in enumerate(rows)] + [(0, f"{rows[0]} {k}") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    assert toxicity.fit(df, marks).weights.size == 8
    assert toxicity.fit(df, marks, chars=10) is None


def test_query(spark):
    """Held-out accuracy on the given labels."""
    for sf, least in (("sf0.1", 0.93),):
        rows = op1_toxicity(spark, f"/root/testdata/{sf}").collect()
        assert len(rows) == table(spark, f"/root/testdata/{sf}", "documents").count()
        known = {r.doc_id: r.toxic for r in table(spark, f"/root/testdata/{sf}", "labels").collect()}
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        test = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
        assert sum(a == b for a, b in test) / len(test) > least


def test_odd_rows(spark, tmp_path, model):
    rows, labels = texts(200, 5)
    odd = [None, "", " \n", "x" * 200_000, "nastyhead " * 30_000, "é😀"] + ["the same the same"] * 3
    docs = list(enumerate(rows + odd)) + [(None, "no id"), (3, rows[3])]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    marks = list(enumerate(labels)) + [(0, labels[0]), (1, None), (None, 1), (10**6, 0)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = op1_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    again = {r.doc_id: r.score for r in op1_toxicity(spark, str(tmp_path)).collect()}
    assert all(again[r.doc_id] == r.score for r in out)
    assert len({r.score for r in out if r.doc_id is not None and r.doc_id > 205}) == 1
    kept = toxicity.score(spark.createDataFrame([(1, "a")], "toxicity int, text string"), model)
    assert kept.columns == ["text", "toxicity"]


def test_without_labels(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert op1_toxicity(spark, str(tmp_path)).first().score == 0
    assert toxicity.train(["a", "b"], [1, 1]) is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, None).count() == 0
