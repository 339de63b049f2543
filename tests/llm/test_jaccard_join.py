import itertools
import random

import pytest
from pyspark.sql import functions as F

from talkmill.llm import jaccard_join
from talkmill.llm.components import components
from talkmill.llm.queries import op7_jaccard_join
from talkmill.llm.registry import table


def shingles(text):
    words = (text or "").lower().replace("\xa0", "_").split()
    if not words:
        return None
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def brute(rows, threshold=0.8):
    """Links and components over all pairs; rows are told apart by their place."""
    sets = [shingles(t) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    lowest = {}
    for (i, _), c in zip(rows, label):
        lowest[c] = min(lowest.get(c, i), i)
    same = {}
    for (i, _), s in zip(rows, sets):
        if s:
            same[frozenset(s)] = min(same.get(frozenset(s), i), i)
    return sorted((i, lowest[c], same[frozenset(s)] if s else i, n) for (i, _), c, s, n in zip(rows, label, sets, links))


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op7_jaccard_join(spark, "/root/testdata/sf0.01").collect())
    assert got == brute(rows)
    assert sum(n for *_, n in got) > 50


def copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        yield " ".join(words)


def test_group_of_near_copies_in_blocks(spark, monkeypatch):
    """A component cut into many blocks gives the links of all pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 40)
    rows = list(enumerate([*copies(150), *copies(60, 9), "a b c", "A  b\nc", "a b c d", None, "", " \n", "x" * 200_000]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("mine"))
    got = sorted(tuple(r) for r in jaccard_join.near_texts(df).collect())
    assert got == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, None), (3, None)]
    got = sorted(tuple(r) for r in jaccard_join.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_null_ids(spark):
    rows = [(None, t) for t in copies(10)] + [(7, t) for t in copies(2)]
    out = jaccard_join.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([(7, t) for _, t in rows])
    assert sorted(r.n_links for r in out) == sorted(n for *_, n in want) and max(r.n_links for r in out) > 3


def test_many_null_ids(spark, monkeypatch):
    """Rows without an id meet their own text only, not all others without one."""
    rows = [(None, f"{t} {k}") for k in range(12) for t in copies(8, k)]
    joined = []
    compare = jaccard_join._compare

    def counted(need, at_least):
        run = compare(need, at_least)

        def seen(table):
            assert table.num_rows <= len(rows)  # once joined on the id alone, it was the square
            return run(table)

        return seen

    monkeypatch.setattr(jaccard_join, "_compare", counted)
    out = jaccard_join.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([(k, t) for k, (_, t) in enumerate(rows)])
    assert sorted(r.n_links for r in out) == sorted(n for *_, n in want) and not joined


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.65, 0.95])
def test_other_thresholds(spark, threshold):
    """Bands follow the threshold, so pairs just above it are found."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows.append(" ".join(base))
        for _ in range(2):
            words = list(base)
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.near_texts(df, threshold=threshold).collect()) == brute(rows, threshold)
    size = jaccard_join.band_rows(threshold)
    assert (1 - threshold**size) ** (240 // size) <= jaccard_join.MISSED


def test_threshold_too_low():
    assert jaccard_join.band_rows(0.8) == 5
    with pytest.raises(ValueError):
        jaccard_join.band_rows(0.01)


def test_empty(spark):
    assert jaccard_join.near_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_table():
    need = jaccard_join.needed_matches()
    assert need == sorted(need) and need[-1] < 0.8 * 240
    assert jaccard_join.needed_matches(tolerance=0.01)[0] > need[0]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(4, 4), (9, 8), (9, 8)]
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label


@pytest.mark.parametrize("n", [1, 4])
def test_short_texts(spark, n):
    rows = list(enumerate([" ".join("abcdefgh"[:n])] * 3 + ["z"]))
    got = sorted(tuple(r) for r in jaccard_join.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
