import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkmill.llm import token_alignment as ta
from talkmill.llm.queries import BYTE_VOCABULARY, VOCABULARY, op13_token_alignment
from talkmill.llm.registry import table

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a", "  two  spaces ", "▁", "a▁b", "<|endoftext|> <s></s><unk><0x41>", "x" * 3000, "日本語のテキスト",
    "é́ é ﬁ Å", "\x00\x01\x7f", "😀👨‍👩‍👧 emoji", "tab\tnew\r\nline  　end", "it's we'll I'VE", "same text", "same text", "1234567 ½ ² ٣",
]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def read(path):
    with open(path, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def sides():
    return ta._tokenizers(read(BYTE_VOCABULARY), read(VOCABULARY))


def brute(texts):
    """The contract, token by token, with the libraries' own tokenizers."""
    one = Tokenizer.from_file(BYTE_VOCABULARY)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    byte = ta._byte_of()
    names = {i: bytes(byte.get(c, 0) for c in n) for n, i in one.get_vocab(with_added_tokens=False).items()}

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    def of_piece(i):
        return bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()

    rows, corpus = [], Counter()
    for t in texts:
        want = b" " + (t or "").encode()
        a = one.encode(" " + (t or ""), add_special_tokens=False).ids
        b = two.encode(t or "")
        bytes_a, bytes_b = [names[i] for i in a], [of_piece(i) for i in b]
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            rows.append(None)
            continue
        sa, sb = spans(bytes_a), spans(bytes_b)
        links, i, j = [], 0, 0
        while i < len(sa) and j < len(sb):
            links.append((a[i], b[j]))
            end_a, end_b = sa[i][1], sb[j][1]
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        cuts = [0, *sorted({e for _, e in sa} & {e for _, e in sb})]
        groups = []
        for s, e in zip(cuts, cuts[1:]):
            ids = [",".join(str(i) for i, (x, y) in zip(side, sp) if s <= x and y <= e) for side, sp in ((a, sa), (b, sb))]
            groups.append("|".join(ids))
        corpus.update(links)
        rows.append((len(a), len(b), links, groups))
    best = Counter()
    for (_, b), n in corpus.items():
        best[b] = max(best[b], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = r
        counts = [corpus[x] for x in links]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(links), sum(c == best[x[1]] for c, x in zip(counts, links)), sum(counts), sha))
    return out


def test_query(spark, tmp_path):
    """Every row against token-by-token alignment, over given and odd texts in small chunks."""
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").collect()] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_a", F.lit("x"))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(op13_token_alignment(spark, str(tmp_path)).collect())
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == brute(texts)
    assert sum(r.n_a == 0 for r in rows) < 10


def test_same_ids_as_the_file(sides):
    """Every code point that texts can hold, in words, numbers and white space."""
    one = Tokenizer.from_file(BYTE_VOCABULARY)
    one.encode_special_tokens = True
    assert sides[0]._fast is not None
    points = [chr(c) for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3100)]
    texts = [f"a{c}{c}1 {c}{c}'{c}s  {c} b" for c in points]
    found = sides[0].encode(texts)
    want = one.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    assert [f.tolist() for f in found] == [w.ids for w in want]


@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_pieces_stitch_to_the_whole(x, y, steps):
    """Any number of pieces gives what one piece gives, and that is every overlap."""
    a, b = np.cumsum(x), np.cumsum(y)
    top = max(a[-1], b[-1])
    a, b = np.append(a, [] if a[-1] == top else top).astype(int), np.append(b, [] if b[-1] == top else top).astype(int)
    found = [np.concatenate(c).tolist() for c in zip(*ta.pieces(a, b, steps))]
    starts = [np.append(0, e[:-1]) for e in (a, b)]
    overlaps = [
        (i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]
    ]
    assert list(zip(found[0], found[1])) == overlaps
    cuts = [(i + 1, j + 1) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
    assert list(zip(found[2], found[3])) == cuts
    i, j = ta.diagonals(a, b, steps)
    assert (np.diff(i + j)[:-1] == steps).all() and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()


def test_small_pieces_and_shards(spark, sides, monkeypatch):
    texts = [r.text for r in table(spark, SF, "documents").limit(30).collect()]
    ids_a, n_a, ids_b, n_b = ta.encode_chunk(*sides, texts)
    ends = [np.cumsum(s.bytes.size[i]) for s, i in zip(sides, (ids_a, ids_b))]
    whole = ta.pair_counts(ids_a, ids_b, *ends, len(sides[1].bytes))
    monkeypatch.setattr(ta.pieces, "__defaults__", (97,))
    small = ta.pair_counts(ids_a, ids_b, *ends, len(sides[1].bytes))
    assert all((x == y).all() for x, y in zip(whole, small))
    monkeypatch.setattr(ta, "SHARD_PAIRS", 1000)
    pairs, links = whole
    table_ = spark.createDataFrame([(int(p), int(n)) for p, n in zip(pairs, links)], "pair long, n long")
    totals = ta._write_totals(table_.unionAll(table_), len(sides[1].bytes))
    assert len(totals.shards) > 2
    counts, best = totals(pairs)
    assert (counts == 2 * links).all()
    most = {}
    for p, n in zip(pairs.tolist(), counts.tolist()):
        b = p % len(sides[1].bytes)
        most[b] = max(most.get(b, 0), n)
    assert best.tolist() == [n == most[p % len(sides[1].bytes)] for p, n in zip(pairs.tolist(), counts.tolist())]


def test_groups_and_empty(spark):
    df = spark.createDataFrame([(1, "Hello wörld"), (None, None)], "id long, text string").withColumn("digest", F.lit(1))
    rows = ta.align(df, BYTE_VOCABULARY, VOCABULARY, groups=True).orderBy("id").collect()
    assert rows[0].a == [] and rows[0].digest == "" and rows[0].text is None
    r = rows[1]
    assert len(r.a) == r.n_a == r.end_a[-1] and len(r.b) == r.n_b == r.end_b[-1] and len(r.end_a) == r.n_groups
    parts, i, j = [], 0, 0
    for x, y in zip(r.end_a, r.end_b):
        parts.append(",".join(map(str, r.a[i:x])) + "|" + ",".join(map(str, r.b[j:y])))
        i, j = x, y
    assert hashlib.sha256(";".join(parts).encode()).hexdigest() == r.digest
    none = ta.align(df.where("id = 7"), BYTE_VOCABULARY, VOCABULARY)
    assert none.count() == 0 and "n_best" in none.columns
