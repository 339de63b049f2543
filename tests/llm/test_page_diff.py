import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkmill.llm import page_diff as pd
from talkmill.llm.queries import op12_page_diff
from talkmill.llm.registry import table

SF = "/root/testdata/sf0.001"


def texts(page):
    return [t for t, _, _ in pd.lines(page)]


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in pd.extract(df).collect()}


def length(a, b):
    """Longest common subsequence by the plain table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
@settings(max_examples=300, deadline=None)
def test_common_is_a_longest_common_subsequence(a, b):
    found = pd.common(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    assert len(found) == length(a, b)


def test_common_of_long_lists():
    rng = random.Random(1)
    a = [rng.randrange(3000) for _ in range(4000)]
    b = [x for x in a if rng.random() < 0.7] + [rng.randrange(3000) for _ in range(500)]
    assert len(pd.common(a, b)) >= 0.65 * len(a)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("just text", ["just text"]),
        ("<p>a &amp; b&nbsp;c &#233; &lt;p&gt;<br>d</p><p>e", ["a & b c é <p> d", "e"]),
        ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        ('<script>var t="</p><p>x";</script><style>p{}</style><p>y</p><!-- <p>no</p> --><p>z', ["y", "z"]),
        ("<body><nav><ul><li>menu</ul></nav><article><header><h1>t</h1></header><p>x<aside>no</aside>y</p></article>foot", ["t", "x", "y"]),
        ("<main><p>m</p><form><label>l</label><input><button>b</button></form></main><p>out</p>", ["m"]),
        ('<article><p>a<b class="x">b</b>c<span class="ad">no</span>d</p><div class="comments"><p>c1</p></div></article>', ["abcd"]),
        ('<div class="with-sidebar"><p>kept</p></div><div class="leftSidebar">no</div><div id="cookie-notice">no</div>', ["kept"]),
        ('<div class="ad"><p>all there is</p></div>', ["all there is"]),
        ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes</p>", ["yes"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", ["1", "2", "3", "4"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("a < b and 1<2 <3", ["a < b and 1<2 <3"]),
        ("<p>a<b>unclosed <br><p>next</b>x</div></p>", ["aunclosed", "nextx"]),
        ("<p title='>' data-x=\"<p>\">t</p>", ["t"]),
        ("<p title='never closed>t</p>", ["t"]),
        ("<p>a</p><textarea>no</textarea><select><option>no</select><p>b</p><iframe><p>no</iframe>", ["a", "b"]),
        ("<p>a</p><script>never closed <p>no</p>", ["a"]),
        ("<article class='comment'><p>no</p></article><article><p>yes</p></article>", ["yes"]),
        ("<p>a</p><", ["a", "<"]),
        ("<p>a</p></", ["a", "</"]),
        ("<p>a</p><p", ["a"]),
    ],
)
def test_lines(page, want):
    assert texts(page) == want


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<", ">", "x", "<li", '"', "'", "<!--", "-->", "<td>", "</td>", "<nav>", "&#", "<script>", "</script>"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_lines_never_fail(parts):
    assert all(t for t in texts(" ".join(parts)))


def test_long_pages_are_linear():
    for part in ("<a '", "<p><b class=ad>", "</div><div>x", "<td><table>y"):
        pd.lines(part * 40_000)


def article(k, words="w", extra=""):
    body = "".join(f"<div class='x{k}'>{words} {k} {j}</div>" for j in range(4))
    return (
        f"<html><body><div class='top'>Our site</div><div>Home</div><div>News</div>{body}{extra}"
        "<div>All rights reserved</div><div>Contact us</div></body></html>"
    )


def test_pages_without_marks(spark):
    """The template shared with the nearest URL goes; copies, single pages and pages without a URL lose nothing."""
    rows = [(k, f"http://h.example/news/{k}.html", article(k)) for k in range(8)]
    rows += [(20, "http://alone.example/a", article(20)), (21, None, article(21)), (22, "http://[bad", article(22))]
    rows += [(k, f"http://copy.example/{k}", article(30)) for k in (30, 31, 32)]
    found = extracted(spark, rows)
    for k in range(8):
        assert found[k] == " ".join(f"w {k} {j}" for j in range(4))
    whole = "Our site Home News " + " ".join(f"w {{0}} {j}" for j in range(4)) + " All rights reserved Contact us"
    assert found[20] == whole.format(20) and found[21] == whole.format(21) and found[22] == whole.format(22)
    assert {found[k] for k in (30, 31, 32)} == {whole.format(30)}


def test_nearest_url(spark):
    """Two templates on one host: the partner is the page of the same section, so each section's own lines go too."""
    rows = []
    for section in ("aa", "bb"):
        for k in range(5):
            extra = f"<div>Section {section}</div>"
            rows.append((len(rows), f"https://h.example/{section}/{k}?x={random.random()}", article(len(rows), extra=extra)))
    found = extracted(spark, rows)
    assert all(t == " ".join(f"w {k} {j}" for j in range(4)) for k, t in found.items())


def test_marked_articles(spark):
    """Inside an article a line of the template goes; a quoted line, and copies of whole articles, stay."""

    def page(k, quote="", body=None):
        own = body or "".join(f"<p>own text of page {k}, line {j}</p>" for j in range(6))
        return f"<nav>menu {k}</nav><article><h1>t{k}</h1>{own}{quote}<div>Read more here</div></article><div>tail</div>"

    rows = [(k, f"http://h.example/{k}", page(k, "<p>licence line</p>" if k in (3, 4) else "")) for k in range(10)]
    rows += [(k, f"http://h.example/z{k}", page(7, body="<p>the same long article of many pages, word for word</p>" * 3)) for k in range(20, 30)]
    found = extracted(spark, rows)
    own = {k: f"t{k} " + " ".join(f"own text of page {k}, line {j}" for j in range(6)) for k in range(10)}
    for k in range(10):
        assert found[k] == own[k] + (" licence line" if k in (3, 4) else "")
    assert len({found[k] for k in range(21, 30)}) == 1 and "word for word" in found[25] and "Read more" in found[25]


def brute(rows):
    """The whole method without Spark: order, partners, differences, votes."""
    pages = []
    for i, (_, url, html) in enumerate(rows):
        found = pd.lines(html)
        host, path = pd._place(url)
        pages.append({"i": i, "url": url, "html": html, "host": host, "path": path, "lines": found})
    unique = {(p["url"] or "", p["html"] or ""): p for p in pages}
    import hashlib

    for (url, html), p in unique.items():
        p["key"] = hashlib.md5(f"{url}\x1f{html}".encode()).hexdigest()
    line = sorted((p for p in unique.values() if p["host"]), key=lambda p: (p["host"], p["path"], p["key"]))
    gone, votes, doubt = {}, {}, {}
    for at, p in enumerate(line):
        inside = any(h for _, _, h in p["lines"])
        size = [len(t) for t, _, _ in p["lines"]]
        near = [q for q in (line[at - 1] if at else None, line[at + 1] if at + 1 < len(line) else None) if q and q["host"] == p["host"]]
        near.sort(key=lambda q: pd._near(p["path"], q["path"]), reverse=True)
        shared = []
        for q in near:
            s = [i for i, _ in pd.common([t for t, _, _ in p["lines"]], [t for t, _, _ in q["lines"]])]
            if sum(size[i] for i in s) <= (0.5 if inside else 0.9) * sum(size):
                shared = s
                break
        gone[p["key"]] = set() if inside else set(shared)
        if inside:
            doubt[p["key"]] = (p, shared)
            for i, (_, path, _) in enumerate(p["lines"]):
                n, k = votes.get((p["host"], path), (0, 0))
                votes[p["host"], path] = n + 1, k + (i in shared)
    for key, (p, shared) in doubt.items():
        for i in shared:
            n, k = votes[p["host"], p["lines"][i][1]]
            if 2 * k >= n:
                gone[key].add(i)
    out = []
    for p in pages:
        key = unique[p["url"] or "", p["html"] or ""].get("key")
        out.append(" ".join(t for i, (t, _, _) in enumerate(p["lines"]) if i not in gone.get(key, ())))
    return out


def test_query(spark, tmp_path):
    """All given pages, and pages of one host with shared, copied and odd parts, against the method without Spark."""
    given_pages = [(r.page_id, r.url, r.html) for r in table(spark, SF, "pages").orderBy("page_id").collect()]
    rng = random.Random(4)
    mixed = []
    for k in range(120):
        parts = [f"<p>{rng.choice(['shared', 'line', 'other'])} {rng.randrange(6)}</p>" for _ in range(rng.randrange(12))]
        body = "".join(parts)
        mixed.append((1000 + k, f"http://h.example/{rng.randrange(4)}/{rng.randrange(40)}", rng.choice([body, f"<article>{body}</article>"])))
    rows = given_pages + mixed + mixed[:5] + [(None, None, None), (None, "http://h.example/1/1", None), (7, "x", "<p>a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    df.repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    out = op12_page_diff(spark, str(tmp_path)).collect()
    assert out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    want = sorted((str(r[0]), str(r[1]), t, len(t)) for r, t in zip(rows, brute(rows)))
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in out) == want
    assert sum(bool(t) for _, _, t, _ in want) > len(given_pages)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert pd.extract(df).columns == ["page_id", "url", "html", "text"] and pd.extract(df).count() == 0
