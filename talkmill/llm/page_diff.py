"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

- **Lines.** A page is read once, tolerant of missing and crossed tags, into lines: the text of a block, references decoded, white
  space collapsed, next to the path of block elements that it lies in. Markup that says what it is goes at once: scripts,
  styles, forms, ``nav``, ``aside``, ``footer``, page headers, hidden parts, and elements whose class, id or role names a menu,
  an advert, a notice or comments (``MARKED``). If nothing is left, the page is read again without regard to names.
- **Pairs.** Pages are ordered by host and URL path over range partitions. The neighbour in that order with the longer common path is
  the partner. Neighbours that are copies of the page are passed over: the other one is taken, if it is no copy.
- **Difference.** The longest common subsequence of the lines of both pages (bit-parallel, in linear memory) is what they share,
  and shared lines are deleted: they are the template of the host.
- **Article.** Where the page marks its article (``article``, ``articleBody``, or else ``main``), only lines inside are text, and an article may
  quote what its neighbour quotes: a shared line there is deleted only where the host's pairs share at least half of all lines
  of its path, so that the path, not the line, belongs to the template.

Copies: a page that shares more than ``COPY`` of its characters with the partner (``COPY_INSIDE`` of its article) says nothing about the
template; its lines stay. A page alone on its host, or without a readable URL, has no partner. Null pages are empty
texts. Equal rows have equal results; rows with one URL and different pages are pages of their own.
"""

from __future__ import annotations

import html as references
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkmill.llm.files import new_folder
from talkmill.operators.scan import SLICE, sliced

COPY, COPY_INSIDE, TEMPLATE = 0.9, 0.5, 0.5
SALTS = 16

# Fixed lists: elements by how they are read, and names that authors give to parts that are not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
BORDERS = {"table", "td", "th", "body", "html"}
DROPPED = RAW | set(
    "nav aside footer form menu head noscript template object embed svg canvas audio video select button datalist dialog "
    "label option optgroup fieldset search".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MARKED = set(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe signup sidebar sidenav nav navbar navigation menu breadcrumb "
    "breadcrumbs footer header masthead topbar toolbar comment comments commentlist reply replies discussion disqus share "
    "sharing social related recommended recommendations widget pagination pager login".split()
)
COMMENTS = {"comment", "comments", "commentlist", "reply", "replies", "discussion", "disqus"}
HEADERS = {"header", "masthead", "banner"}
NEGATED = {"with", "has", "no", "non", "not", "without", "is", "js", "hide", "before", "after", "under", "above", "below"}
HOLDERS = {"html", "body", "main", "article"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {n: re.compile(f"</{n}(?=[\\s/>])", re.I) for n in RAW}


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), references.unescape(value.strip("\"'")))
    return found


def _names(attributes: dict[str, str]):
    """Words of each class and id name."""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _NAME.findall(name)]
        if words:
            yield words


def _marked(name: str, attributes: dict[str, str], article: bool) -> bool:
    """Whether names, role or style say that the element is no part of the article."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES and name not in HOLDERS:
        return True
    for words in _names(attributes):
        last = words[-1]
        if last not in MARKED or words[0] in NEGATED or (article and last in HEADERS):
            continue
        if name not in HOLDERS or (name == "article" and last in COMMENTS):
            return True
    return False


class _Page:
    """Open elements of a page while it is read; one pass, linear in the page."""

    def __init__(self, names: bool):
        self.by_names = names
        self.open: list[tuple[str, bool, int, str]] = []  # name, dropped, what it holds (2 article, 1 main), path
        self.places: dict[str, list[int]] = {}
        self.borders: list[int] = []
        self.text: list[str] = []
        self.lines: list[tuple[str, str, int]] = []

    def flush(self) -> None:
        if self.text:
            line = "".join(self.text)
            line = " ".join((references.unescape(line) if "&" in line else line).split())
            self.text = []
            if line:
                _, _, holds, path = self.open[-1] if self.open else ("", False, 0, "")
                self.lines.append((line, path, holds))

    def push(self, name: str, dropped: bool, holds: int, path: str) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        if name in BORDERS:
            self.borders.append(len(self.open))
        self.open.append((name, dropped, holds, path))

    def pop(self) -> None:
        name = self.open.pop()[0]
        self.places[name].pop()
        if name in BORDERS:
            self.borders.pop()

    def close(self, name: str) -> None:
        """Close the innermost element of this name, unless a table cell or the page's body lies in between."""
        places = self.places.get(name)
        if not places or (name not in BORDERS and self.borders and places[-1] < self.borders[-1]):
            return
        at = places[-1]
        if name in BLOCK or any(x[0] in BLOCK for x in self.open[at:]):
            self.flush()
        while len(self.open) > at:
            self.pop()

    def start(self, name: str, text: str) -> None:
        if name in BLOCK:
            self.flush()
            if name != "html" and name != "body":
                self.close("p")
            closes = CLOSES.get(name, ())
            while self.open and self.open[-1][0] in closes:
                self.pop()
        elif name == "br":
            self.text.append(" ")
        if name in VOID:
            return
        _, dropped, holds, path = self.open[-1] if self.open else ("", False, 0, "")
        if dropped:
            return self.push(name, True, holds, path)
        found = _attributes(text) if "=" in text or "hidden" in text else {}
        if name == "article" or "articlebody" in found.get("itemprop", "").lower().split():
            holds = 2
        elif not holds and (name == "main" or found.get("role", "").lower() == "main"):
            holds = 1
        dropped = name in DROPPED or (name == "header" and holds < 2) or (self.by_names and _marked(name, found, holds == 2))
        if dropped or name in BLOCK:
            names = ".".join(sorted(_DIGITS.sub("", c) for c in found.get("class", "").split()))
            self.push(name, dropped, holds, f"{path}/{name}.{names}" if name in BLOCK else path)


def lines(page: str | None, names: bool = True) -> list[tuple[str, str, int]]:
    """``(text, path, holds)`` of the lines of a page; ``holds`` is 2 inside an article, 1 inside ``main``, else 0."""
    page = page or ""
    state, at, size = _Page(names), 0, len(page)
    while at < size:
        begin = page.find("<", at)
        end = size if begin < 0 else begin
        if end > at and not (state.open and state.open[-1][1]):
            state.text.append(page[at:end])
        if begin < 0:
            break
        sign = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 2)
            at = size if stop < 0 else stop + 3
        elif sign in "!?" and sign:
            stop = page.find(">", begin)
            at = size if stop < 0 else stop + 1
        elif sign.isalpha() and sign.isascii() or (sign == "/" and page[begin + 2 : begin + 3].isalpha()):
            tag = _TAG.match(page, begin)
            if tag:
                ends, name, rest = tag.group(1), tag.group(2).lower(), tag.group(3)
                at = tag.end()
            else:  # a quote that never closes
                stop = page.find(">", begin)
                if stop < 0:
                    break
                ends = "/" if sign == "/" else ""
                body = page[begin + 1 + len(ends) : stop].split(None, 1)
                name, rest = (body[0].rstrip("/").lower() if body else ""), ""
                at = stop + 1
            if ends:
                state.close(name)
                continue
            state.start(name, rest)
            if name in RAW:
                stop = _ENDS[name].search(page, at)
                at = size if stop is None else stop.start()
        else:
            if not (state.open and state.open[-1][1]):
                state.text.append("<")
            at = begin + 1
    state.flush()
    found = state.lines
    if not found and names:
        return lines(page, False)
    top = max((h for _, _, h in found), default=0)
    return [x for x in found if x[2] == top]


def _zeros(bits: int, size: int) -> np.ndarray:
    """Number of zero bits below each of the first ``size`` places."""
    raw = np.frombuffer(bits.to_bytes(size // 8 + 1, "little"), np.uint8)
    return np.append(0, np.cumsum(1 - np.unpackbits(raw, bitorder="little")[:size].astype(np.int64)))


def _row(a: list, b: list) -> np.ndarray:
    """Length of the common subsequence of ``b`` with every prefix of ``a``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return _zeros(v, len(a))


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both lists, in linear memory."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        s, e, p, q = todo.pop()
        while s < e and p < q and a[s] == b[p]:
            out.append((s, p))
            s, p = s + 1, p + 1
        while s < e and p < q and a[e - 1] == b[q - 1]:
            e, q = e - 1, q - 1
            out.append((e, q))
        mine, other = set(a[s:e]), set(b[p:q])
        i = [k for k in range(s, e) if a[k] in other]
        j = [k for k in range(p, q) if b[k] in mine]
        if not i or not j:
            continue
        if len(j) == 1:
            out.append((next(k for k in i if a[k] == b[j[0]]), j[0]))
            continue
        x, y = [a[k] for k in i], [b[k] for k in j]
        half = len(y) // 2
        total = _row(x, y[:half]) + _row(x[::-1], y[half:][::-1])[::-1]
        cut = int(total.argmax())
        left, right = i[cut] if cut < len(i) else e, j[half]
        # Lines without a match may lie on either side; they are left out again in the halves.
        todo += [(s, left, p, right), (left, e, right, q)]
    return sorted(out)


def _place(url: str | None) -> tuple[str | None, str | None]:
    """Host and path of a URL; null if it has no host."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
    except ValueError:
        return None, None
    path = re.sub(r"(/|\.html?|/index\.html?)$", "", parts.path)
    return (host, path) if host else (None, None)


def _near(path: str, other: str) -> tuple[int, int]:
    """Common leading segments and characters of two paths."""
    a, b = path.split("/"), other.split("/")
    segments = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    characters = next((k for k, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))
    return segments, characters


def difference(page: dict, others: list[dict | None]) -> tuple[list[int], list[int], bool]:
    """``(shared, deleted, inside)`` line numbers of a page against the better of its neighbours.

    ``shared`` are all shared lines if the partner is no copy, ``deleted`` those that go at once, which are all of them unless the
    page marks its article (``inside``).
    """
    inside = bool(page["inside"])
    limit = COPY_INSIDE if inside else COPY
    near = [o for o in others if o is not None and o["host"] == page["host"] and page["host"] is not None]
    near.sort(key=lambda o: _near(page["path"], o["path"]), reverse=True)
    size = page["sizes"]
    for other in near:
        shared = [i for i, _ in common(page["hashes"], other["hashes"])]
        if sum(size[i] for i in shared) <= limit * sum(size):
            return shared, [] if inside else shared, inside
    return [], [], inside


_SLIM = (
    "key string, host string, path string, hashes array<long>, paths array<long>, sizes array<int>, inside boolean"
)


def _digests(values: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(v) - (1 << 63) for v in values]


def _read_slim(batches):
    """What pairing needs of each page: hashes of its lines and their paths, no text."""
    for batch in batches:
        rows = []
        for key, url, page in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html"))):
            found = lines(page)
            host, path = _place(url)
            text, paths, holds = zip(*found) if found else ((), (), ())
            rows.append((key, host, path, _digests(text), _digests(paths), [len(t) for t in text], any(holds)))
        names = ["key", "host", "path", "hashes", "paths", "sizes", "inside"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_()]
        columns = zip(*rows) if rows else [[] for _ in names]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _compare(batches):
    for batch in batches:
        out = []
        for page in batch.to_pylist():
            shared, deleted, inside = difference(page["page"], [page["before"], page["after"]])
            stats = {}
            if inside and (page["page"]["host"] is not None):
                gone = set(shared)
                for i, p in enumerate(page["page"]["paths"]):
                    n, k = stats.get(p, (0, 0))
                    stats[p] = n + 1, k + (i in gone)
            doubt = [(i, page["page"]["paths"][i]) for i in shared] if inside else []
            out.append(
                {
                    "key": page["page"]["key"], "host": page["page"]["host"], "deleted": deleted,
                    "doubt": [{"line": i, "path": p} for i, p in doubt],
                    "stats": [{"path": p, "n": n, "k": k} for p, (n, k) in stats.items()],
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema=_COMPARED)


_COMPARED = pa.schema(
    [
        ("key", pa.string()), ("host", pa.string()), ("deleted", pa.list_(pa.int32())),
        ("doubt", pa.list_(pa.struct([("line", pa.int32()), ("path", pa.int64())]))),
        ("stats", pa.list_(pa.struct([("path", pa.int64()), ("n", pa.int64()), ("k", pa.int64())]))),
    ]
)
_COMPARED_SQL = (
    "key string, host string, deleted array<int>, doubt array<struct<line: int, path: bigint>>, "
    "stats array<struct<path: bigint, n: bigint, k: bigint>>"
)


def _with_neighbours(slim: DataFrame) -> DataFrame:
    """Each page with the pages before and after it in the order of host and path, over the borders of slices."""
    order = ["host", "path", "key"]
    rows = sliced(slim, order)
    page = F.struct(*[c for c in slim.columns])
    here = W.partitionBy(SLICE).orderBy(*order)
    place = F.struct(F.col("host").isNotNull().alias("known"), *[F.coalesce(c, F.lit("")).alias(c) for c in order])
    ends = rows.groupBy(SLICE).agg(F.min_by(page, place).alias("first"), F.max_by(page, place).alias("last"))
    by_slice = W.orderBy(SLICE)  # one row per slice
    edges = ends.select(SLICE, F.lag("last").over(by_slice).alias("left"), F.lead("first").over(by_slice).alias("right"))
    out = rows.select(SLICE, page.alias("page"), F.lag(page).over(here).alias("before"), F.lead(page).over(here).alias("after"))
    # Only the first and the last page of a slice look beyond it.
    inner = out.where(F.col("before").isNotNull() & F.col("after").isNotNull()).drop(SLICE)
    outer = out.where(F.col("before").isNull() | F.col("after").isNull()).join(edges, SLICE)
    outer = outer.select("page", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))
    return inner.unionByName(outer)


def deleted_lines(pages: DataFrame) -> DataFrame:
    """``(key, deleted)``: line numbers that differencing deletes, for pages ``(key, url, html)`` that lose any."""
    slim = pages.mapInArrow(_read_slim, _SLIM).dropDuplicates(["key"])
    compared = _with_neighbours(slim).mapInArrow(_compare, _COMPARED_SQL)
    folder = _written(compared, "differences")
    stats = folder.select("host", F.inline("stats")).groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    templates = stats.where((F.col("k") > 0) & (F.col("k") >= TEMPLATE * F.col("n"))).select("host", "path")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt")
    doubt = folder.select("key", "host", salt, F.inline("doubt"))
    sure = doubt.join(templates.select("host", "path", salts), ["host", "path", "salt"]).select("key", "line")
    lost = folder.select("key", F.explode("deleted").alias("line")).unionByName(sure)
    return lost.groupBy("key").agg(F.collect_set("line").alias("deleted"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def extract(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """The main text of every page, next to the columns ``keep``, all if not given; a column named ``out`` is replaced."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col(f"`{url}`"), F.lit("")), F.coalesce(F.col(f"`{html}`"), F.lit(""))))
    pages = df.select(key.alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    rows = df.select(
        key.alias("key"),
        F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(f"`{html}`").alias("html"),
    )
    rows = rows.join(deleted_lines(pages), "key", "left").select("row", "html", "deleted")
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = []
            for page, deleted in zip(batch.column("html").to_pylist(), batch.column("deleted").to_pylist()):
                gone = set(deleted or ())
                texts.append(" ".join(t for i, (t, _, _) in enumerate(lines(page)) if i not in gone))
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    done = rows.mapInArrow(run, f"row {kind}, text string")
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("text").alias(out))
