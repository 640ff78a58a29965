"""HTML extraction: structure first, then differencing of pages with near URLs.

A page is read once into blocks. Scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms
and comments go by element, role, class or id; where the page has an article or main element, only that is
kept. Blocks that structure vouches for (paragraphs, headings, lists and the like in the article) stay. All
others are doubtful: pages of a host are paired with their neighbours in order of the URL's path, the
doubtful lines of both are aligned by longest common subsequence, and shared lines are deleted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Fixed values of HTML: elements without an end tag, with raw text, and that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never the article's.
FURNITURE = frozenset("nav footer aside form menu dialog button select noscript template iframe object svg canvas audio video head fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Elements that vouch for their text inside an article.
TRUSTED = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
#: Words of class and id attributes that mark furniture.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist cookie cookies consent disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion "
    "related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


def is_furniture(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element and all in it is no part of the article; a header inside the article is."""
    if name in FURNITURE or (name == "header" and not inside):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and not MARKED.isdisjoint(re.split(r"[^a-z]+", CAMEL.sub("-", value).lower())):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """The blocks of a page in order, as (text, doubtful); those of furniture are left out.

    White space in a block is one blank. If there is an article or main element, only blocks in one are kept.
    """
    page = page or ""
    found: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[str] = []
    cut_at = -1  # depth of the furniture element that is open
    inside = trusted = 0

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                found.append((text, inside > 0, trusted > 0))
            parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if cut_at < 0:
            parts.append(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK and cut_at < 0:
            close()
        if m[1]:
            if name in stack:
                while stack:
                    top = stack.pop()
                    inside -= top in ("article", "main")
                    trusted -= top in TRUSTED
                    if top == name:
                        break
                if len(stack) <= cut_at:
                    cut_at = -1
            continue
        if name in ("article", "main") and cut_at >= 0 and not any(x in ("article", "main") for x in stack[cut_at:]):
            if stack[cut_at] in ("nav", "header", "footer", "aside", "head", "form"):  # it was never closed
                cut_at = -1
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in ("p", "li", "td", "th", "tr", "option", "dt", "dd") and name in stack:  # a new one ends the open one, unless a list or table lies between
            k = len(stack) - 1 - stack[::-1].index(name)
            if not any(x in ("ul", "ol", "dl", "table", "div", "section", "article", "blockquote") for x in stack[k + 1 :]) and k > cut_at:
                while len(stack) > k:
                    top = stack.pop()
                    trusted -= top in TRUSTED
        if cut_at < 0 and is_furniture(name, m[3], inside > 0):
            close()
            cut_at = len(stack)
        stack.append(name)
        inside += name in ("article", "main")
        trusted += name in TRUSTED
    close()
    if any(within for _, within, _ in found):
        return [(t, not sure) for t, within, sure in found if within]
    return [(t, True) for t, _, _ in found]


def shared(a: list[str], b: list[str]) -> list[int]:
    """Places in a of the lines of one longest common subsequence of a and b.

    Rows of the table are bit strings; every 256th is kept and the others are made again on the way back.
    """
    if not a or not b:
        return []
    full = (1 << len(a)) - 1
    masks: dict[str, int] = {}
    for i, line in enumerate(a):
        masks[line] = masks.get(line, 0) | 1 << i

    def step(v: int, line: str) -> int:
        u = v & masks.get(line, 0)
        return ((v + u) | (v - u)) & full

    kept, v = [full], full
    for j, line in enumerate(b):
        v = step(v, line)
        if (j + 1) % 256 == 0:
            kept.append(v)
    out, i, j = [], len(a) - 1, len(b)
    rows: list[int] = []
    while i >= 0 and j > 0:
        base = (j - 1) // 256 * 256
        rows = [kept[base // 256]]
        for line in b[base:j]:
            rows.append(step(rows[-1], line))
        while i >= 0 and j > base:
            if rows[j - base] >> i & 1:  # a[:i + 1] adds nothing here
                i -= 1
            elif not rows[j - base - 1] >> i & 1:
                j -= 1
            else:
                out.append(i)
                i -= 1
                j -= 1
    return out[::-1]


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty if there is none."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.netloc or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def _doubtful(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"id": [], "host": [], "path": [], "lines": []}
            for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lines := [t for t, doubt in blocks(h) if doubt]:
                    host, path = url_key(u)
                    for k, v in zip(rows, (i, host, path, lines), strict=True):
                        rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"], batch.column(0).type), pa.array(rows["host"], pa.string()), pa.array(rows["path"], pa.string()), pa.array(rows["lines"], pa.list_(pa.string()))], list(rows))

    return pages.select(F.col(key).alias("id"), url, page).mapInArrow(run, f"id {pages.schema[key].dataType.simpleString()}, host string, path string, lines array<string>")


def _deletions(rows: DataFrame) -> DataFrame:
    """(id, gone): for pages with doubtful lines, the places of those that a neighbour in (host, path) order has too."""
    scratch = Scratch(rows.sparkSession, "html")
    dealt = scratch.table(rows.repartitionByRange("host", "path", "id").withColumn("part", F.spark_partition_id()))
    order = F.struct("host", "path", "id")
    ends = dealt.groupBy("part").agg(F.min(F.struct(order.alias("k"), "lines")).alias("lo"), F.max(F.struct(order.alias("k"), "lines")).alias("hi"))  # one row a partition
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select(F.col("part").alias("p"), F.lag("hi").over(every).alias("left"), F.lead("lo").over(every).alias("right"))
    w = Window.partitionBy("part").orderBy("host", "path", "id")
    near = dealt.select("*", order.alias("k"), F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("part")).alias("of"),
                        F.lag(F.struct(order.alias("k"), "lines")).over(w).alias("a"), F.lead(F.struct(order.alias("k"), "lines")).over(w).alias("b"))
    near = near.join(ends, F.col("part") == F.col("p"), "left")
    near = near.select("id", "host", "lines", F.coalesce("a", F.when(F.col("n") == 1, F.col("left"))).alias("a"), F.coalesce("b", F.when(F.col("n") == F.col("of"), F.col("right"))).alias("b"))
    same = lambda c: F.when(F.col(f"{c}.k.host") == F.col("host"), F.col(f"{c}.lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, gone = [], []
            for i, lines, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at := sorted({*shared(lines, a or []), *shared(lines, b or [])}):
                    ids.append(i)
                    gone.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(gone, pa.list_(pa.int32()))], ["id", "gone"])

    return scratch.table(near.select("id", "lines", same("a").alias("a"), same("b").alias("b")).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, gone array<int>"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row a page: key, url, text (blocks joined by line ends; empty if none), n_chars (code points).

    Null pages count as empty. Pages without a URL share the empty host. A page repeated as it is is its own
    neighbour, so its doubtful lines go; key has to be unique otherwise. Deletions are read back from a table:
    Spark broadcasts it only while its files are below the session's threshold.
    """
    gone = _deletions(_doubtful(pages, key, url, page)).groupBy("id").agg(F.max("gone").alias("gone")).select(F.col("id").alias("__id"), F.col("gone").alias("__gone"))
    both = pages.select(key, F.col(url).alias("url"), F.col(page).alias("__html")).join(gone, F.col(key) == F.col("__id"), "left").select(key, "url", "__html", "__gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for h, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                drop, n, kept = set(cut or ()), -1, []
                for t, doubt in blocks(h):
                    n += doubt
                    if not (doubt and n in drop):
                        kept.append(t)
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "url", "text", "n_chars"])

    return both.mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, text string, n_chars long")
