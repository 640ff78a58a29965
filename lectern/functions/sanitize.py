"""Chapters as inert HTML: an allow list of elements and attributes, links rewritten to the files of the book, and the plain text."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Collection
from html import escape
from html.parser import HTMLParser
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that stay, those that end a line of the plain text, those that go with all they hold, and attributes that stay.
BLOCKS = frozenset("""p div h1 h2 h3 h4 h5 h6 blockquote li dt dd tr caption figure figcaption section article aside header footer main nav pre table ul ol dl hr br""".split())
ALLOWED = BLOCKS | frozenset(
    """span em i strong b u s small sup sub q cite abbr dfn mark time wbr thead tbody tfoot td th colgroup col img code kbd samp var a ruby rt rp bdi bdo ins del""".split()
)
DROPPED = frozenset(
    """script style iframe object embed svg video audio form input button select textarea template link meta base noscript math canvas dialog slot portal""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ATTRIBUTES = {
    "img": "alt width height", "td": "colspan rowspan", "th": "colspan rowspan scope", "col": "span", "colgroup": "span", "time": "datetime", "bdo": "dir", "ol": "start reversed type",
}
LONGEST = 256
#: What an element's start ends, if that is the innermost open element.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}}


def resolve(url: str, folder: str, known: Collection[str]) -> str | None:
    """The file of the book, or the fragment, that a link of a chapter in `folder` leads to; None for any other link."""
    if re.match(r"(?i)[a-z][a-z0-9+.-]*:|/", url):
        return None
    name, _, rest = url.partition("#")
    fragment = rest.partition("#")[0]
    if not name:
        return f"#{fragment}" if fragment else None
    try:
        file = posixpath.normpath(posixpath.join(folder, unquote(name, errors="strict")))
    except UnicodeDecodeError:
        return None
    if file not in known:
        return None
    return f"{file}#{fragment}" if fragment else file


class _Cleaner(HTMLParser):
    """Writes what stays while it reads; `open` holds the elements not yet ended, with whether they are kept, unwrapped or dropped."""

    def __init__(self, folder: str, known: Collection[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.folder, self.known = folder, known
        self.html: list[str] = []
        self.text: list[str] = []
        self.assets: list[str] = []
        self.ids: list[str] = []
        self.open: list[tuple[str, str]] = []
        self.silent = 0

    def _line(self) -> None:
        if not (self.text and self.text[-1].endswith("\n")):
            self.text.append("\n")

    def _pop(self) -> None:
        tag, mode = self.open.pop()
        if mode == "drop":
            self.silent -= 1
        elif mode == "keep" and not self.silent:
            self.html.append(f"</{tag}>")
            if tag in BLOCKS:
                self._line()

    def _attributes(self, tag: str, attrs: list[tuple[str, str | None]]) -> list[tuple[str, str]]:
        own, out = ATTRIBUTES.get(tag, "").split(), {}
        for name, raw in attrs:
            value = raw or ""
            if name == "id":
                if re.fullmatch(r"[A-Za-z][\w:.-]{0,128}", value, re.ASCII):
                    out.setdefault("id", value)
            elif name == "dir":
                if value in ("ltr", "rtl", "auto"):
                    out.setdefault("dir", value)
            elif tag == "a" and name == "href":
                if target := resolve(value, self.folder, self.known):
                    out |= {"data-rp-href": target, "href": "#"}
                elif re.match(r"(?i)https?://", value):
                    out |= {"href": value, "rel": "noopener noreferrer nofollow", "target": "_blank"}
            elif tag == "img" and name in ("src", "xlink:href"):
                if target := resolve(value, self.folder, self.known):
                    self.assets.append(target)
                    out |= {"src": "asset/" + quote(target, safe="!'()*~"), "loading": "lazy", "decoding": "async"}
            elif name in ("class", "lang", "title") or name in own:
                out.setdefault(name, value[:LONGEST])
        return list(out.items())

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and tag != "br" and self.open and self.open[-1][0] == "p":
            self._pop()
        while self.open and self.open[-1][0] in ENDS.get(tag, ()):
            self._pop()
        mode = "keep" if tag in ALLOWED else "drop" if tag in DROPPED or tag == "head" else "unwrap"
        if mode == "keep" and not self.silent:
            kept = self._attributes(tag, attrs)
            if tag == "img" and "src" not in dict(kept):
                return
            self.ids += [v for k, v in kept if k == "id"]
            self.html.append(f"<{tag}" + "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in kept) + ">")
            if tag in VOID and tag in BLOCKS:
                self._line()
        if tag not in VOID:
            self.open.append((tag, mode))
            self.silent += mode == "drop"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in DROPPED and tag not in VOID:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if any(tag == t for t, _ in self.open):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.html.append(escape(data, quote=False))
            self.text.append(data)

    def finish(self) -> None:
        self.close()
        while self.open:
            self._pop()


def sanitize(html: str | None, chapter: str = "", known: Collection[str] = ()) -> dict:
    """html, text (a line feed where a block ends, never two in a row from that), assets and anchor ids of a chapter; null is as empty.

    `known` are the files of the book. An element that is still open at the end ends there; `<script/>` counts as empty.
    """
    reader = _Cleaner(posixpath.dirname(chapter), known)
    reader.feed(html or "")
    reader.finish()
    return {"html": "".join(reader.html), "text": "".join(reader.text), "assets": reader.assets, "anchor_ids": reader.ids}


def sanitized(df: DataFrame, html: str, chapter: str, known: str) -> DataFrame:
    """df with struct `clean`; columns `chapter` (its file) and `known` (array of the files of the book) go with each row."""

    @F.pandas_udf("html string, text string, assets array<string>, anchor_ids array<string>")
    def run(pages: pd.Series, chapters: pd.Series, files: pd.Series) -> pd.DataFrame:
        rows = [sanitize(h, c or "", set(k) if k is not None else ()) for h, c, k in zip(pages, chapters, files, strict=True)]
        return pd.DataFrame(rows, columns=["html", "text", "assets", "anchor_ids"])

    return df.withColumn("clean", run(html, chapter, known))
