"""Titles, visible text, links and official names from HTML, by the standard parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

HIDDEN = {"script", "style", "noscript", "template"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
ASSETS = re.compile(r"\.(jpe?g|png|gif|webp|svg|ico|css|js|pdf|zip|mp3|mp4|mov|avi|docx?|xlsx?|pptx?)$", re.I)
_SCHEMA = T.StructType([*[T.StructField(n, T.StringType()) for n in ("title", "text", "heading")], T.StructField("links", T.ArrayType(T.StringType()))])


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.heading, self.parts, self.links = "", None, [], []
        self.open: list[str] = []
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag not in VOID:
            self.open.append(tag)
        if tag == "h1":
            self.found.append("")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if HIDDEN & set(self.open):
            return
        if "title" in self.open:
            self.title += data
            return
        if "h1" in self.open and self.found:
            self.found[-1] += data
            if self.heading is None and {"main", "article"} & set(self.open):
                self.heading = len(self.found) - 1
        self.parts.append(data)


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def read(html: str | None) -> tuple[str, str, str | None, list[str]]:
    """(title, visible text, first main heading, link targets as written). Null and blank pages give empty values."""
    page = _Page()
    page.feed(html or "")
    page.close()
    heads = [_squeeze(x) for x in page.found]
    head = heads[page.heading] if page.heading is not None else heads[0] if heads else None
    return _squeeze(page.title), _squeeze(" ".join(page.parts)), head if head and 3 <= len(head) <= 160 else None, page.links


@F.pandas_udf(_SCHEMA)
def parse(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read(x) for x in html], columns=["title", "text", "heading", "links"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def same_host_links(base: pd.Series, links: pd.Series) -> pd.Series:
    """Absolute links to the page's own host, without fragments and assets, each once in order."""

    def one(url, targets):
        out: dict[str, None] = {}
        host = urlsplit(url or "").hostname
        for t in targets if targets is not None else ():
            try:
                full = urldefrag(urljoin(url, t)).url
                parts = urlsplit(full)
            except ValueError:
                continue
            if parts.scheme in ("http", "https") and parts.hostname == host and not ASSETS.search(parts.path):
                out[full] = None
        return list(out)

    return pd.Series([one(u, t) for u, t in zip(base, links)])


def allowed(url: Column, disallowed: Column) -> Column:
    """Is the path free of every disallowed prefix?"""
    path = F.concat(F.lit("/"), F.regexp_extract(url, r"^[a-zA-Z]+://[^/]*/?(.*)$", 1))
    return ~F.exists(disallowed, lambda p: (p != "") & path.startswith(p))
