"""Directory pages to rows: one contract for parsers, a table parser, a saved-place page parser, charset detection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

ROW = "name string, address string, phone string, website string, email string, status string"
Parser = Callable[[str, str], Iterable[dict]]


def parse_pages(pages: DataFrame, parser: Parser, *, url: str = "url", html: str = "html") -> DataFrame:
    """(url, position, the fields of ROW, error): the rows a parser yields per page. A page whose parser fails gives one row
    with the error and nothing else; null pages give none."""
    names = [x.split()[0] for x in ROW.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for u, h in zip(b["u"], b["h"]):
                if h is None:
                    continue
                try:
                    out += [(u, i, *(r.get(n) for n in names), None) for i, r in enumerate(parser(u, h))]
                except Exception as e:  # a broken page must not end the job
                    out.append((u, -1, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "position", *names, "error"])

    return pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, f"url string, position int, {ROW}, error string")


def with_details(rows: DataFrame, details: DataFrame) -> DataFrame:
    """List rows with the fields of their detail page where there is one; rows without a detail page stay."""
    d = details.select(F.col("url").alias("website"), F.col("address").alias("d_address"), F.col("phone").alias("d_phone"), F.col("email").alias("d_email")).groupBy("website").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("d_address", "d_phone", "d_email")])
    return rows.join(d, "website", "left").select(*[c for c in rows.columns if c not in ("address", "phone", "email")], *[F.coalesce(F.nullif(c, F.lit("")), f"d_{c}").alias(c) for c in ("address", "phone", "email")])


class _Table(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.links: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.links.append([])
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "a" and self.links and (href := dict(attrs).get("href")):
            self.links[-1].append(href)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_parser(heads: dict[str, tuple[str, ...]]) -> Parser:
    """A parser for HTML tables: columns by the words of the header row, links as website."""

    def parse(url: str, html: str) -> Iterable[dict]:
        t = _Table()
        t.feed(html)
        where: dict[str, int] = {}
        for cells, links in zip(t.rows, t.links):
            found = {f: i for f, words in heads.items() for i, c in enumerate(cells) if c in words}
            if found and not where:
                where = found
            elif where and cells and len(cells) > max(where.values()):
                row = {f: cells[i] for f, i in where.items()}
                if row.get("name"):
                    yield row | ({"website": links[0]} if links and "website" not in row else {})

    return parse


_CID = re.compile(r"[?&]cid=(\d+)|!1s0x[0-9a-f]+:0x([0-9a-f]+)")
_AT = re.compile(r"@(-?\d+\.\d+),(-?\d+\.\d+)|!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)|[?&]ll=(-?\d+\.\d+),(-?\d+\.\d+)")


def place_id(url: Column) -> Column:
    """Map id in a saved place's address: decimal as it stands, hexadecimal as decimal."""
    dec = F.nullif(F.regexp_extract(url, r"[?&]cid=(\d+)", 1), F.lit(""))
    hexa = F.nullif(F.regexp_extract(url, r"!1s0x[0-9a-f]+:0x([0-9a-f]+)", 1), F.lit(""))
    return F.coalesce(dec, F.conv(hexa, 16, 10))


def place_point(url: Column) -> Column:
    """Latitude and longitude in a saved place's address, by the first form that occurs."""
    num = r"(-?\d+\.\d+)"
    forms = [rf"@{num},{num}", rf"!3d{num}!4d{num}", rf"[?&]ll={num},{num}"]
    part = lambda g: F.coalesce(*[F.expr("null").cast("double"), *[F.nullif(F.regexp_extract(url, f, g), F.lit("")).cast("double") for f in forms]])
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("latitude"), part(2).alias("longitude")))


@F.pandas_udf(T.StringType())
def decode_page(raw: pd.Series) -> pd.Series:
    """Text of page bytes: declared charset, then UTF-8, then the usual East Asian ones; undecodable bytes are replaced."""

    def one(b):
        if b is None:
            return None
        b = bytes(b)
        said = re.search(rb"charset=[\"']?([A-Za-z0-9_\-]+)", b[:2048])
        for name in ([said[1].decode("ascii")] if said else []) + ["utf-8", "cp932", "euc-jp"]:
            try:
                return b.decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
        return b.decode("utf-8", "replace")

    return raw.map(one)
