"""Addresses of pages and social accounts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PARTS = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*)://)?([^/?#\s]*)([^?#\s]*)(\?[^#\s]*)?(#\S*)?\s*$"


def part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, _PARTS, i)


def canonical(c: Column, fragment: bool = False) -> Column:
    """Scheme and host in lower case, path without a trailing slash, query kept, fragment kept on demand."""
    tail = F.regexp_replace(part(c, 3), "/+$", "")
    return F.concat(F.lower(part(c, 1)), F.lit("://"), F.lower(part(c, 2)), tail, part(c, 4), part(c, 5) if fragment else F.lit(""))


def link_fold(c: Column) -> Column:
    """Fold for matching links: lower case, no fragment, query or trailing slash, https."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[?#].*$", ""), "/+$", ""), "^http://", "https://")


def host(c: Column) -> Column:
    return F.regexp_replace(F.lower(part(c, 2)), r"^(?:[^@]*@)|:\d+$", "")


def comparable_site(c: Column) -> Column:
    """Host without www and path without index file or slash; null where there is no host with a dot."""
    h = F.regexp_replace(host(c), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(part(c, 3), r"/(index|default)\.[a-z]+$", ""), "/+$", "")
    return F.when(h.contains("."), F.concat(h, F.lower(path)))


def host_suffixes(c: Column) -> Column:
    """The host and every parent domain of it, for equi-joins with a list of domains."""
    labels = F.split(host(c), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


PLATFORMS = {"youtube": "YOUTUBE", "facebook": "FACEBOOK", "instagram": "INSTAGRAM", "x": "X", "twitter": "X"}


def platform(c: Column) -> Column:
    h = F.regexp_replace(host(c), r"^(www|m|mobile)\.", "")
    out = F.lit(None).cast("string")
    for name, code in PLATFORMS.items():
        out = F.when(h.rlike(rf"^{name}\.[a-z]+$"), code).otherwise(out)
    return out


def handle(c: Column) -> Column:
    """First path element without @, lower case."""
    return F.nullif(F.lower(F.regexp_extract(part(c, 3), r"^/(?:channel/|c/|user/|@)?([^/]+)", 1)), F.lit(""))
