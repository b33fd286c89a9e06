"""Finding the place a query means: candidates, longest match first, intent, and the rest of the text."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

NATIONWIDE = {"日本", "日本国", "japan", "일본", "japão", "japao", "jepang"}
SUFFIXES = "都道府県市区町村"
MOST = 200_000


class Place(NamedTuple):
    code: str
    name: str
    aliases: tuple[str, ...]
    kind: str
    latitude: float | None
    longitude: float | None
    radius_km: float | None
    translations: dict[str, str]


class Resolved(NamedTuple):
    remainder: str
    place: Place | None
    reason: str
    explicit: bool


def fold(text: str) -> str:
    text = "".join(" " if c == "　" else chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c.lower() for c in text.strip())
    return re.sub(r"\s+", " ", text)


def load(geonames: DataFrame) -> list[Place]:
    """The gazetteer on the driver; it is a fixed list of areas, more than MOST are refused."""
    rows = geonames.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} areas")
    return [Place(r["code"], r["name"], tuple(r["aliases"] or ()), r["type"], r["center"] and r["center"]["latitude"], r["center"] and r["center"]["longitude"], r["coveringRadiusKm"], {k: v for k, v in (r["translations"] or {}).items() if v}) for r in rows if r["name"]]


def _names(p: Place, language: str) -> set[str]:
    names = {p.name, p.name.rstrip(SUFFIXES) if p.name[-1:] in SUFFIXES else p.name, *p.aliases}
    if language != "ja" and p.translations.get(language):
        names.add(p.translations[language])
    return {f for n in names if len(f := fold(n)) >= 2}


def resolve(query: str, places: list[Place], language: str = "ja", point: tuple[float, float] | None = None) -> Resolved:
    """The one place a query names, if any, and the text that remains.

    Longer names win over names they contain. An explicit prefecture goes before municipalities and wards, those before
    prefectures; of several the nearest to the user counts, and without a user's place none does.
    """
    text = fold(query)
    found = []
    for p in places:
        if NATIONWIDE & {fold(n) for n in (p.name, *p.aliases, *p.translations.values())}:
            continue
        for n in _names(p, language):
            if n in text:
                found.append((n, p, p.kind == "PREFECTURE" and n == fold(p.name), n[-1] in SUFFIXES + "郡"))
    found.sort(key=lambda x: (-len(x[0]), x[1].code))
    accepted: list[str] = []
    for n, *_ in found:
        if n not in accepted and not any(n in a or a in n for a in accepted):
            accepted.append(n)
    kept = [x for x in found if x[0] in accepted]
    explicit = [x for x in kept if x[2]]
    local = [x for x in kept if x[1].kind != "PREFECTURE"]
    meant = list({x[1].code: x for x in reversed(explicit or local or kept)}.values())
    chosen = meant[0] if len(meant) == 1 else min(meant, key=lambda x: (_km(point, x[1]), x[1].code)) if meant and point else None
    rest = text
    for n in sorted(accepted, key=len, reverse=True):
        rest = rest.replace(n, " ")
    rest = re.sub(r"\s+", " ", rest).strip()
    if chosen is None:
        return Resolved(rest, None, "ambiguous" if meant else "none", False)
    reason = "explicit-prefecture" if chosen in explicit else "nearest" if len(meant) > 1 else "unique-prefecture" if chosen[1].kind == "PREFECTURE" else "unique-municipality"
    return Resolved(rest, chosen[1], reason, chosen[3])


def _km(point: tuple[float, float], p: Place) -> float:
    from math import asin, cos, radians, sin, sqrt

    if p.latitude is None or p.longitude is None:
        return float("inf")
    a, b = map(radians, point)
    c, d = radians(p.latitude), radians(p.longitude)
    return 2 * 6371.0088 * asin(min(1.0, sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2)))


def nearest_area(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(key, code, distance_km): the nearest area centre of each point, ties by code.

    areas is the gazetteer, a fixed small list checked against MOST before it is broadcast; each point keeps one row, by a
    running minimum within its own task.
    """
    from parvis.operators.spatial import haversine_km

    if areas.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} areas")
    centres = areas.select(F.collect_list(F.struct("code", F.col("center.latitude").alias("lat"), F.col("center.longitude").alias("lon"))).alias("areas"))
    far = F.transform("areas", lambda a: F.struct(F.round(haversine_km(F.col("latitude"), F.col("longitude"), a["lat"], a["lon"]), 9).alias("km"), a["code"].alias("code")))
    return points.crossJoin(F.broadcast(centres)).select("key", F.array_min(far).alias("n")).select("key", "n.code", F.col("n.km").alias("distance_km"))


def strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
