"""Reading postal addresses of one country in their many spellings: components from free text.

Native and romanised order, reversed order, full and half width, numerals in kanji, optional prefixes, missing parts and small
typos are read into postcode, prefecture, municipality, ward, town and numbers. Names of areas come from a gazetteer; towns
are what stands between the area and the numbers.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Old and variant characters and their everyday forms (fixed values).
VARIANTS = str.maketrans("會澤榮邊邉廣國學寶惠靈聖眞德壽龍濱濵髙﨑橫嶋壹貳參瀧莊藏齋齊", "会沢栄辺辺広国学宝恵霊聖真徳寿竜浜浜高崎横島一二三滝荘蔵斎斉")
_DASH = re.compile(r"[‐‑‒–—―−﹣－ｰ]|(?<=\d)ー(?=\d)")
_KANJI = {c: i for i, c in enumerate("〇一二三四五六七八九")}
_KNUM = "〇一二三四五六七八九十百千"
_POST = re.compile(r"〒?\s*(\d{3})-?(\d{4})(?![\d-])")
_NUMBER = re.compile(r"\d+(?:(?:\s?(?:丁目|番地の|番地|番|号|の|之|ノ)\s?-?|-)\d+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_FLOOR = re.compile(r"\b(?:B?\d+F|F\d+|\d+th floor)\b", re.I)


class Address(NamedTuple):
    postcode: str | None
    prefecture: str | None
    municipality: str | None
    ward: str | None
    town: str | None
    numbers: str | None
    latin: bool
    unit: str | None = None


EMPTY = Address(None, None, None, None, None, None, False)
_UNIT = re.compile(r"(?<![\d-])(B?\d{1,4})\s*(?:F\b|階|号室)", re.I)


def fold_name(text: str) -> str:
    """One spelling of a place name: everyday characters, and one form of the connecting particles."""
    text = unicodedata.normalize("NFKC", text).translate(VARIANTS)
    text = re.sub(r"(?<=.)[ヶケがガヵカ](?=[丘谷崎瀬原浜岡沢]|$)", "ヶ", text)
    return re.sub(r"(?<=.)[ノの之]", "の", text)


def numeral(text: str) -> int:
    """The value of a numeral written in kanji."""
    if not any(c in text for c in "十百千"):
        return int("".join(str(_KANJI[c]) for c in text))
    total, digit = 0, 0
    for c in text:
        if c in _KANJI:
            digit = _KANJI[c]
        else:
            total += (digit or 1) * {"十": 10, "百": 100, "千": 1000}[c]
            digit = 0
    return total + digit


_KUNIT = re.compile(rf"([{_KNUM}]+)(?=丁目|番地|番|号)")
_KTAIL = re.compile(rf"(?<=[番地号目])([{_KNUM}]+)(?=号|番|$|\s)")


class Gazetteer:
    """Names of prefectures, municipalities and wards, native and romanised."""

    def __init__(self, rows: list[tuple]) -> None:
        """rows: (code, name, aliases, type, prefectureCode, english)."""
        self.prefecture: dict[str, str] = {}
        self.municipality: dict[str, set[str]] = {}
        self.ward: dict[str, set[str]] = {}
        self.latin_prefecture: dict[str, str] = {}
        self.latin_municipality: dict[str, set[str]] = {}
        self.of: dict[str, str] = {}
        for code, name, aliases, kind, prefecture, english in rows:
            if not (name and code):
                continue
            self.of[code] = prefecture
            key = fold_name(name)
            if kind == "PREFECTURE":
                self.prefecture[key] = code
                if english:
                    self.latin_prefecture[english.lower()] = code
            elif kind == "WARD":
                self.ward.setdefault(key, set()).add(code)
            else:
                self.municipality.setdefault(key, set()).add(code)
                for x in [english, *(a for a in aliases or [] if a and not _CJK.search(a))]:
                    if x:
                        self.latin_municipality.setdefault(_latin_area(x), set()).add(code)
        self.longest = max((len(x) for x in [*self.municipality, *self.prefecture]), default=0)
        self.fuzzy_prefecture = _deletions({k: {v} for k, v in self.prefecture.items()})
        self.fuzzy_municipality = _deletions(self.municipality)
        self.fuzzy_ward = _deletions(self.ward)

    def head(self, text: str, exact: dict, fuzzy: dict, longest: int, suffix: str) -> tuple[set[str], str]:
        """The area a text starts with, and the rest; one character may be missing, doubled, swapped or wrong."""
        for n in range(min(longest, len(text)), 1, -1):
            if (found := exact.get(text[:n])) is not None:
                return {found} if isinstance(found, str) else found, text[n:]
        for n in range(min(longest + 1, len(text) - 1), 1, -1):
            if text[n - 1] in suffix and (found := _lookup(text[:n], fuzzy)):
                return found, text[n:]
        return set(), text


def _latin_area(text: str) -> str:
    return re.sub(r"-(shi|machi|cho|mura|son|ku|gun)$", "", text.strip().lower())


def _deletions(names: dict[str, set[str]]) -> dict[str, set[tuple[str, str]]]:
    out: dict[str, set] = {}
    for name, codes in names.items():
        for form in {name, *(name[:i] + name[i + 1 :] for i in range(len(name)))}:
            if len(form) > 1:
                out.setdefault(form, set()).update((name, c) for c in codes)
    return out


def _lookup(text: str, index: dict) -> set[str]:
    for form in (text, *(text[:i] + text[i + 1 :] for i in range(len(text)))):
        if found := index.get(form):
            near = {c for name, c in found if within_one(name, text)}
            if near:
                return near
    return set()


def within_one(a: str, b: str) -> bool:
    """At most one character inserted, deleted, replaced or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def parse(text: str | None, postcode: str | None, places: Gazetteer) -> Address:
    """The components of an address; what can't be read is None. A postcode in the text goes before the one given."""
    given = re.sub(r"\D", "", unicodedata.normalize("NFKC", postcode or ""))
    given = given if len(given) == 7 else None
    if not text or not text.strip():
        return EMPTY._replace(postcode=given)
    s = _DASH.sub("-", unicodedata.normalize("NFKC", text)).strip()
    s = re.sub(r"^(日本|Japan)\s*[、,]?\s*", "", s)
    found = _POST.search(s)
    while found and not (found.start() == 0 or s[found.start()] == "〒" or s[: found.start()].rstrip().endswith(",")):
        found = _POST.search(s, found.end())
    if found:
        given = found[1] + found[2]
        s = (s[: found.start()] + " " + s[found.end() :]).strip()
    unit = _UNIT.search(s)
    unit = unit[1].upper() if unit else None
    if not _CJK.search(s):
        return _latin(s, given, places)._replace(unit=unit)
    s = s.translate(VARIANTS)
    if re.search(r"[,、]", s):
        parts = [p.strip() for p in re.split(r"[,、]", s) if p.strip()]
        if len(parts) > 1:  # reversed order; a building may hang on to the last part
            last = parts[-1].split(" ")[0]
            rest = places.head(fold_name(last), places.prefecture, places.fuzzy_prefecture, 6, "都道府県")[1]
            if rest == fold_name(last):
                rest = places.head(rest, places.municipality, places.fuzzy_municipality, places.longest, "市町村")[1]
            parts[-1] = last[: len(last) - len(rest)] or last
            s = "".join(reversed(parts[1:])) + parts[0]
    s = re.sub(r"\s+", " ", s)
    s = _KUNIT.sub(lambda m: str(numeral(m[1])), s)
    s = _KTAIL.sub(lambda m: str(numeral(m[1])), s)
    number = _NUMBER.search(s)
    numbers = "-".join(str(int(x)) for x in re.findall(r"\d+", number[0])) if number else None
    area = fold_name(re.sub(r"[\s・]", "", s[: number.start()] if number else re.split(r"\s", s)[0] if not number and " " in s else s))
    prefectures, rest = places.head(area, places.prefecture, places.fuzzy_prefecture, 6, "都道府県")
    prefecture = next(iter(prefectures)) if len(prefectures) == 1 else None
    if not prefecture:  # a prefecture without its suffix before a municipality
        for n in range(min(5, len(area) - 2), 1, -1):
            hit = next((c for name, c in places.prefecture.items() if name[:-1] == area[:n]), None)
            if hit and places.head(area[n:], places.municipality, places.fuzzy_municipality, places.longest, "市町村")[0]:
                prefecture, rest = hit, area[n:]
                break
    whole = rest
    codes, rest = places.head(rest, places.municipality, places.fuzzy_municipality, places.longest, "市町村")
    if number and codes and not rest:  # a town that looks like a municipality
        codes, rest = set(), whole
    if prefecture and codes:
        codes = {c for c in codes if places.of[c] == prefecture} or codes
    municipality = next(iter(codes)) if len(codes) == 1 else None
    if municipality and not prefecture:
        prefecture = places.of[municipality]
    ward = None
    if codes or "区" in rest[:6]:
        wards, after = places.head(rest, places.ward, places.fuzzy_ward, 6, "区")
        if wards:
            own = {w for w in wards if municipality is None or w.startswith(municipality)} or wards
            ward, rest = (next(iter(own)) if len(own) == 1 else None), after
            if ward and not municipality:
                municipality = ward[:6]
                prefecture = prefecture or places.of[ward]
    town = re.sub(r"^(大字|字)", "", rest) or None
    if not number:
        town = None
    return Address(given, prefecture, municipality, ward, town, numbers, False, unit)


def _latin(s: str, postcode: str | None, places: Gazetteer) -> Address:
    parts = [p for x in s.split(",") if (p := _FLOOR.sub("", x).strip()) and p.lower() != "japan"]
    town = numbers = prefecture = None
    codes: set[str] = set()
    for p in parts:
        low = p.lower()
        if re.search(r"\d", p) and town is None and re.search(r"[a-z]", low):
            chome = re.search(r"(\d+)\s*-?chome", low)
            rest = re.sub(r"(\d+)\s*-?chome", " ", low)
            figures = ([chome[1]] if chome else []) + re.findall(r"\d+", rest)
            name = re.sub(r"[^a-z\- ]", " ", re.sub(r"\d[\d\-]*", " ", rest)).strip(" -")
            if name and figures:
                town, numbers = re.sub(r"\s+", " ", name), "-".join(str(int(x)) for x in figures)
        elif low in places.latin_prefecture and (codes or low == parts[-1].lower()):
            prefecture = places.latin_prefecture[low]
        elif hit := places.latin_municipality.get(_latin_area(p)):
            codes = hit
    if prefecture and codes:
        codes = {c for c in codes if places.of[c] == prefecture} or codes
    municipality = next(iter(codes)) if len(codes) == 1 else None
    if municipality and not prefecture:
        prefecture = places.of[municipality]
    return Address(postcode, prefecture, municipality, None, town, numbers, True)


@lru_cache(maxsize=8)
def gazetteer(rows: tuple) -> Gazetteer:
    return Gazetteer(list(rows))
