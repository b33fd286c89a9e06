"""Tiered full-text search: analysis, postings, BM25 and the merge of tiers.

The index is a table of postings (field, term, doc, tf) that can be written partitioned by language. A query is planned on the
driver from its few tokens; everything that touches documents is a join on terms.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

CJK = "[\\u3040-\\u30FF\\u3400-\\u9FFF\\uAC00-\\uD7AF]"
K1, B = 1.2, 0.75

# Words that every name of the catalog may have; they don't tell documents apart (fixed values).
GENERIC = {"ja": ("教会", "チャペル"), "en": ("church", "churches", "chapel"), "ko": ("교회", "채플"), "pt": ("igreja", "igrejas", "capela"), "id": ("gereja", "kapel"), "vi": ("nhà thờ", "hội thánh", "nhà nguyện"), "zh-Hans": ("教会", "礼拜堂"), "zh-Hant": ("教會", "禮拜堂")}
WEIGHTS = {"name": 8.0, "name_local": 9.0, "name_canonical": 7.0, "name_reading": 7.0, "minister": 6.0}


def tokens(c: Column) -> Column:
    """Terms of a text: words of letters and digits, words with East Asian characters as bigrams."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(CJK) & (F.length(w) > 2), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))))


def analyse(text: str) -> list[str]:
    """The same for a query, distinct, in order."""
    out: list[str] = []
    for w in re.split(r"[\W_]+", text.lower()):
        if w:
            out += [w[i : i + 2] for i in range(len(w) - 1)] if re.search("[぀-ヿ㐀-鿿가-힯]", w) and len(w) > 2 else [w]
    return list(dict.fromkeys(out))


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, term, doc, tf, length) of all fields."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in fields])
    long = docs.select(F.col(key).alias("doc"), F.explode(each).alias("x")).select("doc", "x.field", "x.terms").where("terms is not null")
    sized = long.withColumn("length", F.size("terms"))
    return sized.select("doc", "field", "length", F.explode("terms").alias("term")).groupBy("field", "term", "doc", "length").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, documents, mean length), one row per field."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(F.col(f))).alias("length")) for f in fields])
    return docs.select(F.explode(each).alias("x")).where("x.length >= 0").groupBy("x.field").agg(F.count("*").alias("documents"), F.avg("x.length").alias("mean_length"))


def bm25(posted: DataFrame, stats: DataFrame, terms: list[str], weights: dict[str, float], *, need_all: bool = True) -> DataFrame:
    """(doc, score): documents with all terms, each in any of the fields; weighted BM25 sums.

    Only postings of the query's terms are read; their document frequencies are aggregated in the same pass.
    """
    mine = posted.where(F.col("term").isin(terms) & F.col("field").isin(list(weights)))
    df = mine.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.lit(0.0)
    for f, w in weights.items():
        boost = F.when(F.col("field") == f, w).otherwise(boost)
    idf = F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = mine.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field").groupBy("doc").agg(F.sum(score).alias("score"), F.countDistinct("term").alias("found"))
    return (scored.where(F.col("found") == len(terms)) if need_all else scored).select("doc", "score")


def exact_key(text: str) -> str:
    """The exact-name key of a query, as functions.text.exact_key gives it for rows."""
    plain = re.sub(r"\s+", " ", text.strip(" \t\r\n\x0b\x0c　\xa0").lower(), flags=re.ASCII)
    return re.sub(r"\s+", "", plain, flags=re.ASCII) if re.search("[぀-ヿ㐀-鿿]", plain) else plain


@dataclass
class Request:
    """A search request; offset and limit as the service bounds them."""

    query: str
    language: str = "ja"
    offset: int = 0
    limit: int = 20
    title_languages: tuple[str, ...] = ()
    area_code: str | None = None
    explicit_area: bool = False
    remainder: str | None = None
    point: tuple[float, float] | None = None
    radius_km: float = 50.0
    timings: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.offset < 0 or not 1 <= self.limit <= 100:
            raise ValueError("offset must be at least 0 and limit within 1..100")


def generic_tokens(language: str) -> set[str]:
    return {t for w in GENERIC.get(language, ()) for t in analyse(w)}


def plan(request: Request) -> dict:
    """What each tier will do, for display and for execution."""
    full, generic = analyse(request.query), generic_tokens(request.language)
    rest = analyse(request.remainder) if request.remainder is not None else full
    located = request.area_code is not None or request.point is not None
    telling = [t for t in full if t not in generic]
    names = bool(telling) and (not located or request.point is not None or any(t not in generic for t in rest))
    only_place = request.area_code is not None and not (request.remainder or "").strip()
    text = [] if only_place else (rest if request.area_code is not None else full)
    return {"tokens": full, "tier2": full if names else None, "tier3": [t for t in text if t not in generic], "area": request.area_code, "area_on_names": request.area_code is not None and (request.explicit_area or only_place)}


def run(docs: DataFrame, posted: DataFrame, stats: DataFrame, request: Request, *, content: bool = False) -> DataFrame:
    """(doc, score, tier, distance_km): the merged tiers in order, one row per document, paged.

    docs: doc, name_exact, latitude, longitude, title_languages, area_codes. Tier 1 is the exact name (1e6), tier 2 all tokens
    in name fields (1e3), tier 3 the remaining tokens in the compact field; a document's scores add up. With a point, exact
    names anywhere come first, then what lies within the radius by distance. ``content`` adds tier 4 for Japanese queries when
    the first three give too few.
    """
    from parvis.operators.spatial import haversine_km

    p = plan(request)
    base = docs
    if request.title_languages:
        base = base.where(F.arrays_overlap("title_languages", F.array(*map(F.lit, request.title_languages))))
    km = haversine_km(F.lit(request.point[0]), F.lit(request.point[1]), F.col("latitude"), F.col("longitude")) if request.point else F.lit(None).cast("double")
    base = base.withColumn("distance_km", km)
    placed = base
    if p["area"] is not None:
        placed = base.where(F.array_contains("area_codes", p["area"]))
    elif request.point:
        reach = math.degrees(request.radius_km / 6371.0088)
        placed = base.where(F.col("latitude").between(request.point[0] - reach, request.point[0] + reach)).where(F.col("distance_km") <= request.radius_km)
    key = exact_key(request.query)
    named = placed if p["area_on_names"] else base
    tier1 = named.where(F.col("name_exact") == key).select("doc", F.lit(100.0 * 1_000_000).alias("score"), F.lit(1).alias("tier"), "distance_km")
    parts = [tier1]
    if p["tier2"]:
        pool = placed if (request.point or p["area_on_names"]) else base
        parts.append(bm25(posted, stats, p["tier2"], WEIGHTS).join(pool.select("doc", "distance_km"), "doc").select("doc", (F.col("score") * 1000).alias("score"), F.lit(2).alias("tier"), "distance_km"))
    pool = placed if (request.point or p["area"] is not None) else base
    if p["tier3"]:
        parts.append(bm25(posted, stats, p["tier3"], {"compact": 1.0}).join(pool.select("doc", "distance_km"), "doc").select("doc", "score", F.lit(3).alias("tier"), "distance_km"))
    else:
        parts.append(pool.select("doc", F.lit(1.0).alias("score"), F.lit(3).alias("tier"), "distance_km"))
    if content and request.language == "ja" and p["tier3"]:
        so_far = parts[0].select("doc")
        for x in parts[1:]:
            so_far = so_far.unionByName(x.select("doc"))
        if so_far.distinct().limit(request.offset + request.limit).count() < request.offset + request.limit:
            parts.append(bm25(posted, stats, p["tier3"], {"content": 1.0}).join(pool.select("doc", "distance_km"), "doc").select("doc", "score", F.lit(4).alias("tier"), "distance_km"))
    merged = parts[0]
    for x in parts[1:]:
        merged = merged.unionByName(x)
    merged = merged.groupBy("doc").agg(F.sum("score").alias("score"), F.min("tier").alias("tier"), F.first("distance_km").alias("distance_km"))
    if request.point:
        order = [F.when(F.col("tier") == 1, 0).otherwise(1), F.when(F.col("tier") == 1, -F.col("score")).otherwise(F.col("distance_km")), F.col("doc")]
    else:
        order = [F.col("score").desc(), F.col("doc")]
    return merged.orderBy(*order).offset(request.offset).limit(request.limit)
