"""Search queries over documents and over the church catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis.functions import address, text as X
from parvis.operators import dedupe, places, search, spatial
from parvis.plans.registry import oracle, query
from parvis.session import cut, table

NAMES = ["name", "name_local", "name_canonical", "name_reading", "minister"]


def church_documents(spark, d):
    """One document per church id: the fields that are searched, the codes of its areas, its place."""
    c = dedupe.keep_first(table(spark, d, "churches"), ["id"], [F.col("church_row_id")])
    dn = table(spark, d, "denominations").select("denominationId", F.concat_ws(" ", "name", "englishName").alias("denomination"))
    geo = table(spark, d, "geonames")
    g = geo.where("type in ('PREFECTURE', 'MUNICIPALITY')").select("code", F.concat_ws(" ", F.map_values("translations")).alias("translated"))
    codes = address.area_codes(c, key="id", text="address", areas=geo).select(F.col("key").alias("id"), F.explode("codes").alias("code"))
    where = codes.join(g, "code").groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("area_codes"), F.concat_ws(" ", F.sort_array(F.collect_set("translated"))).alias("area_names"))
    joined = c.join(dn, "denominationId", "left").join(where, "id", "left")
    return joined.select(
        F.col("id").alias("doc"), "name", F.col("englishName").alias("name_local"), X.to_simplified(F.col("name")).alias("name_canonical"), X.to_hiragana(F.col("name")).alias("name_reading"), F.lit(None).cast("string").alias("minister"),
        X.exact_key(F.col("name")).alias("name_exact"), F.concat_ws(" ", "name", "englishName", "denomination", "area_names", "category", "address").alias("compact"), F.col("titleLanguages").alias("title_languages"),
        F.coalesce("area_codes", F.array().cast("array<string>")).alias("area_codes"), F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"),
    )


def church_index(spark, d, *, content: bool = False):
    """(documents, postings, statistics) of the catalog; the content field holds the words of a church's pages."""
    docs = cut(church_documents(spark, d))
    fields = [*NAMES, "compact"]
    posted, stats = search.postings(docs, "doc", fields), search.statistics(docs, "doc", fields)
    if content:
        p = table(spark, d, "church_pages").select(F.col("churchId").alias("doc"), "content").where("content is not null")
        words = search.postings(p, "doc", ["content"]).groupBy("field", "term", "doc").agg(F.sum("tf").alias("tf"))
        sizes = words.groupBy("doc").agg(F.sum("tf").cast("int").alias("length"))
        posted = posted.unionByName(words.join(sizes, "doc").select("field", "term", "doc", "length", "tf"))
        stats = stats.unionByName(sizes.agg(F.lit("content").alias("field"), F.count("*").alias("documents"), F.avg("length").alias("mean_length")))
    return docs, posted, stats


@query
def bm25_top_docs(spark, d):
    """The 20 best documents with all of the words."""
    docs = table(spark, d, "documents")
    posted, stats = search.postings(docs, "doc_id", ["text"]), search.statistics(docs, "doc_id", ["text"])
    found = search.bm25(posted, stats, ["the", "prayer", "list"], {"text": 1.0})
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(20)


oracle("bm25_top_docs", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x != '') AS ws FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, flatten(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]') AND length(w) > 2 THEN list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) ELSE [w] END)) AS ts FROM w),
s AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM t), e AS (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM t),
p AS (SELECT doc_id, term, l, count(*) AS tf FROM e WHERE term IN ('the','prayer','list') GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM p JOIN f USING (term), s GROUP BY 1 HAVING count(*) = 3 ORDER BY 2 DESC, 1 LIMIT 20""")


@query
def index_terms(spark, d):
    """Terms and postings of the document index."""
    return search.postings(table(spark, d, "documents"), "doc_id", ["text", "title"]).groupBy("field").agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))


oracle("index_terms", r"""
WITH d AS (SELECT doc_id, 'text' AS field, text AS v FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'title', title FROM documents WHERE title IS NOT NULL),
w AS (SELECT doc_id, field, list_filter(regexp_split_to_array(lower(v), '[^\p{L}\p{N}]+'), lambda x: x != '') AS ws FROM d),
e AS (SELECT doc_id, field, unnest(flatten(list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]') AND length(w) > 2 THEN list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) ELSE [w] END))) AS term FROM w),
p AS (SELECT field, term, doc_id, count(*) AS tf FROM e GROUP BY 1, 2, 3)
SELECT field, count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY field""")


@query
def exact_name_search(spark, d):
    """Churches whose exact-name key is that of the most frequent name."""
    docs = church_documents(spark, d)
    top = docs.groupBy("name_exact").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name_exact").limit(1)
    return docs.join(F.broadcast(top), "name_exact").select("doc", "name")


oracle("exact_name_search", r"""
WITH f AS (SELECT id, arg_min(name, church_row_id) AS name FROM churches GROUP BY id), p AS (SELECT *, regexp_replace(lower(regexp_replace(name, '^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$', '', 'g')), '\s+', ' ', 'g') AS q FROM f),
k AS (SELECT id, name, CASE WHEN regexp_matches(q, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]') THEN regexp_replace(q, '\s+', '', 'g') ELSE q END AS key FROM p)
SELECT id AS doc, name FROM k WHERE key = (SELECT key FROM k GROUP BY key ORDER BY count(*) DESC, key LIMIT 1)""")


def _run(spark, d, request, content=False):
    docs, posted, stats = church_index(spark, d, content=content)
    found = search.run(docs, posted, stats, request, content=content)
    return found.select("doc", F.round("score", 4).alias("score"), "tier", F.round("distance_km", 4).alias("distance_km"))


@query
def tiered_search(spark, d):
    """Exact names, then all words in names, then all words anywhere."""
    return _run(spark, d, search.Request("Hikari Church", language="en", limit=50))


@query
def located_search(spark, d):
    """A query that names a town: the town becomes a filter, the rest is searched."""
    areas = places.load(table(spark, d, "geonames"))
    said = places.resolve("南橋市 キリスト", areas)
    return _run(spark, d, search.Request("南橋市 キリスト", area_code=said.place.code if said.place else None, explicit_area=said.explicit, remainder=said.remainder, limit=50))


@query
def device_search(spark, d):
    """Churches within 50 km of a point by distance, exact names anywhere first."""
    return _run(spark, d, search.Request("教会", point=(35.1, 135.0), limit=50))


# the query is a generic word only, so every church within the radius counts, by distance
oracle("device_search", """
WITH c AS (SELECT id, arg_min(location.latitude, church_row_id) AS la, arg_min(location.longitude, church_row_id) AS lo, arg_min({'l': location}, church_row_id).l AS l, arg_min({'n': name}, church_row_id).n AS name FROM churches GROUP BY id),
d AS (SELECT id, 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(l.latitude - 35.1) / 2), 2) + cos(radians(35.1)) * cos(radians(l.latitude)) * pow(sin(radians(l.longitude - 135.0) / 2), 2)))) AS km FROM c WHERE l.latitude IS NOT NULL AND l.longitude IS NOT NULL)
SELECT id AS doc, 1.0::DOUBLE AS score, 3::INT AS tier, round(km, 4) AS distance_km FROM d WHERE km <= 50 ORDER BY km, id LIMIT 50""")


@query
def content_search(spark, d):
    """Words that only pages hold: the fallback tier."""
    return _run(spark, d, search.Request("早天祈祷会 河川敷", limit=20), content=True)


@query
def resolved_places(spark, d):
    """What place a few queries mean."""
    areas = places.load(table(spark, d, "geonames"))
    asked = ["南橋市 教会", "燈洲都の光の教会", "青区 チャペル", "日本 バプテスト", "朝日の丘教会", "東岡 希望"]
    rows = [(q, r.place.code if r.place else None, r.reason, r.remainder) for q in asked for r in [places.resolve(q, areas, point=(35.1, 135.0))]]
    return spark.createDataFrame(rows, "query string, code string, reason string, remainder string")


@query
def nearest_areas(spark, d):
    """Nearest municipality or ward of each church."""
    c = table(spark, d, "churches").where("location is not null and location.latitude is not null and location.longitude is not null").select(F.col("church_row_id").alias("key"), F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"))
    areas = table(spark, d, "geonames").where("type in ('MUNICIPALITY', 'WARD')")
    return places.nearest_area(c, areas).select(F.col("key").alias("church_row_id"), "code", F.round("distance_km", 4).alias("km"))


_H = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
oracle("nearest_areas", f"""
WITH x AS (SELECT church_row_id, code, round({_H.format('c.location.latitude', 'c.location.longitude', 'g.center.latitude', 'g.center.longitude')}, 9) AS km FROM churches c, geonames g WHERE g.type IN ('MUNICIPALITY', 'WARD') AND c.location.latitude IS NOT NULL AND c.location.longitude IS NOT NULL)
SELECT church_row_id, arg_min(code, (km, code)) AS code, round(min(km), 4) AS km FROM x GROUP BY 1""")


@query
def nearby_churches(spark, d):
    """The 30 churches next to a point within 50 km."""
    km = spatial.haversine_km(F.lit(35.1), F.lit(135.0), F.col("location.latitude"), F.col("location.longitude"))
    c = table(spark, d, "churches").where(F.col("location.latitude").between(34.6, 35.6) & F.col("location.longitude").between(134.4, 135.6)).select("church_row_id", km.alias("km"))
    return c.where("km <= 50").select("church_row_id", F.round("km", 6).alias("km")).orderBy("km", "church_row_id").limit(30)


oracle("nearby_churches", f"SELECT church_row_id, round({_H.format('35.1', '135.0', 'location.latitude', 'location.longitude')}, 6) AS km FROM churches WHERE {_H.format('35.1', '135.0', 'location.latitude', 'location.longitude')} <= 50 ORDER BY 2, 1 LIMIT 30")


@query
def map_markers(spark, d):
    """Churches in a box of the map."""
    return table(spark, d, "churches").where(F.col("location.latitude").between(34, 36) & F.col("location.longitude").between(134, 136)).select("id", "name", F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"))


oracle("map_markers", "SELECT id, name, location.latitude AS latitude, location.longitude AS longitude FROM churches WHERE location.latitude BETWEEN 34 AND 36 AND location.longitude BETWEEN 134 AND 136")


@query
def title_language_filter(spark, d):
    return table(spark, d, "place_candidates").where(F.arrays_overlap("titleLanguages", F.array(F.lit("en"), F.lit("ko")))).select("place_row_id", F.array_join("titleLanguages", ",").alias("languages"))


oracle("title_language_filter", "SELECT place_row_id, array_to_string(titleLanguages, ',') AS languages FROM place_candidates WHERE list_has_any(titleLanguages, ['en', 'ko'])")
