"""Queries that group, rank, sort and compare."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from parvis.functions import address, url as U
from parvis.operators import dedupe, graph, incremental, integrity, spatial
from parvis.operators.resolve import cascade
from parvis.plans.registry import oracle, query
from parvis.session import table
from parvis.streaming import events as stream

NOW = "2026-06-30 00:00:00"
_STAMP = r"^\d{4}-\d{2}-\d{2}"


def _time(c: str):
    return F.when(F.col(c).rlike(_STAMP), F.try_to_timestamp(c))


_SQL_TIME = "CASE WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast({0} AS TIMESTAMPTZ) END"


@query
def category_counts(spark, d):
    return table(spark, d, "churches").groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("churches"), F.count_if(F.col("websiteUrl").isNotNull()).alias("with_site"), F.countDistinct("id").alias("ids"))


oracle("category_counts", "SELECT coalesce(category, 'none') AS category, count(*) AS churches, count(*) FILTER (websiteUrl IS NOT NULL) AS with_site, count(DISTINCT id) AS ids FROM churches GROUP BY 1")


@query
def saved_list_counts(spark, d):
    return table(spark, d, "place_candidates").select(F.explode("sourceLists").alias("list")).groupBy(F.trim("list").alias("list")).agg(F.count("*").alias("places"))


oracle("saved_list_counts", "SELECT trim(l) AS list, count(*) AS places FROM (SELECT unnest(sourceLists) AS l FROM place_candidates) GROUP BY 1")


@query
def graph_counts(spark, d):
    """Nodes per label and edges per type of the catalog graph."""
    ch, pg = table(spark, d, "churches"), table(spark, d, "church_pages")
    n = graph.nodes(ch, F.col("id"), "Church").unionByName(graph.nodes(ch, F.col("denominationId"), "Denomination")).unionByName(graph.nodes(pg, F.col("url"), "Page"))
    e = graph.edges(ch, F.col("id"), F.col("denominationId"), "BELONGS_TO").unionByName(graph.edges(pg, F.col("churchId"), F.col("url"), "HAS_PAGE"))
    return graph.counts(n, e)


oracle("graph_counts", """
SELECT 'node' AS kind, 'Church' AS name, count(DISTINCT id) AS n FROM churches UNION ALL SELECT 'node', 'Denomination', count(DISTINCT denominationId) FROM churches UNION ALL SELECT 'node', 'Page', count(DISTINCT url) FROM church_pages
UNION ALL SELECT 'edge', 'BELONGS_TO', count(*) FROM (SELECT DISTINCT id, denominationId FROM churches WHERE id IS NOT NULL AND denominationId IS NOT NULL)
UNION ALL SELECT 'edge', 'HAS_PAGE', count(*) FROM (SELECT DISTINCT churchId, url FROM church_pages WHERE churchId IS NOT NULL AND url IS NOT NULL)""")


@query
def area_centroids(spark, d):
    """Centre and covering radius of the municipalities of each prefecture: farthest centre plus 10 km, at least 15."""
    g = table(spark, d, "geonames").where("type = 'MUNICIPALITY' and center is not null").select("prefectureCode", F.col("center.latitude").alias("la"), F.col("center.longitude").alias("lo"))
    centre = g.groupBy("prefectureCode").agg(F.avg("la").alias("cla"), F.avg("lo").alias("clo"))
    far = g.join(centre, "prefectureCode").groupBy("prefectureCode").agg(F.first("cla").alias("latitude"), F.first("clo").alias("longitude"), F.max(spatial.haversine_km(F.col("cla"), F.col("clo"), F.col("la"), F.col("lo"))).alias("far"))
    return far.select("prefectureCode", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round(F.greatest(F.lit(15.0), F.col("far") + 10), 4).alias("radius_km"))


def _hav(a, b, c, e):
    return f"2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))))"


oracle("area_centroids", f"""
WITH g AS (SELECT prefectureCode, center.latitude AS la, center.longitude AS lo FROM geonames WHERE type = 'MUNICIPALITY' AND center IS NOT NULL), c AS (SELECT prefectureCode, avg(la) AS cla, avg(lo) AS clo FROM g GROUP BY 1)
SELECT prefectureCode, round(any_value(cla), 6) AS latitude, round(any_value(clo), 6) AS longitude, round(greatest(15.0, max({_hav('cla', 'clo', 'la', 'lo')}) + 10), 4) AS radius_km FROM g JOIN c USING (prefectureCode) GROUP BY 1""")


@query
def merged_places(spark, d):
    """One row per map id: united lists, first latin name by row."""
    p = table(spark, d, "place_candidates").where("googleCid is not null")
    m = dedupe.merge_duplicates(p, ["googleCid"], union=["sourceLists"], first=[("latinName", F.col("latinName"))], order=F.col("place_row_id"))
    return m.select("googleCid", F.array_join("sourceLists", "|").alias("lists"), "latinName")


oracle("merged_places", """
SELECT googleCid, coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT unnest(flatten(list(sourceLists))) AS v)), '') AS lists, arg_min(latinName, place_row_id) FILTER (latinName IS NOT NULL) AS latinName FROM place_candidates WHERE googleCid IS NOT NULL GROUP BY 1""".replace("coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT unnest(flatten(list(sourceLists))) AS v)), '')", "array_to_string(list_sort(list_distinct(flatten(list(sourceLists)))), '|')"))


@query
def merged_exact_entities(spark, d):
    """Records of one name and address: least map id, first web site that is no map."""
    p = table(spark, d, "place_candidates").withColumn("n", F.lower(F.regexp_replace("name", r"[\s　]+", ""))).withColumn("a", F.lower(F.regexp_replace("address", r"[\s　]+", "")))
    site = F.when(F.col("websiteUrl").rlike("^https?://") & ~F.col("websiteUrl").contains("maps."), F.col("websiteUrl"))
    return p.groupBy("n", "a").agg(F.min("googleCid").alias("googleCid"), F.min_by(site, F.when(site.isNotNull(), F.col("place_row_id"))).alias("site"), F.count("*").alias("rows")).where("rows > 1")


oracle("merged_exact_entities", r"""
SELECT lower(regexp_replace(name, '[\s　]+', '', 'g')) AS n, lower(regexp_replace(address, '[\s　]+', '', 'g')) AS a, min(googleCid) AS googleCid,
 arg_min(websiteUrl, place_row_id) FILTER (regexp_matches(websiteUrl, '^https?://') AND NOT contains(websiteUrl, 'maps.')) AS site, count(*) AS rows FROM place_candidates GROUP BY 1, 2 HAVING count(*) > 1""")


@query
def unique_denominations(spark, d):
    """Denomination of each church id that has exactly one."""
    return dedupe.unique_gate(table(spark, d, "churches").where("denominationId is not null"), ["id"], "denominationId")


oracle("unique_denominations", "SELECT id, min(denominationId) AS denominationId FROM churches WHERE denominationId IS NOT NULL GROUP BY id HAVING count(DISTINCT denominationId) = 1")


@query
def first_records(spark, d):
    """First record of each church id."""
    return dedupe.keep_first(table(spark, d, "churches").select("id", "church_row_id", "name"), ["id"], [F.col("church_row_id")])


oracle("first_records", "SELECT id, min(church_row_id) AS church_row_id, arg_min(name, church_row_id) AS name FROM churches GROUP BY id")


@query
def names_by_language(spark, d):
    """Least name of each title language."""
    t = table(spark, d, "churches").select(F.explode("titleLanguages").alias("language"), "name").where("language in ('ja', 'en', 'ko', 'pt', 'zh-Hans', 'zh-Hant', 'vi', 'id')")
    return t.groupBy("language").agg(F.min("name").alias("name"))


oracle("names_by_language", "SELECT language, min(name) AS name FROM (SELECT unnest(titleLanguages) AS language, name FROM churches) WHERE language IN ('ja','en','ko','pt','zh-Hans','zh-Hant','vi','id') GROUP BY 1")


@query
def pages_per_church(spark, d):
    """The newest three page ids of each church, as one ordered text, and the number of pages."""
    p = table(spark, d, "church_pages")
    top = dedupe.top_per_group(p.select("churchId", "page_id", "ingested_at"), ["churchId"], [F.col("ingested_at").desc(), F.col("page_id")], 3)
    newest = top.groupBy("churchId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda x: x["page_id"].cast("string")), ",").alias("newest"))
    return p.groupBy("churchId").agg(F.count("*").alias("pages")).join(newest, "churchId")


oracle("pages_per_church", """
WITH r AS (SELECT churchId, page_id, row_number() OVER (PARTITION BY churchId ORDER BY ingested_at DESC, page_id) AS k, count(*) OVER (PARTITION BY churchId) AS pages FROM church_pages WHERE churchId IS NOT NULL)
SELECT churchId, any_value(pages) AS pages, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY k) AS newest FROM r WHERE k <= 3 GROUP BY 1""")


@query
def repeated_church_ids(spark, d):
    r = dedupe.duplicates(table(spark, d, "churches"), ["id"], "church_row_id")
    return r.select("id", "copies", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


oracle("repeated_church_ids", "SELECT id, count(*) AS copies, array_to_string(list_slice(list_sort(list(church_row_id)), 1, 20), ',') AS sample FROM churches GROUP BY id HAVING count(*) > 1")


@query
def coverage_ratio(spark, d):
    """Share of churches that have pages."""
    ch = table(spark, d, "churches").select("id").distinct()
    has = table(spark, d, "church_pages").select(F.col("churchId").alias("id")).distinct().withColumn("hit", F.lit(1))
    return ch.join(has, "id", "left").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("matched"), F.count("*").alias("all"), F.round(F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0)), 6).alias("coverage"))


oracle("coverage_ratio", """
SELECT CAST(count(p.id) AS BIGINT) AS matched, count(*) AS all, round(coalesce(count(p.id) / count(*), 1.0), 6) AS coverage FROM (SELECT DISTINCT id FROM churches) c LEFT JOIN (SELECT DISTINCT churchId AS id FROM church_pages) p USING (id)""")


@query
def token_frequency(spark, d):
    """How often each word stands in all documents, by falling frequency."""
    t = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("token")).where("token != ''")
    return t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token")


oracle("token_frequency", r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS token FROM documents) WHERE token != '' GROUP BY 1 ORDER BY 2 DESC, 1")


@query
def host_totals(spark, d):
    """The 20 hosts with the most content."""
    p = table(spark, d, "church_pages").withColumn("host", U.host(F.col("url")))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("characters"), F.count_if(F.col("status") != 200).alias("failed")).orderBy(F.col("characters").desc(), "host").limit(20)


oracle("host_totals", r"""SELECT regexp_extract(lower(url), '^\s*[a-z]+://([^/?#:\s]*)', 1) AS host, count(*) AS pages, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS characters, count(*) FILTER (status != 200) AS failed FROM church_pages GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20""")


@query
def translation_coverage(spark, d):
    """Translated and missing area names per language."""
    languages = spark.createDataFrame([(x,) for x in ("en", "ko", "pt", "zh-Hans", "zh-Hant")], "language string")
    g = table(spark, d, "geonames").select("code", "translations").crossJoin(F.broadcast(languages))
    has = F.coalesce(F.element_at("translations", F.col("language")), F.lit("")) != ""
    return g.groupBy("language").agg(F.count_if(has).alias("translated"), F.count_if(~has).alias("missing"))


oracle("translation_coverage", """
WITH l AS (SELECT unnest(['en','ko','pt','zh-Hans','zh-Hant']) AS language), x AS (SELECT language, coalesce(translations[language], '') != '' AS has FROM geonames, l)
SELECT language, count(*) FILTER (has) AS translated, count(*) FILTER (NOT has) AS missing FROM x GROUP BY 1""")


@query
def catalog_hash(spark, d):
    """Order-independent hash of the churches, and the number of rows."""
    return dedupe.content_hash(table(spark, d, "churches"), [F.col(c) for c in ("church_row_id", "id", "name", "englishName", "denominationId", "address")])


oracle("catalog_hash", """
WITH h AS (SELECT sha256(to_json({'church_row_id': church_row_id, 'id': id, 'name': name, 'englishName': englishName, 'denominationId': denominationId, 'address': address})) AS h FROM churches),
b AS (SELECT substring(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS s, count(*) AS n FROM h GROUP BY 1)
SELECT sha256(string_agg(s, '' ORDER BY b)) AS hash, CAST(sum(n) AS BIGINT) AS rows FROM b""")


@query
def source_row_gates(spark, d):
    """Document sources with fewer rows than the least expected."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("rows")).withColumn("least", F.when(F.col("source").rlike("^[a-m]"), 50).otherwise(20)).withColumn("passed", F.col("rows") >= F.col("least"))


oracle("source_row_gates", "SELECT source, count(*) AS rows, CAST(CASE WHEN regexp_matches(source, '^[a-m]') THEN 50 ELSE 20 END AS INT) AS least, count(*) >= CASE WHEN regexp_matches(source, '^[a-m]') THEN 50 ELSE 20 END AS passed FROM documents GROUP BY source")


@query
def winner_margin(spark, d):
    """Best supplier of each part by quantity, where it leads by at least five."""
    q = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    return dedupe.winner_margin(q, ["l_partkey"], "quantity", ["l_suppkey"], 5.0).select("l_partkey", "l_suppkey", "quantity", "runner_up")


oracle("winner_margin", """
WITH q AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY quantity DESC, l_suppkey) AS r FROM q)
SELECT a.l_partkey, a.l_suppkey, a.quantity, b.quantity AS runner_up FROM w a LEFT JOIN w b ON a.l_partkey = b.l_partkey AND b.r = 2 WHERE a.r = 1 AND (b.quantity IS NULL OR a.quantity - b.quantity >= 5)""")


@query
def top_orders_per_customer(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedupe.top_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


oracle("top_orders_per_customer", "SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INT) AS rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")


@query
def crawl_turns(spark, d):
    """Order in which hosts take turns: one page of each, then the next of each."""
    p = table(spark, d, "church_pages").select("page_id", U.host(F.col("url")).alias("host"))
    return dedupe.round_robin(p, "host", [F.col("page_id")]).select("page_id", "host", "turn")


oracle("crawl_turns", r"SELECT page_id, host, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id) AS INT) AS turn FROM (SELECT page_id, regexp_extract(lower(url), '^\s*[a-z]+://([^/?#:\s]*)', 1) AS host FROM church_pages)")


@query
def latest_fetch(spark, d):
    """Latest fetch of each url; unreadable times last."""
    p = table(spark, d, "church_pages").select("url", "page_id", "status", _time("fetchedAt").alias("at"))
    best = p.groupBy("url").agg(F.max_by(F.struct("page_id", "status"), F.struct(F.col("at").isNotNull(), "at", "page_id")).alias("b"))
    return best.select("url", "b.page_id", "b.status")


oracle("latest_fetch", f"""
SELECT url, page_id, status FROM (SELECT url, page_id, status, row_number() OVER (PARTITION BY url ORDER BY t IS NULL, t DESC, page_id DESC) AS k FROM (SELECT *, {_SQL_TIME.format('fetchedAt')} AS t FROM church_pages)) WHERE k = 1""")


@query
def link_priority(spark, d):
    """Links of each page, those to about and access pages first, then by url, at most 100."""
    p = table(spark, d, "church_pages").where("size(outgoingLinks) > 0")
    rank = lambda u: F.when(u.rlike("about|access"), 0).otherwise(1)
    ordered = F.slice(F.transform(F.array_sort(F.transform(F.array_distinct("outgoingLinks"), lambda u: F.struct(rank(u).alias("r"), u.alias("u")))), lambda x: x["u"]), 1, 100)
    return p.select("page_id", F.array_join(ordered, " ").alias("links"))


oracle("link_priority", """
WITH l AS (SELECT page_id, unnest(list_distinct(outgoingLinks)) AS u FROM church_pages), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN regexp_matches(u, 'about|access') THEN 0 ELSE 1 END, u) AS k FROM l)
SELECT page_id, string_agg(u, ' ' ORDER BY k) AS links FROM r WHERE k <= 100 GROUP BY 1""")


@query
def page_priority(spark, d):
    """Pages by kind: start page, about pages ('about' tested first), others."""
    u = F.col("url")
    kind = F.when(u.contains("about"), 1).when(u.rlike(r"^https?://[^/]+/?(index\.html)?$"), 0).otherwise(2)
    return table(spark, d, "church_pages").groupBy("churchId", kind.alias("priority")).agg(F.count("*").alias("pages"))


oracle("page_priority", r"SELECT churchId, CAST(CASE WHEN contains(url, 'about') THEN 1 WHEN regexp_matches(url, '^https?://[^/]+/?(index\.html)?$') THEN 0 ELSE 2 END AS INT) AS priority, count(*) AS pages FROM church_pages GROUP BY 1, 2")


@query
def paged_listing(spark, d):
    """Third page of the churches by name, 25 a page."""
    return table(spark, d, "churches").select("name", "church_row_id").orderBy("name", "church_row_id").offset(50).limit(25)


oracle("paged_listing", "SELECT name, church_row_id FROM churches ORDER BY name, church_row_id LIMIT 25 OFFSET 50")


@query
def catalog_diff(spark, d):
    """Orders against a later version: some removed, some added, some with another price."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 97 != 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    old = o.where("o_orderkey % 101 != 0")
    return graph.diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


oracle("catalog_diff", """
WITH n AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 97 != 0), o AS (SELECT * FROM orders WHERE o_orderkey % 101 != 0)
SELECT * FROM (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra' WHEN o.o_totalprice IS DISTINCT FROM n.o_totalprice OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'changed' END AS change,
 CASE WHEN n.o_orderkey IS NOT NULL AND o.o_orderkey IS NOT NULL AND o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'o_totalprice' ELSE '' END AS fields FROM o FULL JOIN n USING (o_orderkey)) WHERE change IS NOT NULL""")


@query
def replaced_slice(spark, d):
    """Documents with the rows of one source replaced by fresh ones."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    one = docs.agg(F.max("source").alias("source"))
    fresh = docs.join(F.broadcast(one), "source", "left_semi").withColumn("n_chars", F.lit(0).cast("bigint"))
    return graph.replace_slice(docs, fresh, source="source").groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


oracle("replaced_slice", "SELECT source, count(*) AS rows, CAST(sum(CASE WHEN source = (SELECT max(source) FROM documents) THEN 0 ELSE n_chars END) AS BIGINT) AS chars FROM documents GROUP BY source")


@query
def united_accounts(spark, d):
    """Accounts of all exports, each platform and url once, earlier exports first."""
    a = table(spark, d, "social_accounts").select("account_row_id", "platform", "url").where("trim(url) != ''")
    return dedupe.keep_first(a, ["platform", "url"], [F.col("account_row_id")])


oracle("united_accounts", "SELECT platform, url, min(account_row_id) AS account_row_id FROM social_accounts WHERE trim(url) != '' GROUP BY 1, 2")


@query
def upserted_churches(spark, d):
    """Churches of the first record with the latest non-null site and category over them."""
    c = table(spark, d, "churches").select("id", "church_row_id", "websiteUrl", "category")
    old = dedupe.keep_first(c, ["id"], [F.col("church_row_id")]).select("id", "websiteUrl", "category")
    new = dedupe.keep_first(c, ["id"], [-F.col("church_row_id")]).select("id", "websiteUrl", "category")
    return graph.upsert(old, new, "id")


oracle("upserted_churches", "SELECT id, coalesce(arg_max_null(websiteUrl, church_row_id), arg_min_null(websiteUrl, church_row_id)) AS websiteUrl, coalesce(arg_max_null(category, church_row_id), arg_min_null(category, church_row_id)) AS category FROM churches GROUP BY id")


@query
def page_links(spark, d):
    """Links between pages, folded."""
    return graph.link_edges(table(spark, d, "church_pages"), url="url", links="outgoingLinks", fold=U.link_fold)


_FOLD = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[?#].*$', ''), '/+$', ''), '^http://', 'https://')"
oracle("page_links", f"SELECT DISTINCT source, target FROM (SELECT {_FOLD.format('url')} AS source, {_FOLD.format('l')} AS target FROM (SELECT url, unnest(outgoingLinks) AS l FROM church_pages)) WHERE target != '' AND source != target")


@query
def undiscovered_links(spark, d):
    pages = table(spark, d, "church_pages")
    return graph.undiscovered(graph.link_edges(pages, url="url", links="outgoingLinks", fold=U.link_fold), pages, url=U.link_fold(F.col("url")))


oracle("undiscovered_links", f"SELECT DISTINCT {_FOLD.format('l')} AS target FROM (SELECT url, unnest(outgoingLinks) AS l FROM church_pages) WHERE {_FOLD.format('l')} != '' AND {_FOLD.format('l')} != {_FOLD.format('url')} AND {_FOLD.format('l')} NOT IN (SELECT {_FOLD.format('url')} FROM church_pages)")


@query
def orphan_denominations(spark, d):
    n = graph.nodes(table(spark, d, "denominations"), F.col("denominationId"), "Denomination")
    e = graph.edges(table(spark, d, "churches"), F.col("id"), F.col("denominationId"), "BELONGS_TO")
    return graph.orphans(n, e, ["Denomination"]).select("id")


oracle("orphan_denominations", "SELECT denominationId AS id FROM denominations WHERE denominationId NOT IN (SELECT denominationId FROM churches WHERE denominationId IS NOT NULL AND id IS NOT NULL)")


@query
def orphan_areas(spark, d):
    """Municipalities that no address of the directory names."""
    g = table(spark, d, "geonames")
    j = table(spark, d, "jma_churches").where("`住所` is not null").select("jma_row_id", F.regexp_replace("住所", "[ 　]", "").alias("address"))
    where = address.decompose(j, key="jma_row_id", text="address", areas=g).where("municipality_code is not null")
    n = graph.nodes(g.where("type = 'MUNICIPALITY'"), F.col("code"), "Area")
    return graph.orphans(n, graph.edges(where, F.col("key").cast("string"), F.col("municipality_code"), "IN"), ["Area"]).select("id")


oracle("orphan_areas", r"""
WITH j AS (SELECT jma_row_id, regexp_replace(translate(translate(regexp_replace("住所", '[ 　]', '', 'g'), '０１２３４５６７８９', '0123456789'), '−ー―‐‑–—ｰ－', '---------'), '^〒?[0-9]{3}-[0-9]{4}', '') AS t FROM jma_churches WHERE "住所" IS NOT NULL),
p AS (SELECT j.*, g.code AS pc, substring(t, length(g.name) + 1) AS r FROM j JOIN geonames g ON g.type = 'PREFECTURE' AND starts_with(t, g.name)),
m AS (SELECT jma_row_id, arg_max(g.code, length(g.name)) AS mc FROM p JOIN geonames g ON g.type = 'MUNICIPALITY' AND g.prefectureCode = pc AND starts_with(r, g.name) GROUP BY 1)
SELECT code AS id FROM geonames WHERE type = 'MUNICIPALITY' AND code NOT IN (SELECT mc FROM m)""")


@query
def integrity_report(spark, d):
    ch, pl, pg = table(spark, d, "churches"), table(spark, d, "place_candidates"), table(spark, d, "church_pages")
    lat, lon = F.col("location.latitude"), F.col("location.longitude")
    return integrity.report([
        integrity.check("church name blank", ch, F.coalesce(F.trim("name") == "", F.lit(True)), "church_row_id"),
        integrity.check("place out of range", pl, ~lat.between(-90, 90) | ~lon.between(-180, 180), "place_row_id"),
        integrity.check("place at zero", pl, (lat == 0) & (lon == 0), "place_row_id"),
        integrity.check("page failed without error", pg, (F.col("status") != 200) & F.col("error").isNull(), "page_id"),
        integrity.check_unique("church id repeated", ch, ["id"]),
        integrity.check_reference("church of unknown denomination", ch, "denominationId", table(spark, d, "denominations"), "denominationId", "church_row_id"),
        integrity.check_reference("page of unknown church", pg, "churchId", ch, "id", "page_id"),
    ])


def _check_sql(name, key, source):
    return f"SELECT '{name}' AS name, count(*) AS violations, coalesce(array_to_string(list_slice(list_sort(list(CAST({key} AS VARCHAR))), 1, 20), ','), '') AS samples FROM {source}"


oracle("integrity_report", " UNION ALL ".join([
    _check_sql("church name blank", "church_row_id", "churches WHERE coalesce(trim(name) = '', true)"),
    _check_sql("place out of range", "place_row_id", "place_candidates WHERE location.latitude NOT BETWEEN -90 AND 90 OR location.longitude NOT BETWEEN -180 AND 180"),
    _check_sql("place at zero", "place_row_id", "place_candidates WHERE location.latitude = 0 AND location.longitude = 0"),
    _check_sql("page failed without error", "page_id", "church_pages WHERE status != 200 AND error IS NULL"),
    "SELECT 'church id repeated', CAST(coalesce(sum(n - 1), 0) AS BIGINT), coalesce(array_to_string(list_slice(list_sort(list(id)), 1, 20), ','), '') FROM (SELECT id, count(*) AS n FROM churches WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)",
    _check_sql("church of unknown denomination", "church_row_id", "churches WHERE denominationId IS NOT NULL AND denominationId NOT IN (SELECT denominationId FROM denominations)"),
    _check_sql("page of unknown church", "page_id", "church_pages WHERE churchId IS NOT NULL AND churchId NOT IN (SELECT id FROM churches)"),
]))


@query
def dictionary_problems(spark, d):
    """Problems in a dictionary of area names and their first aliases, and of denominations in both directions."""
    g = table(spark, d, "geonames").select(F.col("name").alias("source"), F.get("aliases", F.lit(0)).alias("target")).where("target is not null")
    n = table(spark, d, "denominations").select("name", "englishName")
    both = n.select(F.col("name").alias("source"), F.col("englishName").alias("target")).unionByName(n.select(F.col("englishName").alias("source"), F.concat("name", F.when(F.length("name") > 7, F.lit(" ")).otherwise(F.lit(""))).alias("target")))
    return integrity.validate_dictionary(g.unionByName(both))


oracle("dictionary_problems", """
WITH e AS (SELECT name AS source, aliases[1] AS target FROM geonames WHERE aliases[1] IS NOT NULL UNION ALL SELECT name, englishName FROM denominations UNION ALL SELECT englishName, name || CASE WHEN length(name) > 7 THEN ' ' ELSE '' END FROM denominations)
SELECT source, 'padded' AS problem FROM e WHERE source != trim(source) OR target != trim(target) UNION SELECT source, 'blank' FROM e WHERE trim(source) = '' OR trim(target) = ''
UNION SELECT source, 'repeated' FROM e GROUP BY source HAVING count(*) > 1 UNION SELECT a.source, 'circular' FROM e a JOIN e b ON a.target = b.source AND b.target = a.source""")


@query
def fresh_or_refetch(spark, d):
    """Pages by what a refresh would do: fetched within 30 days before a fixed day, older, from the future, unknown."""
    now = F.lit(NOW).cast("timestamp")
    p = table(spark, d, "church_pages").select("page_id", _time("fetchedAt").alias("at"))
    return p.groupBy(incremental.is_fresh(F.col("at"), now).alias("fresh"), incremental.is_fresh_listing(F.col("at"), now).alias("fresh_listing")).agg(F.count("*").alias("pages"))


oracle("fresh_or_refetch", f"""
WITH p AS (SELECT epoch(TIMESTAMPTZ '{NOW}+00') AS n, epoch({_SQL_TIME.format('fetchedAt')}) AS t FROM church_pages)
SELECT coalesce(n - t >= 0 AND n - t < 2592000, false) AS fresh, coalesce(t >= n - 2592000, false) AS fresh_listing, count(*) AS pages FROM p GROUP BY 1, 2""")


@query
def merged_manifest(spark, d):
    """Manifest of the first fetches, with later fetches of a url over them."""
    p = table(spark, d, "church_pages").select("churchId", "url", "page_id", "status")
    first = dedupe.keep_first(p, ["churchId", "url"], [F.col("page_id")])
    again = dedupe.keep_first(p.join(first.select("page_id"), "page_id", "left_anti"), ["churchId", "url"], [-F.col("page_id")]).select("churchId", "url", "page_id", "status")
    return incremental.merge_manifest(first, again, ["churchId", "url"])


oracle("merged_manifest", "SELECT churchId, url, max(page_id) AS page_id, arg_max(status, page_id) AS status FROM church_pages GROUP BY churchId, url")


@query
def reuse_or_refresh(spark, d):
    """Addresses whose cached reading can be kept: the cache holds the first record of each church."""
    c = table(spark, d, "churches").select("id", "church_row_id", "address")
    cache = dedupe.keep_first(c, ["id"], [F.col("church_row_id")]).select("id", "address", F.when(F.col("church_row_id") % 3 == 0, "v1").otherwise("v2").alias("version"))
    latest = dedupe.keep_first(c, ["id"], [-F.col("church_row_id")]).select("id", "address")
    return incremental.split_reuse(latest, cache, key="id", text="address", version="v2")


oracle("reuse_or_refresh", """
SELECT id, CASE WHEN arg_max_null(address, church_row_id) IS NOT DISTINCT FROM arg_min_null(address, church_row_id) AND min(church_row_id) % 3 != 0 THEN 'reuse' ELSE 'refresh' END AS action FROM churches GROUP BY id""")


@query
def content_store(spark, d):
    return incremental.content_store(table(spark, d, "church_pages"), "content")


oracle("content_store", "SELECT sha256(content) AS hash, count(*) AS copies, CAST(max(length(content)) AS INT) AS length FROM church_pages WHERE content IS NOT NULL GROUP BY 1")


@query
def evidence_cascade(spark, d):
    """Denomination of each place from ranked evidence: hint by id, hint by name, name component."""
    p = table(spark, d, "place_candidates").withColumn("h", F.lower(F.trim("denominationHint")))
    dn = table(spark, d, "denominations")
    ids = dn.select(F.col("denominationId").alias("by_id"), F.lower("denominationId").alias("h"))
    names = dn.select(F.col("denominationId").alias("by_name"), F.lower("name").alias("h2"))
    joined = p.join(ids, "h", "left").join(names, p["h"] == F.col("h2"), "left")
    value, confidence, source = cascade([("hint id", F.col("by_id"), F.lit(1.0)), ("hint name", F.col("by_name"), F.lit(0.95)), ("lutheran word", F.when(F.col("name").contains("ルーテル"), F.lit("dn-lanternluth")), F.lit(0.85))])
    return joined.select("place_row_id", value.alias("denominationId"), confidence.alias("confidence"), source.alias("source"))


oracle("evidence_cascade", """
SELECT place_row_id, coalesce(i.denominationId, n.denominationId, CASE WHEN contains(p.name, 'ルーテル') THEN 'dn-lanternluth' END) AS denominationId,
 CASE WHEN i.denominationId IS NOT NULL THEN 1.0 WHEN n.denominationId IS NOT NULL THEN 0.95 WHEN contains(p.name, 'ルーテル') THEN 0.85 END::DOUBLE AS confidence,
 CASE WHEN i.denominationId IS NOT NULL THEN 'hint id' WHEN n.denominationId IS NOT NULL THEN 'hint name' WHEN contains(p.name, 'ルーテル') THEN 'lutheran word' END AS source
FROM place_candidates p LEFT JOIN denominations i ON lower(i.denominationId) = lower(trim(p.denominationHint)) LEFT JOIN denominations n ON lower(n.name) = lower(trim(p.denominationHint))""")


@query
def event_windows(spark, d):
    """Events per hour and kind, by the function that also runs on streams."""
    return stream.windowed(table(spark, d, "events")).select("start", "event_type", "events", F.round("value", 4).alias("value"))


oracle("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")


@query
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


oracle("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")


@query
def running_order_value(spark, d):
    """Each customer's order value so far."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("so_far"))


oracle("running_order_value", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM orders")
