"""Queries on text, names, languages and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis.functions import language, similarity, text as X, url as U
from parvis.operators import dedupe
from parvis.plans.registry import oracle, query
from parvis.session import table
from parvis.sources import html


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query
def exact_name_key(spark, d):
    return table(spark, d, "churches").select("church_row_id", X.exact_key(F.col("name")).alias("key"))


oracle("exact_name_key", r"""
SELECT church_row_id, CASE WHEN regexp_matches(p, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]') THEN regexp_replace(p, '\s+', '', 'g') ELSE p END AS key
FROM (SELECT church_row_id, regexp_replace(lower(regexp_replace(name, '^[\s\x{3000}\x{A0}]+|[\s\x{3000}\x{A0}]+$', '', 'g')), '\s+', ' ', 'g') AS p FROM churches)""")


@query
def query_fold(spark, d):
    return table(spark, d, "place_candidates").select("place_row_id", X.query_fold(F.col("address")).alias("folded"))


oracle("query_fold", rf"""
SELECT place_row_id, regexp_replace(lower(translate(regexp_replace(address, '^[\s\x{{3000}}\x{{A0}}]+|[\s\x{{3000}}\x{{A0}}]+$', '', 'g'), '　' || {_quote(X.WIDE)}, ' ' || {_quote(X.NARROW)})), '\s+', ' ', 'g') AS folded FROM place_candidates""")


@query
def kana_reading(spark, d):
    return table(spark, d, "jma_churches").select("jma_row_id", X.to_hiragana(F.col("教会名")).alias("reading"))


oracle("kana_reading", f'SELECT jma_row_id, translate("教会名", {_quote(X.KATAKANA)}, {_quote(X.HIRAGANA)}) AS reading FROM jma_churches')


@query
def simplified_key(spark, d):
    return table(spark, d, "social_accounts").select("account_row_id", X.to_simplified(F.col("accountName")).alias("simplified"), X.to_traditional(F.col("accountName")).alias("traditional"))


oracle("simplified_key", f"""SELECT account_row_id, translate(accountName, {_quote(X.TRADITIONAL + X.SHINJITAI)}, {_quote(X.SIMPLIFIED + X.SHINJITAI_SIMPLE)}) AS simplified,
translate(accountName, {_quote(X.SIMPLIFIED + X.SHINJITAI)}, {_quote(X.TRADITIONAL + '惠澤濱邊廣龍')}) AS traditional FROM social_accounts""")


@query
def language_codes(spark, d):
    return table(spark, d, "documents").groupBy(language.canonical_code(F.col("lang")).alias("code")).agg(F.count("*").alias("documents"))


oracle("language_codes", """
SELECT CASE WHEN l = '' THEN NULL WHEN l IN ('zh','zh-cn','zh-sg','zh-hans','zh-hans-cn') THEN 'zh-Hans' WHEN l IN ('zh-tw','zh-hk','zh-mo','zh-hant','zh-hant-tw') THEN 'zh-Hant'
 WHEN split_part(l, '-', 1) = 'jp' THEN 'ja' ELSE split_part(l, '-', 1) END AS code, count(*) AS documents
FROM (SELECT lower(trim(replace(lang, '_', '-'))) AS l FROM documents) GROUP BY 1""")


@query
def query_language(spark, d):
    return table(spark, d, "social_accounts").select("account_row_id", language.detect_query(F.coalesce("description", F.lit(""))).alias("language"))


def _list(words) -> str:
    return "[" + ", ".join(_quote(w) for w in words) + "]"


oracle("query_language", rf"""
SELECT account_row_id, CASE WHEN regexp_matches(c, '[\x{{1100}}-\x{{11FF}}\x{{3130}}-\x{{318F}}\x{{AC00}}-\x{{D7AF}}]') THEN 'ko'
 WHEN regexp_matches(c, '[\x{{3040}}-\x{{30FF}}]') THEN 'ja' WHEN regexp_matches(c, '[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}]') THEN 'ja'
 WHEN regexp_matches(lower(c), '[ăđơư]') OR len(list_intersect(w, {_list(language.VIETNAMESE)})) >= 2 THEN 'vi'
 WHEN regexp_matches(lower(c), '[ãõáàâéêíóôúç]') OR list_has_any(w, {_list(language.PORTUGUESE)}) THEN 'pt'
 WHEN list_has_any(w, {_list(language.INDONESIAN)}) THEN 'id' WHEN list_has_any(w, {_list(language.ENGLISH)}) THEN 'en' ELSE 'en' END AS language
FROM (SELECT account_row_id, coalesce(description, '') AS c, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(description, '')), '[^\p{{L}}]+'), lambda x: x != '')) AS w FROM social_accounts)""")


@query
def ngram_profile(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.coalesce(language.canonical_code(F.col("lang")), F.lit("und")).alias("code"), "text")
    return language.profiles(docs, language="code", text="text").groupBy("language").agg(F.count("*").alias("grams"), F.sum("freq").alias("freq"))


@query
def ngram_language(spark, d):
    """Language of every document from profiles of all documents with a language."""
    docs = table(spark, d, "documents").where("text is not null")
    profile = language.profiles(docs.select(language.canonical_code(F.col("lang")).alias("code"), "text").where("code is not null"), language="code", text="text")
    return language.classify(docs.select("doc_id", "text"), profile, key="doc_id", text="text").select("doc_id", "language")


@query
def text_chunks(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "piece")).select("doc_id", "chunk", F.length("piece").alias("length"), F.sha2("piece", 256).alias("hash"))


oracle("text_chunks", """
WITH p AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, CASE WHEN trim(text, ' ') = '' THEN 1 WHEN n <= 6000 THEN 1 ELSE least(32, CAST(ceil((n - 6000) / 5500.0) AS INT) + 1) END AS k FROM p),
e AS (SELECT doc_id, unnest(range(CAST(k AS BIGINT))) AS i, CASE WHEN trim(text, ' ') = '' THEN '' ELSE text END AS t FROM c)
SELECT doc_id, CAST(i AS INT) AS chunk, CAST(length(substring(t, i * 5500 + 1, 6000)) AS INT) AS length, sha256(substring(t, i * 5500 + 1, 6000)) AS hash FROM e""")


@query
def page_snippets(spark, d):
    """Pages that contain all of two words, with a snippet around the first."""
    pages = table(spark, d, "church_pages").where("content is not null")
    hay = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "content"))
    hits = pages.where(F.forall(F.array(F.lit("祈り"), F.lit("会堂")), lambda t: F.contains(hay, t)))
    first = dedupe.top_per_group(hits.select("churchId", "page_id", X.snippet(F.col("content"), F.lit("祈り")).alias("snippet")), ["churchId"], [F.col("page_id")], 3)
    return first.select("churchId", "page_id", "snippet")


oracle("page_snippets", r"""
WITH h AS (SELECT churchId, page_id, trim(regexp_replace(content, '\s+', ' ', 'g'), ' ') AS c FROM church_pages WHERE content IS NOT NULL
 AND contains(lower(coalesce(title, '') || chr(10) || content), '祈り') AND contains(lower(coalesce(title, '') || chr(10) || content), '会堂')),
k AS (SELECT *, row_number() OVER (PARTITION BY churchId ORDER BY page_id) AS r, length(c) AS n, greatest(instr(lower(c), '祈り') - 1, 0) AS a FROM h),
s AS (SELECT *, least(greatest(a - 60, 0), n - 180) AS st FROM k WHERE r <= 3)
SELECT churchId, page_id, CASE WHEN n <= 180 THEN c ELSE (CASE WHEN st > 0 THEN '…' ELSE '' END) || substring(c, CAST(st AS INT) + 1, 180) || (CASE WHEN st + 180 < n THEN '…' ELSE '' END) END AS snippet FROM s""")


@query
def url_canonical(spark, d):
    p = table(spark, d, "church_pages")
    u = F.col("finalUrl")
    return p.where("finalUrl is not null").select("page_id", U.canonical(u).alias("canonical"), U.link_fold(u).alias("folded"), U.comparable_site(u).alias("site"))


_P = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*)://)?([^/?#\s]*)([^?#\s]*)(\?[^#\s]*)?(#\S*)?\s*$"
oracle("url_canonical", rf"""
WITH p AS (SELECT page_id, finalUrl AS u, regexp_extract(finalUrl, '{_P}', 1) AS s, lower(regexp_extract(finalUrl, '{_P}', 2)) AS h, regexp_extract(finalUrl, '{_P}', 3) AS t, regexp_extract(finalUrl, '{_P}', 4) AS q FROM church_pages WHERE finalUrl IS NOT NULL)
SELECT page_id, lower(s) || '://' || h || regexp_replace(t, '/+$', '') || q AS canonical,
 regexp_replace(regexp_replace(regexp_replace(lower(trim(u)), '[?#].*$', ''), '/+$', ''), '^http://', 'https://') AS folded,
 CASE WHEN contains(h, '.') THEN regexp_replace(regexp_replace(h, '^(?:[^@]*@)|:\d+$', '', 'g'), '^www\.', '') || lower(regexp_replace(regexp_replace(t, '/(index|default)\.[a-z]+$', ''), '/+$', '')) END AS site FROM p""")


@query
def host_policy(spark, d):
    """Public address of each place: its site where that is no excluded host or a sub-domain of one, else the map entry."""
    excluded = spark.createDataFrame([("google.example",), ("facebook.example",), ("instagram.example",)], "domain string")
    p = table(spark, d, "place_candidates").select("place_row_id", "googleCid", F.trim("websiteUrl").alias("site"))
    bad = p.where("site is not null and site != ''").select("place_row_id", F.explode(U.host_suffixes(F.col("site"))).alias("domain")).join(excluded, "domain", "left_semi").select("place_row_id").distinct().withColumn("bad", F.lit(True))
    fallback = F.when(F.col("googleCid").isNotNull(), F.concat(F.lit("https://maps.google.com/?cid="), "googleCid"))
    ok = F.col("bad").isNull() & F.col("site").rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://[^/]+\.")
    return p.join(bad, "place_row_id", "left").select("place_row_id", F.when(ok, F.col("site")).otherwise(fallback).alias("public_url"))


oracle("host_policy", r"""
SELECT place_row_id, CASE WHEN regexp_matches(site, '^[Hh][Tt][Tt][Pp][Ss]?://[^/]+\.') AND NOT coalesce(regexp_matches(lower(site), '^https?://([^/]*\.)?(google|facebook|instagram)\.example(/|$|\?)'), false) THEN site
 ELSE 'https://maps.google.com/?cid=' || googleCid END AS public_url FROM (SELECT place_row_id, googleCid, trim(websiteUrl) AS site FROM place_candidates)""")


@query
def social_identity(spark, d):
    a = table(spark, d, "social_accounts").where("trim(url) != ''")
    return a.select("account_row_id", U.platform(F.col("url")).alias("by_url"), U.handle(F.col("url")).alias("handle"))


oracle("social_identity", r"""
SELECT account_row_id, CASE WHEN regexp_matches(h, '^youtube\.[a-z]+$') THEN 'YOUTUBE' WHEN regexp_matches(h, '^facebook\.[a-z]+$') THEN 'FACEBOOK' WHEN regexp_matches(h, '^instagram\.[a-z]+$') THEN 'INSTAGRAM' WHEN regexp_matches(h, '^(x|twitter)\.[a-z]+$') THEN 'X' END AS by_url,
 nullif(lower(regexp_extract(t, '^/(?:channel/|c/|user/|@)?([^/]+)', 1)), '') AS handle
FROM (SELECT account_row_id, regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#\s]*)', 1)), '^(www|m|mobile)\.', '') AS h, regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#\s]*([^?#\s]*)', 1) AS t FROM social_accounts WHERE trim(url) != '')""")


@query
def fuzzy_part_names(spark, d):
    """Pairs of part names that share their first word and are at least 0.6 alike."""
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k")).withColumn("first", F.split_part("p_name", F.lit(" "), F.lit(1)))
    a, b = names.select("first", F.col("k").alias("a"), F.col("p_name").alias("x")), names.select("first", F.col("k").alias("b"), F.col("p_name").alias("y"))
    return a.join(b, "first").where("a < b").select("a", "b", F.round(similarity.fuzzy(F.col("x"), F.col("y")), 6).alias("score")).where("score >= 0.6")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substring({0}, i, 2)))"
oracle("fuzzy_part_names", f"""
WITH n AS (SELECT p_name, min(p_partkey) AS k, split_part(p_name, ' ', 1) AS f FROM part GROUP BY p_name),
p AS (SELECT a.k AS a, b.k AS b, a.p_name AS x, b.p_name AS y FROM n a JOIN n b ON a.f = b.f AND a.k < b.k),
s AS (SELECT a, b, greatest(2.0 * len(list_intersect({_GRAMS.format('x')}, {_GRAMS.format('y')})) / (len({_GRAMS.format('x')}) + len({_GRAMS.format('y')})), 1.0 - CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y))) AS v FROM p)
SELECT a, b, round(CAST(v AS DOUBLE), 6) AS score FROM s WHERE round(CAST(v AS DOUBLE), 6) >= 0.6""")


@query
def page_html_fields(spark, d):
    """Title, heading and links read back from pages rendered as HTML."""
    p = table(spark, d, "church_pages").where("content is not null")
    doc = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title><script>x()</script></head><body><main><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><a href='/about#top'>x</a></main></body></html>"))
    read = p.select("page_id", "url", html.parse(doc).alias("h"))
    return read.select("page_id", F.col("h.title").alias("title"), F.size(html.same_host_links(F.col("url"), F.col("h.links"))).alias("links"))


@query
def slugs(spark, d):
    return table(spark, d, "churches").select("church_row_id", X.slug(F.col("englishName")).alias("slug"))


oracle("slugs", r"""
SELECT church_row_id, trim(regexp_replace(replace(regexp_replace(lower(strip_accents(englishName)), '[''’]', '', 'g'), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM churches""")


@query
def postal_prefecture(spark, d):
    """Postal code and prefecture at the head of each address."""
    a = F.translate(F.col("address"), "０１２３４５６７８９－　", "0123456789- ")
    postal = F.regexp_extract(a, r"^(?:日本、)?〒?\s*(\d{3})-?(\d{4})", 1)
    rest = F.trim(F.regexp_replace(a, r"^(?:日本、)?〒?\s*\d{3}-?\d{4}\s*", ""))
    return table(spark, d, "place_candidates").select("place_row_id", F.nullif(F.concat(postal, F.regexp_extract(a, r"^(?:日本、)?〒?\s*(\d{3})-?(\d{4})", 2)), F.lit("")).alias("postal"), F.nullif(F.regexp_extract(rest, "^([^都道府県市区町村 ]{1,4}[都道府県])", 1), F.lit("")).alias("prefecture"))


oracle("postal_prefecture", r"""
WITH a AS (SELECT place_row_id, translate(address, '０１２３４５６７８９－　', '0123456789- ') AS s FROM place_candidates)
SELECT place_row_id, nullif(regexp_extract(s, '^(?:日本、)?〒?\s*(\d{3})-?(\d{4})', 1) || regexp_extract(s, '^(?:日本、)?〒?\s*(\d{3})-?(\d{4})', 2), '') AS postal,
 nullif(regexp_extract(trim(regexp_replace(s, '^(?:日本、)?〒?\s*\d{3}-?\d{4}\s*', '')), '^([^都道府県市区町村 ]{1,4}[都道府県])', 1), '') AS prefecture FROM a""")


@query
def area_check_digits(spark, d):
    """Check digit of each municipality code and the parent of ward codes."""
    g = table(spark, d, "geonames").where("type = 'MUNICIPALITY'")
    return g.select("code", X.check_digit(F.substring("code", 1, 5)).alias("check_digit"), (F.floor(F.col("code").cast("long") / 10) * 10).alias("parent"))


oracle("area_check_digits", """
SELECT code, CAST(CASE WHEN 11 - s % 11 >= 10 THEN 0 ELSE 11 - s % 11 END AS INT) AS check_digit, CAST(code AS BIGINT) // 10 * 10 AS parent
FROM (SELECT code, CAST(substring(code,1,1) AS INT)*6 + CAST(substring(code,2,1) AS INT)*5 + CAST(substring(code,3,1) AS INT)*4 + CAST(substring(code,4,1) AS INT)*3 + CAST(substring(code,5,1) AS INT)*2 AS s FROM geonames WHERE type = 'MUNICIPALITY')""")


@query
def event_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


oracle("event_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


@query
def identity_hashes(spark, d):
    return table(spark, d, "churches").select("church_row_id", X.hash_id("church", F.col("name")).alias("name_id"), F.sha1("name").alias("sha1"))


oracle("identity_hashes", "SELECT church_row_id, 'church:' || substring(sha256(name), 1, 24) AS name_id, sha1(name) AS sha1 FROM churches")
