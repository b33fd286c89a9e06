"""Queries on public names, structured addresses, contacts, accounts and official labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis.functions import address as A, localise as L, naming as N, similarity, text as X, url as U
from parvis.operators import official, social
from parvis.plans.registry import oracle, query
from parvis.plans.resolve import identity_pairs
from parvis.session import table
from parvis.sources import directories as D, exports


@query
def public_names(spark, d):
    return table(spark, d, "jma_churches").select("jma_row_id", N.public_name(F.col("教会名")).alias("name"))


@query
def title_languages(spark, d):
    t = table(spark, d, "place_candidates").select("place_row_id", N.title_languages(F.col("name")).alias("l"))
    return t.select("place_row_id", F.array_join("l", ",").alias("languages"))


oracle("title_languages", r"""
WITH n AS (SELECT place_row_id, name, regexp_matches(name, '[\x{3040}-\x{30FF}]') AS kana, regexp_matches(name, '[\x{3400}-\x{9FFF}]') AS han, regexp_matches(name, '[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]') AS hangul,
 lower(name) AS l FROM place_candidates),
w AS (SELECT *, list_filter([""" + ", ".join(f"CASE WHEN regexp_matches(l, '(^|[^a-z0-9_ãáéíóúçéeàêô])({w})($|[^a-z0-9_ãáéíóúçéeàêô])') THEN '{c}' END" for c, w in N.TITLE_WORDS.items()) + r"""], lambda x: x IS NOT NULL) AS ws FROM n)
SELECT place_row_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([CASE WHEN kana OR (han AND NOT hangul) THEN 'ja' END, CASE WHEN hangul THEN 'ko' END, CASE WHEN len(ws) = 0 AND regexp_matches(name, '[A-Za-z]{2,}') THEN 'en' END], ws), lambda x: x IS NOT NULL))), ',') AS languages FROM w""")


@query
def denomination_parts(spark, d):
    return table(spark, d, "denominations").select("denominationId", N.denomination_part(F.col("name"), "ja").alias("ja"), N.denomination_part(F.col("englishName"), "en").alias("en"))


oracle("denomination_parts", """
SELECT denominationId, trim(regexp_replace(regexp_replace(trim(name), '教会$', ''), '教団$', '')) AS ja,
 CASE WHEN regexp_full_match(e, '[a-z][a-z0-9.-]*') THEN upper(e) ELSE e END AS en FROM (SELECT *, trim(regexp_replace(regexp_replace(trim(englishName), ' Church$', ''), ' Denomination$', '')) AS e FROM denominations)""")


@query
def address_areas(spark, d):
    """Codes of the prefecture and municipality that the addresses of the directory name."""
    j = table(spark, d, "jma_churches").where("`住所` is not null").select("jma_row_id", F.regexp_replace("住所", "[ 　]", "").alias("address"))
    got = A.decompose(j, key="jma_row_id", text="address", areas=table(spark, d, "geonames"))
    return got.where("prefecture_code is not null").select(F.col("key").alias("jma_row_id"), "prefecture_code", "municipality_code")


# by whole names: the area is the longest name of the gazetteer behind postcode and prefecture
oracle("address_areas", r"""
WITH j AS (SELECT jma_row_id, regexp_replace(translate(translate(regexp_replace("住所", '[ 　]', '', 'g'), '０１２３４５６７８９', '0123456789'), '−ー―‐‑–—ｰ－', '---------'), '^〒?[0-9]{3}-[0-9]{4}', '') AS t FROM jma_churches WHERE "住所" IS NOT NULL),
p AS (SELECT j.*, g.code AS pc, substring(t, length(g.name) + 1) AS r FROM j JOIN geonames g ON g.type = 'PREFECTURE' AND starts_with(t, g.name)),
m AS (SELECT jma_row_id, arg_max(g.code, length(g.name)) AS mc FROM p JOIN geonames g ON g.type = 'MUNICIPALITY' AND g.prefectureCode = pc AND starts_with(r, g.name) GROUP BY 1)
SELECT p.jma_row_id, pc AS prefecture_code, mc AS municipality_code FROM p LEFT JOIN m USING (jma_row_id)""")


@query
def structured_addresses(spark, d):
    """Addresses of the churches cut into parts, with area codes."""
    return A.decompose(table(spark, d, "churches"), key="church_row_id", text="address", areas=table(spark, d, "geonames")).withColumnRenamed("key", "church_row_id")


@query
def unusable_geonames(spark, d):
    g = table(spark, d, "geonames").select("code", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return g.select("code", "n", N.geoname_rejection(F.col("n")).alias("reason")).groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("names"))


oracle("unusable_geonames", """
WITH n AS (SELECT name AS n FROM geonames UNION ALL SELECT unnest(aliases) FROM geonames)
SELECT CASE WHEN regexp_matches(trim(n), '^[ァ-ヺヽヾー・]+$') THEN 'KATAKANA_ONLY' WHEN regexp_matches(trim(n), '^[〇一二三四五六七八九十百千万0-9０-９]+丁目$') THEN 'ADDRESS_BLOCK' ELSE 'usable' END AS reason, count(*) AS names FROM n WHERE n IS NOT NULL GROUP BY 1""")


@query
def account_classes(spark, d):
    a = table(spark, d, "social_accounts")
    return a.groupBy("platform", F.coalesce(N.account_exclusion(F.col("accountName"), F.col("description")), F.lit("church")).alias("class")).agg(F.count("*").alias("accounts"))


oracle("account_classes", f"""
WITH a AS (SELECT platform, concat_ws(' ', accountName, coalesce(description, '')) AS t FROM social_accounts)
SELECT platform, CASE WHEN regexp_matches(t, '{N.OTHER_SIGNAL}') AND NOT regexp_matches(t, '{N.CHURCH_SIGNAL}') THEN 'other organisation' WHEN NOT regexp_matches(t, '{N.CHURCH_SIGNAL}') THEN 'no church' WHEN NOT regexp_matches(t, '{N.JAPAN_SIGNAL}') THEN 'abroad' ELSE 'church' END AS class, count(*) AS accounts FROM a GROUP BY 1, 2""")


@query
def directory_ministers(spark, d):
    """Ministers read from directory lines."""
    j = table(spark, d, "jma_churches").where("`担任教師` is not null").select("jma_row_id", F.concat(F.lit("担任教師："), F.col("担任教師"), F.lit(" TEL 03-0000-0000")).alias("line"))
    return N.ministers(j, key="jma_row_id", text="line").withColumnRenamed("key", "jma_row_id")


@query
def page_contacts(spark, d):
    """Phone number and e-mail address of each page that has one."""
    p = table(spark, d, "church_pages").where("content is not null").select("page_id", N.phone(F.col("content")).alias("phone"), N.email(F.col("content")).alias("email"))
    return p.where("phone is not null or email is not null")


oracle("page_contacts", r"""
SELECT page_id, nullif(trim(regexp_extract(content, '(?:TEL|Tel|℡|電話(?:番号)?)[\s　]*[:：]?[\s　]*([0-9０-９()（）+\-ー－‐/\s　]{8,})', 1), E' \n\t\r　'), '') AS phone, CAST(NULL AS VARCHAR) AS email
FROM church_pages WHERE content IS NOT NULL AND regexp_matches(content, '(?:TEL|Tel|℡|電話(?:番号)?)[\s　]*[:：]?[\s　]*([0-9０-９()（）+\-ー－‐/\s　]{8,})')""")


@query
def church_emails(spark, d):
    """E-mail addresses read back from running text that spells the sign out."""
    c = table(spark, d, "churches").where("email is not null").select("church_row_id", F.concat(F.lit("お問い合わせは "), F.regexp_replace("email", "@", " [at] "), F.lit(" まで")).alias("t"))
    return c.select("church_row_id", N.email(F.col("t")).alias("email"))


oracle("church_emails", "SELECT church_row_id, email FROM churches WHERE email IS NOT NULL")


@query
def translated_names(spark, d):
    """Church names cut by a dictionary of area names and denominations and rendered in English."""
    g = table(spark, d, "geonames").select(F.explode(F.array("name", F.get("aliases", F.lit(0)))).alias("source"), F.col("translations")["en"].alias("target")).where("source is not null and target is not null")
    n = table(spark, d, "denominations").select(F.col("name").alias("source"), F.col("englishName").alias("target"))
    entries = g.unionByName(n).groupBy("source").agg(F.min("target").alias("target"))
    out = N.translate_by_dictionary(table(spark, d, "churches"), entries, key="church_row_id", text="name")
    return out.select(F.col("key").alias("church_row_id"), "translated", F.size("matched").alias("matched"))


@query
def hangul_area_names(spark, d):
    return table(spark, d, "geonames").select("code", N.hangul(F.col("translations")["en"]).alias("hangul")).where("hangul is not null")


@query
def localised_area_names(spark, d):
    """Area names for Korean readers, with their fallbacks."""
    g = table(spark, d, "geonames").withColumn("values", F.transform(F.map_entries("translations"), lambda e: F.struct(e["key"].alias("languageCode"), F.coalesce(e["value"], F.lit("")).alias("name"), F.lit("OFFICIAL").alias("source"), F.lit("UNREVIEWED").alias("reviewStatus"), F.lit(0.5).alias("confidence"))))
    return g.select("code", N.localised(F.col("values"), "ko", F.lit(None).cast("string"), F.col("name")).alias("name"))


oracle("localised_area_names", "SELECT code, coalesce(nullif(trim(translations['ko']), ''), nullif(trim(translations['en']), ''), name) AS name FROM geonames")


@query
def page_slugs(spark, d):
    """Unique page slugs of the churches: location prefixes where names collide."""
    c = table(spark, d, "churches").groupBy("id").agg(F.min_by(F.struct("englishName", "address"), "church_row_id").alias("r")).select("id", "r.englishName", "r.address")
    pref = F.array(X.slug(F.translate(F.regexp_extract("address", r"(\d{3}-?\d{4})", 1), "-", "")))
    rows = c.select("id", X.slug(F.col("englishName")).alias("slug"), pref.alias("prefixes")).where("slug is not null")
    return N.resolve_slug_collisions(rows, key="id", slug="slug", prefixes="prefixes").withColumnRenamed("key", "id")


oracle("page_slugs", r"""
WITH c AS (SELECT id, arg_min({'e': englishName, 'a': address}, church_row_id) AS r FROM churches GROUP BY 1),
s AS (SELECT id, trim(regexp_replace(replace(regexp_replace(lower(strip_accents(r.e)), '[''’]', '', 'g'), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS s, replace(regexp_extract(r.a, '([0-9]{3}-?[0-9]{4})', 1), '-', '') AS z FROM c WHERE r.e IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY s) AS k FROM s WHERE s != ''),
one AS (SELECT id, s AS slug FROM n WHERE k = 1),
two AS (SELECT min(id) AS id, z || '-' || s AS slug FROM n WHERE k > 1 AND z != '' AND z || '-' || s NOT IN (SELECT slug FROM one) GROUP BY 2)
SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT id, s || '-' || id AS slug FROM n WHERE k > 1 AND id NOT IN (SELECT id FROM two)""")


def _norm(c):
    return F.regexp_replace(F.lower(c), r"[\s　・･,，.。()（）]", "")


@query
def account_links(spark, d):
    """Accounts linked to churches by page links, names, or close names."""
    a = table(spark, d, "social_accounts").select(F.col("account_row_id").alias("account"), _norm(F.col("accountName")).alias("name"), U.link_fold(F.col("url")).alias("url")).where("name != ''")
    c = table(spark, d, "churches").groupBy("id").agg(F.min("church_row_id").alias("church"), F.min_by("name", "church_row_id").alias("n")).select("church", "id", _norm(F.col("n")).alias("name")).where("name != ''")
    links = table(spark, d, "church_pages").select(F.col("churchId").alias("id"), F.explode("outgoingLinks").alias("l")).join(c.select("id", "church"), "id").select("church", U.link_fold(F.col("l")).alias("url"))
    return social.link_accounts(a, c.drop("id"), links).select("account", "church", "source", F.round("score", 4).alias("score"))


@query
def account_estimates(spark, d):
    a = table(spark, d, "social_accounts").select(F.col("account_row_id").alias("account"), _norm(F.col("accountName")).alias("name")).where("length(name) > 1")
    c = table(spark, d, "churches").select(F.col("church_row_id").alias("church"), _norm(F.col("name")).alias("name")).where("length(name) > 1")
    return social.merge_estimates(a, c).select("account", "church", "kind", F.round("score", 4).alias("score"))


@query
def reconciled_labels(spark, d):
    """Labels of churches after one-to-one matches with a directory of two denominations."""
    pairs = identity_pairs(spark, d).select(F.col("church_row_id").alias("church"), F.col("jma_row_id").alias("entry"), F.when(F.col("jma_row_id") % 2 == 0, "dn-lightgospel").otherwise("dn-graceunion").alias("denomination"), F.col("confidence").alias("score"))
    c = table(spark, d, "churches").select(F.col("church_row_id").alias("church"), F.col("denominationId").alias("denomination"), F.when(F.col("church_row_id") % 10 == 0, F.col("denominationId")).alias("human"))
    listed = spark.createDataFrame([("dn-lightgospel",), ("dn-graceunion",)], "denomination string")
    return official.reconcile(c, pairs, listed).select("church", "before", "after", "status")


@query
def determined_labels(spark, d):
    """Denomination of every church by precedence of overrides, labels and names."""
    c = table(spark, d, "churches").select(F.col("church_row_id").alias("church"), F.col("denominationId").alias("denomination"), F.lit(None).cast("string").alias("human"), "name")
    over = c.where("church % 50 = 0").select("church", F.lit("dn-independent").alias("value"), F.lit(1).alias("position"))
    named = c.where(F.col("name").contains("ルーテル")).select("church", F.lit("dn-lanternluth").alias("value"))
    none = spark.createDataFrame([], "church bigint, value string")
    return official.determine(c.drop("name"), over, named, none, none)


oracle("determined_labels", """
SELECT church_row_id AS church, denominationId AS before,
 CASE WHEN church_row_id % 50 = 0 THEN 'dn-independent' WHEN contains(name, 'ルーテル') THEN 'dn-lanternluth' ELSE denominationId END AS after,
 CASE WHEN church_row_id % 50 = 0 THEN 1.0 WHEN contains(name, 'ルーテル') AND denominationId IS DISTINCT FROM 'dn-lanternluth' THEN 0.95 WHEN denominationId IS NOT NULL THEN 1.0 END::DOUBLE AS confidence,
 CASE WHEN church_row_id % 50 = 0 THEN 'override' WHEN contains(name, 'ルーテル') AND denominationId IS NOT NULL AND denominationId != 'dn-lanternluth' THEN 'name corrects' WHEN denominationId IS NOT NULL THEN 'label' WHEN contains(name, 'ルーテル') THEN 'name' END AS source FROM churches""")


@query
def similar_names(spark, d):
    """Dice similarity of church names with their first record's name."""
    c = table(spark, d, "churches").select("id", "church_row_id", "name")
    first = c.groupBy("id").agg(F.min_by("name", "church_row_id").alias("first"))
    return c.join(first, "id").select("church_row_id", F.round(similarity.dice(F.col("name"), F.col("first")), 6).alias("dice"))


_G = "CASE WHEN length({0}) <= n THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - n + 2), lambda i: substring({0}, i, n))) END"
oracle("similar_names", f"""
WITH f AS (SELECT id, arg_min(name, church_row_id) AS f FROM churches GROUP BY id), p AS (SELECT church_row_id, name AS x, f AS y, CASE WHEN least(length(name), length(f)) >= 4 THEN 2 ELSE 1 END AS n FROM churches JOIN f USING (id)),
g AS (SELECT church_row_id, {_G.format('x')} AS a, {_G.format('y')} AS b FROM p)
SELECT church_row_id, round(CAST(2.0 * len(list_intersect(a, b)) / greatest(len(a) + len(b), 1) AS DOUBLE), 6) AS dice FROM g""")


@query
def title_parts(spark, d):
    """Scripts that the titles of places are written in."""
    p = table(spark, d, "place_candidates").select(L.decompose_title("name").alias("p"))
    return p.groupBy("p.pattern").agg(F.count("*").alias("places"))


@query
def site_pages(spark, d):
    """One page per church and language."""
    c = table(spark, d, "churches").groupBy("id").agg(F.min_by("name", "church_row_id").alias("name"), F.min_by("englishName", "church_row_id").alias("en"))
    return exports.page_models(c, ["ja", "en", "ko", "pt", "id"], key="id", name=F.col("name"), localised={"en": F.col("en")}).withColumnRenamed("key", "id")


oracle("site_pages", """
WITH c AS (SELECT id, arg_min(name, church_row_id) AS name, arg_min(englishName, church_row_id) AS en FROM churches GROUP BY id), l AS (SELECT unnest(['ja','en','ko','pt','id']) AS language)
SELECT id, language, '/' || language || '/churches/' || id || '/' AS path, CASE WHEN language = 'en' THEN coalesce(en, name) ELSE name END AS title FROM c, l""")


@query
def migrated_translations(spark, d):
    """Outcomes of filling Chinese area names from Japanese ones, municipalities' names being protected."""
    g = table(spark, d, "geonames").select(F.col("translations")["zh-Hans"].alias("now"), (F.col("type") == "WARD").alias("protected"), X.to_simplified(F.col("name")).alias("fresh"))
    _, outcome = L.migrate(F.nullif("now", F.lit("")), F.col("protected"), F.col("fresh"))
    return g.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("areas"))


oracle("migrated_translations", f"""
WITH g AS (SELECT nullif(translations['zh-Hans'], '') AS now, type = 'WARD' AS p, translate(name, '{X.TRADITIONAL + X.SHINJITAI}', '{X.SIMPLIFIED + X.SHINJITAI_SIMPLE}') AS fresh FROM geonames)
SELECT CASE WHEN coalesce(p, false) THEN 'protected' WHEN fresh IS NULL THEN 'no translation' WHEN now IS NOT DISTINCT FROM fresh THEN 'unchanged' WHEN now IS NULL THEN 'added' ELSE 'replaced' END AS outcome, count(*) AS areas FROM g GROUP BY 1""")


@query
def decoded_contents(spark, d):
    """Page contents as bytes in two charsets, decoded by what the bytes say."""
    p = table(spark, d, "church_pages").where("content is not null").select("page_id", "content", D.decode_page(F.encode(F.col("content"), "UTF-8")).alias("text"))
    return p.agg(F.count("*").alias("pages"), F.count_if(F.col("text") == F.col("content")).alias("same"))


oracle("decoded_contents", "SELECT count(*) AS pages, count(*) AS same FROM church_pages WHERE content IS NOT NULL")
