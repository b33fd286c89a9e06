"""Queries that join records of different sources and resolve entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from parvis.functions import similarity, text as X, url as U
from parvis.operators import dedupe, resolve
from parvis.plans.registry import oracle, query
from parvis.session import table


MOST_PREFECTURES = 1_000


@query
def church_details(spark, d):
    """Every church record with its denomination's name, its pages and its hosts."""
    c = table(spark, d, "churches").select("church_row_id", "id", "denominationId")
    dn = table(spark, d, "denominations").select("denominationId", F.col("englishName").alias("denomination"))
    p = table(spark, d, "church_pages").groupBy(F.col("churchId").alias("id")).agg(F.count("*").alias("pages"), F.countDistinct(U.host(F.col("url"))).alias("hosts"))
    return c.join(dn, "denominationId", "left").join(p, "id", "left").select("church_row_id", "denomination", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("hosts", F.lit(0)).alias("hosts"))


oracle("church_details", r"""
WITH p AS (SELECT churchId AS id, count(*) AS pages, count(DISTINCT regexp_extract(lower(url), '^\s*[a-z]+://([^/?#:\s]*)', 1)) AS hosts FROM church_pages GROUP BY 1)
SELECT church_row_id, n.englishName AS denomination, coalesce(pages, 0) AS pages, coalesce(hosts, 0) AS hosts FROM churches c LEFT JOIN denominations n USING (denominationId) LEFT JOIN p USING (id)""")


@query
def churches_without_pages(spark, d):
    return table(spark, d, "churches").select("id").distinct().join(table(spark, d, "church_pages").select(F.col("churchId").alias("id")).distinct(), "id", "left_anti")


oracle("churches_without_pages", "SELECT DISTINCT id FROM churches WHERE id NOT IN (SELECT churchId FROM church_pages WHERE churchId IS NOT NULL)")


@query
def customers_with_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


oracle("customers_with_orders", "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")


@query
def excluded_places(spark, d):
    """Places less an exclusion list by id, map id or prefixed map id."""
    p = table(spark, d, "place_candidates")
    listed = p.where("googleCid is not null").groupBy("googleCid").agg(F.count("*").alias("n")).where("n >= 6").select(F.concat(F.lit("google:"), "googleCid").alias("x"))
    return p.join(listed, F.coalesce("id", F.lit("")) == F.col("x"), "left_anti").select("place_row_id")


oracle("excluded_places", "SELECT place_row_id FROM place_candidates WHERE coalesce(id, '') NOT IN (SELECT 'google:' || googleCid FROM place_candidates WHERE googleCid IS NOT NULL GROUP BY googleCid HAVING count(*) >= 6)")


@query
def denomination_rules(spark, d):
    """Denomination of each place by the components in its name, where all matching rules agree."""
    rules = table(spark, d, "denominations")
    terms = rules.select(F.col("denominationId").alias("rule"), F.explode("churchNameComponents").alias("term"), F.lit(False).alias("veto")).unionByName(rules.select(F.col("denominationId").alias("rule"), F.explode("churchNameExcludes").alias("term"), F.lit(True).alias("veto")))
    return resolve.rule_matches(table(spark, d, "place_candidates"), terms, key="place_row_id", text="name").select(F.col("key").alias("place_row_id"), F.col("rule").alias("denominationId"))


oracle("denomination_rules", """
WITH r AS (SELECT denominationId, unnest(churchNameComponents) AS term FROM denominations)
SELECT place_row_id, min(denominationId) AS denominationId FROM place_candidates JOIN r ON contains(name, term) WHERE length(term) >= 3 GROUP BY 1 HAVING count(DISTINCT denominationId) = 1""")


@query
def linked_accounts(spark, d):
    """Accounts whose url a church's page links to."""
    a = table(spark, d, "social_accounts").where("trim(url) != ''").select("account_row_id", U.link_fold(F.col("url")).alias("u"))
    p = table(spark, d, "church_pages").select("churchId", F.explode("outgoingLinks").alias("l")).select("churchId", U.link_fold(F.col("l")).alias("u")).distinct()
    return a.join(p, "u").select("account_row_id", "churchId").distinct()


_FOLD = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[?#].*$', ''), '/+$', ''), '^http://', 'https://')"
oracle("linked_accounts", f"SELECT DISTINCT account_row_id, churchId FROM social_accounts a JOIN (SELECT churchId, unnest(outgoingLinks) AS l FROM church_pages) p ON trim(a.url) != '' AND {_FOLD.format('a.url')} = {_FOLD.format('p.l')}")


@query
def linked_sites(spark, d):
    """Churches whose website a crawled page links to, and the church of that page."""
    a = table(spark, d, "churches").where("trim(websiteUrl) != ''").select("church_row_id", U.link_fold(F.col("websiteUrl")).alias("u"))
    p = table(spark, d, "church_pages").select("churchId", F.explode("outgoingLinks").alias("l")).select("churchId", U.link_fold(F.col("l")).alias("u")).distinct()
    return a.join(p, "u").select("church_row_id", "churchId").distinct()


oracle("linked_sites", f"SELECT DISTINCT church_row_id, churchId FROM churches a JOIN (SELECT churchId, unnest(outgoingLinks) AS l FROM church_pages) p ON trim(a.websiteUrl) != '' AND {_FOLD.format('a.websiteUrl')} = {_FOLD.format('p.l')}")


def _names(spark, d, name, key, column):
    n = F.regexp_replace(F.lower(F.col(column)), r"[\s　・･,，.。()（）]", "")
    return table(spark, d, name).select(F.col(key).alias("key"), n.alias("n")).where("n != ''")


@query
def accounts_by_name(spark, d):
    """Accounts and churches of one normal name."""
    a, c = _names(spark, d, "social_accounts", "account_row_id", "accountName"), _names(spark, d, "churches", "church_row_id", "name")
    return a.withColumnRenamed("key", "account_row_id").join(c.withColumnRenamed("key", "church_row_id"), "n").select("account_row_id", "church_row_id")


_NORM = r"regexp_replace(lower({0}), '[\s　・･,，.。()（）]', '', 'g')"
oracle("accounts_by_name", f"SELECT account_row_id, church_row_id FROM social_accounts a JOIN churches c ON {_NORM.format('a.accountName')} = {_NORM.format('c.name')} WHERE {_NORM.format('a.accountName')} != ''")


@query
def postal_blocks(spark, d):
    """Pairs of directory rows and churches that share a postal code or the end of the address."""
    digits = lambda c: F.regexp_extract(F.translate(c, "０１２３４５６７８９－", "0123456789-"), r"(\d{3}-?\d{4})", 1)
    j = table(spark, d, "jma_churches").select(F.col("jma_row_id").alias("key"), F.regexp_replace(digits(F.coalesce("郵便番号", F.lit(""))), "-", "").alias("p"), F.regexp_replace(F.coalesce("住所", F.lit("")), r"[\s　]", "").alias("a"))
    c = table(spark, d, "churches").select(F.col("church_row_id").alias("key"), F.regexp_replace(digits(F.coalesce("address", F.lit(""))), "-", "").alias("p"), F.regexp_replace(F.coalesce("address", F.lit("")), r"[\s　]", "").alias("a"))
    blocks = lambda: F.array(F.concat(F.lit("p"), F.nullif("p", F.lit(""))), F.when(F.length("a") >= 8, F.concat(F.lit("a"), F.right("a", F.lit(8)))))
    return resolve.blocked_pairs(j, c, key="key", blocks=blocks).select(F.col("a").alias("jma_row_id"), F.col("b").alias("church_row_id"))


oracle("postal_blocks", r"""
WITH j AS (SELECT jma_row_id AS k, replace(regexp_extract(translate(coalesce("郵便番号", ''), '０１２３４５６７８９－', '0123456789-'), '(\d{3}-?\d{4})', 1), '-', '') AS p, regexp_replace(coalesce("住所", ''), '[\s　]', '', 'g') AS a FROM jma_churches),
c AS (SELECT church_row_id AS k, replace(regexp_extract(translate(coalesce(address, ''), '０１２３４５６７８９－', '0123456789-'), '(\d{3}-?\d{4})', 1), '-', '') AS p, regexp_replace(coalesce(address, ''), '[\s　]', '', 'g') AS a FROM churches)
SELECT j.k AS jma_row_id, c.k AS church_row_id FROM j JOIN c ON j.p = c.p WHERE j.p != '' UNION SELECT j.k, c.k FROM j JOIN c ON right(j.a, 8) = right(c.a, 8) WHERE length(j.a) >= 8 AND length(c.a) >= 8""")


@query
def gram_candidates(spark, d):
    """For every supplier the five parts whose names share most bigrams with the supplier's nation."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.lower("n_name").alias("t"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lower("p_name").alias("t"))
    return resolve.gram_candidates(n, p, key="key", text="t", most=5)


oracle("gram_candidates", """
WITH a AS (SELECT CAST(n_nationkey AS BIGINT) AS k, unnest(list_distinct(list_transform(range(1, greatest(length(n_name) - 1, 1) + 1), lambda i: substring(lower(n_name), i, 2)))) AS g FROM nation),
b AS (SELECT p_partkey AS k, unnest(list_distinct(list_transform(range(1, greatest(length(p_name) - 1, 1) + 1), lambda i: substring(lower(p_name), i, 2)))) AS g FROM part),
s AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM a JOIN b USING (g) GROUP BY 1, 2)
SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS r FROM s) WHERE r <= 5""")


@query
def identity_pairs(spark, d):
    """Directory rows and churches of one block (name, name grams, postal code, end of the address), with the confidence that they are one."""
    digits = lambda c: F.regexp_replace(F.regexp_extract(F.translate(c, "０１２３４５６７８９－", "0123456789-"), r"(\d{3}-?\d{4})", 1), "-", "")
    j = table(spark, d, "jma_churches").select(F.col("jma_row_id").alias("key"), X.entity_name(F.col("教会名")).alias("name"), X.entity_address(F.coalesce("住所", F.lit(""))).alias("address"), F.nullif(digits(F.coalesce("郵便番号", F.lit(""))), F.lit("")).alias("postal"))
    c = table(spark, d, "churches").select(F.col("church_row_id").alias("key"), X.entity_name(F.col("name")).alias("name"), X.entity_address(F.coalesce("address", F.lit(""))).alias("address"), F.nullif(digits(F.coalesce("address", F.lit(""))), F.lit("")).alias("postal"))
    return resolve.identities(j, c).select(F.col("a").alias("jma_row_id"), F.col("b").alias("church_row_id"), F.round("confidence", 4).alias("confidence"))


@query
def one_to_one(spark, d):
    """Directory rows and churches assigned one to one by falling confidence."""
    pairs = identity_pairs(spark, d).select(F.col("jma_row_id").alias("a"), F.col("church_row_id").alias("b"), F.col("confidence").alias("score"))
    return resolve.mutual_best(pairs)


@query
def romanised_addresses(spark, d):
    """Native and romanised spellings of one postal code that are 0.9 alike."""
    g = table(spark, d, "geonames").where("type = 'PREFECTURE'").select("name", F.col("translations")["en"].alias("en")).where("en is not null").limit(MOST_PREFECTURES + 1).collect()
    if len(g) > MOST_PREFECTURES:
        raise ValueError(f"more than {MOST_PREFECTURES} prefectures")
    p = table(spark, d, "place_candidates").select("place_row_id", "address", F.regexp_replace(F.regexp_extract("address", r"(\d{3}-\d{4})", 1), "-", "").alias("p")).where("p != ''")
    latin = ~F.col("address").rlike("[\\u3040-\\u30FF\\u3400-\\u9FFF]")
    a, b = p.where(~latin).select("p", F.col("place_row_id").alias("a"), F.col("address").alias("x")), p.where(latin).select("p", F.col("place_row_id").alias("b"), F.col("address").alias("y"))
    score = similarity.romanised_address_score(F.col("x"), F.col("y"), {r["name"]: r["en"] for r in g})
    return a.join(b, "p").select("a", "b", F.round(score, 2).alias("score")).where("score >= 0.9")


@query
def name_determinations(spark, d):
    """Last override of each place's name field by position, else the first record's name."""
    p = table(spark, d, "place_candidates").where("googleCid is not null").select("googleCid", "place_row_id", "name", (F.col("place_row_id") % 5 == 0).alias("human"))
    first = dedupe.keep_first(p, ["googleCid"], [F.col("place_row_id")]).select("googleCid", F.col("name").alias("first_name"))
    human = dedupe.keep_first(p.where("human"), ["googleCid"], [-F.col("place_row_id")]).select("googleCid", F.col("name").alias("human_name"))
    return first.join(human, "googleCid", "left").select("googleCid", F.coalesce("human_name", "first_name").alias("name"), F.when(F.col("human_name").isNotNull(), "human").otherwise("source").alias("source"))


oracle("name_determinations", """
SELECT googleCid, coalesce(arg_max(name, place_row_id) FILTER (place_row_id % 5 = 0), arg_min(name, place_row_id)) AS name, CASE WHEN count(*) FILTER (place_row_id % 5 = 0) > 0 THEN 'human' ELSE 'source' END AS source FROM place_candidates WHERE googleCid IS NOT NULL GROUP BY 1""")


@query
def import_projection(spark, d):
    """Church records as they are imported: trimmed, blanks as null, lists sorted."""
    c = table(spark, d, "churches")
    return c.select("church_row_id", X.blank_to_null(F.col("name")).alias("name"), X.blank_to_null(F.col("address")).alias("address"), X.blank_to_null(F.col("websiteUrl")).alias("websiteUrl"), F.array_join(F.array_sort(F.array_distinct("titleLanguages")), ",").alias("languages"))


oracle("import_projection", "SELECT church_row_id, nullif(trim(name, ' '), '') AS name, nullif(trim(address, ' '), '') AS address, nullif(trim(websiteUrl, ' '), '') AS websiteUrl, array_to_string(list_sort(list_distinct(titleLanguages)), ',') AS languages FROM churches")


@query
def usable_names(spark, d):
    """Names that aren't blank or a bare postal code."""
    return table(spark, d, "place_candidates").where(~F.coalesce("name", F.lit("")).rlike(r"^\s*(〒?\s*\d{3}-?\d{4})?\s*$")).select("place_row_id")


oracle("usable_names", r"SELECT place_row_id FROM place_candidates WHERE NOT regexp_matches(coalesce(name, ''), '^\s*(〒?\s*\d{3}-?\d{4})?\s*$')")
