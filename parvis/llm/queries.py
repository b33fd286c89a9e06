"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parvis.llm import boilerplate, congregations, leakage, linkage, mojibake, packing, plots, quality, survivors
from parvis.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark, d):
    """Lines of each page that belong to its own body."""
    return boilerplate.find_body_lines(table(spark, d, "church_pages"))


@query
def p2_bodies(spark, d):
    """The body of each page."""
    return boilerplate.extract_body(table(spark, d, "church_pages"))


@query
def p3_found(spark, d):
    """Rows of the two tables whose addresses denote the same plot."""
    places = plots.gazetteer_rows(table(spark, d, "geonames"))
    left = cut(plots.read_addresses(table(spark, d, "place_candidates"), places, key="place_row_id", text="address"))
    right = cut(plots.read_addresses(table(spark, d, "jma_churches"), places, key="jma_row_id", text="住所", postcode="郵便番号"))
    return plots.same_plots(left, right).select(F.col("left_key").alias("place_row_id"), F.col("right_key").alias("jma_row_id"))


def _sighted(spark, d, other):
    """Sightings of place_candidates and of another table, their entities, and how their names meet."""
    places = plots.gazetteer_rows(table(spark, d, "geonames"))
    words = congregations.denomination_words(table(spark, d, "denominations"))
    left = congregations.sightings(table(spark, d, "place_candidates"), places, key="place_row_id", name="name", second="latinName", address="address", entity="googleCid", location="location", website="websiteUrl")
    if other == "jma_churches":
        right = congregations.sightings(table(spark, d, other), places, key="jma_row_id", name="教会名", address="住所", postcode="郵便番号")
    else:
        right = congregations.sightings(table(spark, d, other), places, key="church_row_id", name="name", second="englishName", address="address", entity="id", location="location", website="websiteUrl")
    left, right = cut(left), cut(right)
    return left, right, *congregations.meet(left, right, places, words)


@query
def p5_found(spark, d):
    """Values that are garbled by a wrong encoding."""
    found = mojibake.repair(table(spark, d, "social_accounts"), ["accountName", "description"], key="account_row_id", restore=False)
    return found.select(F.col("key").alias("account_row_id"), "field")


@query
def p5_restored(spark, d):
    """Garbled values and what they were."""
    return mojibake.repair(table(spark, d, "social_accounts"), ["accountName", "description"], key="account_row_id").withColumnRenamed("key", "account_row_id")


def _linked(spark, d):
    left, right, le, re_, met = _sighted(spark, d, "churches")
    return linkage.link(met, le, re_).select("a", "b", F.col("confidence").alias("score")), left, right


@query
def p1_found(spark, d):
    """Rows of place_candidates and churches that describe the same congregation."""
    pairs, left, right = _linked(spark, d)
    rows = congregations.to_rows(pairs.where("score >= 0.5"), left, right)
    return rows.select(F.col("left_key").alias("place_row_id"), F.col("right_key").alias("church_row_id"))


@query
def p1_confidence(spark, d):
    """Candidate pairs of entities by confidence, in tenths."""
    pairs, _, _ = _linked(spark, d)
    return pairs.groupBy(F.round("score", 1).alias("confidence")).agg(F.count("*").alias("pairs"))


@query
def p4_found(spark, d):
    """Best values of the rows that share a map id."""
    chosen = survivors.place_survivors(table(spark, d, "place_candidates"), table(spark, d, "denominations"))
    return chosen.select(F.col("group").alias("googleCid"), "field", "value")


ORACLES["p4_found"] = r"""
WITH r AS (
  SELECT *, CASE WHEN regexp_matches(resolvedAt, '^\d{4}-\d{2}-\d{2}') THEN try_cast(resolvedAt AS TIMESTAMPTZ) END AS t,
    lower(trim(denominationHint)) AS hint,
    regexp_extract(lower(trim(websiteUrl)), '^https?://([a-z0-9\-]+(\.[a-z0-9\-]+)+)', 1) AS host
  FROM place_candidates WHERE googleCid IS NOT NULL),
g AS (SELECT googleCid FROM r GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT *, row_number() OVER (PARTITION BY googleCid ORDER BY t IS NULL, t DESC, ingested_at DESC, place_row_id DESC) AS k FROM r WHERE googleCid IN (SELECT googleCid FROM g)),
w AS (SELECT googleCid, 'websiteUrl' AS field, arg_min(websiteUrl, k) AS value FROM o
  WHERE host != '' AND NOT regexp_matches(host, '(^|\.)(google|goo|facebook|fb|instagram|twitter|x|youtube|youtu|line|tiktok|threads)\.[a-z.]+$') GROUP BY 1),
m AS (SELECT denominationId, lower(denominationId) AS hint FROM denominations UNION SELECT denominationId, lower(name) FROM denominations),
h AS (SELECT googleCid, 'denominationHint' AS field, arg_min(m.denominationId, k) AS value FROM o JOIN m USING (hint) GROUP BY 1),
l AS (SELECT DISTINCT googleCid, 'sourceLists' AS field, trim(v) AS value FROM (SELECT googleCid, unnest(sourceLists) AS v FROM o) WHERE trim(v) != '')
SELECT * FROM w UNION ALL SELECT * FROM h UNION ALL SELECT * FROM l
"""


@query
def p4_records(spark, d):
    """One surviving record per map id."""
    chosen = survivors.place_survivors(table(spark, d, "place_candidates"), table(spark, d, "denominations"))
    return survivors.records(chosen).withColumnRenamed("group", "googleCid").withColumn("sourceLists", F.array_join("sourceLists", "|"))


ORACLES["p4_records"] = f"""
SELECT googleCid, max(value) FILTER (field = 'websiteUrl') AS websiteUrl, max(value) FILTER (field = 'denominationHint') AS denominationHint,
 array_to_string(list_sort(coalesce(list(value) FILTER (field = 'sourceLists'), [])), '|') AS sourceLists FROM ({ORACLES['p4_found']}) GROUP BY 1"""


@query
def p4_weighted(spark, d):
    """Web address of each map id by the sum of votes that halve every 90 days, and the sum."""
    c = table(spark, d, "place_candidates")
    site = survivors.web_address(F.col("websiteUrl"))
    long = survivors.votes(c, {"websiteUrl": (site, F.lower(survivors.trimmed(site)))}, group="googleCid", time=survivors.readable_time(F.col("resolvedAt")), second_time=F.col("ingested_at"), key=F.col("place_row_id"))
    return survivors.winners(long, half_life_days=90).select(F.col("group").alias("googleCid"), F.lower(survivors.trimmed(F.col("value"))).alias("website"), F.round("votes", 6).alias("votes"))


ORACLES["p4_weighted"] = r"""
WITH r AS (SELECT googleCid, lower(trim(websiteUrl)) AS w, CASE WHEN regexp_matches(resolvedAt, '^\d{4}-\d{2}-\d{2}') THEN try_cast(resolvedAt AS TIMESTAMPTZ) END AS t, ingested_at AT TIME ZONE 'UTC' AS i, place_row_id FROM place_candidates
  WHERE googleCid IS NOT NULL AND regexp_extract(lower(trim(websiteUrl)), '^https?://([a-z0-9\-]+(\.[a-z0-9\-]+)+)', 1) NOT IN ('')
  AND NOT regexp_matches(regexp_extract(lower(trim(websiteUrl)), '^https?://([a-z0-9\-]+(\.[a-z0-9\-]+)+)', 1), '(^|\.)(google|goo|facebook|fb|instagram|twitter|x|youtube|youtu|line|tiktok|threads)\.[a-z.]+$')),
v AS (SELECT *, pow(0.5, (epoch((SELECT max(coalesce(t, i)) FROM r)) - epoch(coalesce(t, i))) / 86400 / 90) * CASE WHEN t IS NULL THEN 0.5 ELSE 1 END AS vote FROM r),
s AS (SELECT googleCid, w, sum(vote) AS votes, max((t IS NOT NULL, coalesce(t, i), place_row_id)) AS lead FROM v GROUP BY 1, 2)
SELECT googleCid, arg_max(w, (votes, lead)) AS website, round(max(votes), 6) AS votes FROM s GROUP BY 1"""


@query
def p6_found(spark, d):
    """Rows of the two tables that name the same congregation."""
    left, right, le, re_, met = _sighted(spark, d, "jma_churches")
    pairs = congregations.same_names(met, le, re_).where("score >= 0.5")
    return congregations.to_rows(pairs, left, right).select(F.col("left_key").alias("place_row_id"), F.col("right_key").alias("jma_row_id"))


@query
def p8_packed(spark, d):
    """The container of every document or piece of one: doc_id, piece, tokens, container."""
    return packing.pack(cut(packing.token_counts(table(spark, d, "documents")))).withColumnRenamed("size", "tokens")


@query
def p8_fill(spark, d):
    """Containers by how full they are, in twentieths."""
    packed = packing.pack(cut(packing.token_counts(table(spark, d, "documents")))).where("container is not null")
    full = packed.groupBy("container").agg(F.sum("size").alias("tokens"))
    return full.groupBy(F.floor(F.col("tokens") * 20 / packing.CAPACITY).alias("twentieth")).agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))


@query
def p8_invariants(spark, d):
    """What must hold of the packing: every text packed, none split that fits, no container over its capacity."""
    packed = cut(packing.pack(cut(packing.token_counts(table(spark, d, "documents")))))
    over = packed.where("container is not null").groupBy("container").agg(F.sum("size").alias("s")).agg(F.count_if(F.col("s") > packing.CAPACITY).alias("over_capacity"))
    texts = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"))
    return texts.agg(F.count("*").alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= packing.CAPACITY)).alias("split_though_fitting"), F.count_if(F.col("tokens") == 0).alias("empty")).crossJoin(over)  # one row each


ORACLES["p8_invariants"] = "SELECT count(*) AS texts, 0::BIGINT AS split_though_fitting, count(*) FILTER (text = '') AS empty, 0::BIGINT AS over_capacity FROM documents WHERE text IS NOT NULL"


@query
def p9_found(spark, d):
    """(document, item) where more than half of the item stands in the document."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query
def p9_item_report(spark, d):
    """Per leaked item: documents concerned and the longest passage share."""
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max(F.col("passage_chars") / F.col("item_chars")).alias("longest_share"))


@query
def p10_found(spark, d):
    """Documents whose posterior text type isn't natural prose."""
    return quality.text_types(quality.text_statistics(table(spark, d, "documents")), keep=()).where("p_prose < 0.5").select("doc_id")


@query
def p10_statistics(spark, d):
    """The statistics of every document."""
    return quality.text_statistics(table(spark, d, "documents"))


@query
def p10_lines(spark, d):
    """Characters and lines with ink of every document."""
    return quality.text_statistics(table(spark, d, "documents")).select("doc_id", "n_chars", "n_lines")


ORACLES["p10_lines"] = r"""
SELECT doc_id, coalesce(length(text), 0) AS n_chars, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '[^\s\x{a0}\x{3000}\x{2000}-\x{200d}\x{feff}\x{ad}\x{202f}\x{205f}\x{2060}]'))) AS n_lines FROM documents"""


@query
def p10_type_counts(spark, d):
    """Documents and mean confidence per text type."""
    types = quality.text_types(quality.text_statistics(table(spark, d, "documents")), keep=())
    return types.groupBy("text_type").agg(F.count("*").alias("documents"), F.avg(F.greatest("p_prose", "p_list", "p_table", "p_junk")).alias("mean_confidence"))
