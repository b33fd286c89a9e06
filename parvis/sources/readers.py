"""Readers of the catalog's inputs, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])
CHURCH = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "googleCid", "name", "englishName")],
        T.StructField("titleLanguages", T.ArrayType(T.StringType())),
        *[T.StructField(n, T.StringType()) for n in ("denominationId", "category", "address")],
        T.StructField("location", POINT),
        *[T.StructField(n, T.StringType()) for n in ("websiteUrl", "email", "updatedAt")],
    ]
)
GEONAMES_DUMP = "geonameid STRING, name STRING, asciiname STRING, alternatenames STRING, latitude STRING, longitude STRING, feature_class STRING, feature_code STRING, country_code STRING, cc2 STRING, admin1 STRING, admin2 STRING, admin3 STRING, admin4 STRING, population STRING, elevation STRING, dem STRING, timezone STRING, modification_date STRING"
ALTERNATE_NAMES = "alternateNameId STRING, geonameid STRING, isolanguage STRING, name STRING, isPreferred STRING, isShort STRING, isColloquial STRING, isHistoric STRING"


def church_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) records of a JSON catalog. A record needs an id, a name, and coordinates in range where it has any;
    of repeated ids the first in the order of the whole record stays."""
    from parvis.operators.dedupe import keep_first

    raw = spark.read.schema(CHURCH).option("multiLine", True).json(path)
    lat, lon = F.col("location.latitude"), F.col("location.longitude")
    bad = F.coalesce(F.trim("id") == "", F.lit(True)) | F.coalesce(F.trim("name") == "", F.lit(True)) | F.coalesce(~lat.between(-90, 90) | ~lon.between(-180, 180), F.lit(False))
    good = raw.where(~bad)
    return keep_first(good, ["id"], [F.to_json(F.struct(*raw.columns))]).select(raw.columns), raw.where(bad)


def strict_csv(spark: SparkSession, path: str, schema: str, *, sep: str = ",", header: bool = True) -> DataFrame:
    """Quoted CSV with embedded line breaks; a broken quote is an error."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=True)


def lines(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Delimited lines that never fail: missing columns are null, surplus ones are dropped."""
    parts = F.split("value", "\\Q" + sep + "\\E")
    return spark.read.text(path).where("trim(value) != ''").select(*[F.get(parts, i).alias(c) for i, c in enumerate(columns)])


def saved_places(spark: SparkSession, folder: str, lists: list[str] | None = None) -> DataFrame:
    """(list, title, note, url, comment) of all saved lists of a folder; headers may be in either language, with or without a
    byte-order mark. ``lists`` restricts to lists by file name."""
    heads = {"title": ("タイトル", "title"), "note": ("メモ", "note"), "url": ("url",), "comment": ("コメント", "comment")}
    raw = spark.read.csv(folder, header=False, quote='"', escape='"', multiLine=True).withColumn("list", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))
    raw = raw.withColumn("list", F.expr("try_url_decode(list)"))
    if lists is not None:
        raw = raw.where(F.col("list").isin(lists))
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "﻿", "")))
    cells = [c for c in raw.columns if c.startswith("_c")]
    known = F.array(*[F.lit(h) for names in heads.values() for h in names])
    is_head = F.array_contains(known, plain(F.col("_c0"))) & F.exists(F.array(*[plain(F.col(c)) for c in cells]), lambda x: x == "url")
    head = raw.where(is_head).groupBy("list").agg(F.first(F.array(*[plain(F.col(c)) for c in cells])).alias("head"))
    joined = raw.where(~is_head).join(head, "list")

    def pick(names: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("string")
        for i, c in enumerate(cells):
            out = F.when(F.get("head", F.lit(i)).isin(list(names)), F.col(c)).otherwise(out)
        return out

    return joined.select("list", *[pick(names).alias(k) for k, names in heads.items()])


def geonames_dump(spark: SparkSession, path: str, country: str = "JP") -> DataFrame:
    """Populated places, areas and religious sites of a country, with a rank: population, then class and code."""
    raw = spark.read.schema(GEONAMES_DUMP).csv(path, sep="\t", quote="")
    kept = raw.where((F.col("country_code") == country) & (F.col("feature_class").isin("A", "P") | ((F.col("feature_class") == "S") & F.col("feature_code").isin("CH", "MSTY", "CTRR"))))
    rank = F.coalesce(F.expr("try_cast(population as double)"), F.lit(0.0)) + F.when(F.col("feature_class") == "P", 1e10).when(F.col("feature_class") == "A", 5e9).otherwise(0.0) + F.when(F.col("feature_code") == "PPLC", 2e9).when(F.col("feature_code").isin("ADM1", "ADM2", "ADM3", "ADM4"), 1e9).otherwise(0.0)
    return kept.withColumn("rank", rank)


def best_alternate_names(places: DataFrame, alternates: DataFrame, languages: list[str]) -> DataFrame:
    """(geonameid, language, name): the best alternate name per place and language; historic ones are left out."""
    flag = lambda c: F.coalesce(F.col(c) == "1", F.lit(False)).cast("double")
    score = F.col("rank") + 1e12 * flag("isPreferred") + 1e11 * flag("isShort") - 1e10 * flag("isColloquial")
    own = alternates.where(F.col("isolanguage").isin(languages) & ~F.coalesce(F.col("isHistoric") == "1", F.lit(False)))
    met = own.join(places.select("geonameid", "rank"), "geonameid").withColumn("score", score)
    return met.groupBy("geonameid", F.col("isolanguage").alias("language")).agg(F.max_by("name", F.struct("score", -F.length("name"), -F.col("alternateNameId").cast("long"))).alias("name"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of a dictionary file: comments and blank lines out; a repeated source is an error."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("v")).where("trim(v) != '' and not startswith(trim(v), '#')")
    parts = F.split("v", ",", 2)
    rows = raw.select(F.trim(F.get(parts, 0)).alias("source"), F.trim(F.get(parts, 1)).alias("target"))
    repeated = rows.groupBy("source").count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError("repeated sources: " + ", ".join(r["source"] for r in repeated))
    return rows


def social_exports(spark: SparkSession, *, youtube: str | None = None, instagram: str | None = None, facebook: str | None = None, x: str | None = None) -> DataFrame:
    """(platform, id, url, accountName, description) of account exports, each account once."""
    from functools import reduce

    from parvis.functions import url as U
    from parvis.operators.dedupe import keep_first

    none = F.lit(None).cast("string")
    parts = []
    if youtube:
        raw = strict_csv(spark, youtube, "id STRING, url STRING, title STRING")
        parts.append(raw.select(F.lit("YOUTUBE").alias("platform"), "id", "url", F.col("title").alias("accountName"), none.alias("description")))
    if instagram:
        raw = spark.read.option("multiLine", True).schema("relationships_following ARRAY<STRUCT<title STRING, string_list_data ARRAY<STRUCT<href STRING, value STRING>>>>").json(instagram)
        each = raw.select(F.explode("relationships_following").alias("r")).select("r.title", F.explode("r.string_list_data").alias("s"))
        parts.append(each.select(F.lit("INSTAGRAM").alias("platform"), F.coalesce("s.value", "title").alias("id"), F.col("s.href").alias("url"), F.coalesce("title", "s.value").alias("accountName"), none.alias("description")))
    if facebook:
        from parvis.functions.text import read_as_utf8

        raw = spark.read.option("multiLine", True).schema("pages_followed_v2 ARRAY<STRUCT<title STRING, data ARRAY<STRUCT<name STRING>>>>").json(facebook)
        each = raw.select(F.explode("pages_followed_v2").alias("r")).select(F.coalesce(F.col("r.data")[0]["name"], F.col("r.title")).alias("n"))
        parts.append(each.select(F.lit("FACEBOOK").alias("platform"), none.alias("id"), none.alias("url"), read_as_utf8(F.col("n")).alias("accountName"), none.alias("description")))
    if x:
        raw = spark.read.option("multiLine", True).schema("screen_name STRING, name STRING, description STRING").json(x)
        parts.append(raw.select(F.lit("X").alias("platform"), F.col("screen_name").alias("id"), F.concat(F.lit("https://x.com/"), "screen_name").alias("url"), F.col("name").alias("accountName"), "description"))
    rows = reduce(DataFrame.unionByName, parts).withColumn("identity", F.coalesce(U.link_fold(F.col("url")), F.col("id"), F.col("accountName")))
    return keep_first(rows, ["platform", "identity"], [F.to_json(F.struct("id", "url", "accountName", "description"))]).drop("identity")
