"""What the catalog is written as: an index by language, a logical export, page models, manifests to check before serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parvis.operators import search
from parvis.operators.dedupe import content_hash


def write_index(docs: DataFrame, path: str, *, key: str, fields: list[str], language: str) -> None:
    """Postings and statistics as parquet, partitioned by language, so that a search reads one language's files."""
    langs = docs.select(F.col(key).alias("doc"), F.col(language).alias("lang"))
    search.postings(docs, key, fields).join(langs, "doc").repartition("lang", "term").write.mode("overwrite").partitionBy("lang").parquet(f"{path}/postings")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.size(search.tokens(F.col(f))).alias("length")) for f in fields])
    stats = docs.select(F.col(language).alias("lang"), F.explode(each).alias("x")).where("x.length >= 0").groupBy("lang", "x.field").agg(F.count("*").alias("documents"), F.avg("x.length").alias("mean_length"))
    stats.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/statistics")


def logical_export(rows: DataFrame, path: str, *, key: str) -> dict:
    """Rows as JSON lines in key order over range partitions, and a manifest of count and order-independent hash."""
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    h = content_hash(rows, [F.col(c) for c in sorted(rows.columns)]).first()
    return {"rows": h["rows"], "hash": h["hash"]}


def page_models(churches: DataFrame, languages: list[str], *, key: str, name: Column, localised: dict[str, Column]) -> DataFrame:
    """(key, language, path, title): one page per church and language; titles fall back to the plain name."""
    each = F.array(*[F.struct(F.lit(x).alias("language"), F.coalesce(localised.get(x, F.lit(None).cast("string")), name).alias("title")) for x in languages])
    return churches.select(F.col(key).alias("key"), F.explode(each).alias("p")).select("key", "p.language", F.concat(F.lit("/"), "p.language", F.lit("/churches/"), F.col("key"), F.lit("/")).alias("path"), "p.title")


def stale_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of an earlier site that the new one doesn't have."""
    return before.select("path").join(after.select("path"), "path", "left_anti")


def servable(manifest: dict, expected: dict) -> list[str]:
    """Reasons not to serve a snapshot: every field that must agree and doesn't; empty when it may be served."""
    return [f"{k}: {manifest.get(k)!r} is not {v!r}" for k, v in expected.items() if manifest.get(k) != v]
