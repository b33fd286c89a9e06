"""What to do again and what to keep: freshness, manifests, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def is_fresh(fetched: Column, now: Column, days: int = 30) -> Column:
    """Fetched within the last days; a time in the future or an unknown one is stale."""
    age = now.cast("double") - fetched.cast("double")
    return F.coalesce((age >= 0) & (age < days * 86400), F.lit(False))


def is_fresh_listing(fetched: Column, now: Column, days: int = 30) -> Column:
    """For directory listings: a time in the future counts as fresh, an unknown one as stale."""
    return F.coalesce(fetched.cast("double") >= now.cast("double") - days * 86400, F.lit(False))


def merge_manifest(old: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows, and old rows that weren't fetched again."""
    return old.join(fresh.select(*key).distinct(), key, "left_anti").select(fresh.columns).unionByName(fresh)


def split_reuse(inputs: DataFrame, cache: DataFrame, *, key: str, text: str, version: str) -> DataFrame:
    """(key, action): reuse where the cache holds the same text under the same version, refresh where it holds another, new else."""
    c = cache.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col("version").alias("_v"))
    joined = inputs.join(c, inputs[key] == F.col("_k"), "left")
    action = F.when(F.col("_k").isNull(), "new").when(F.col("_t").eqNullSafe(F.col(text)) & (F.col("_v") == version), "reuse").otherwise("refresh")
    return joined.select(key, action.alias("action"))


def content_store(pages: DataFrame, content: str) -> DataFrame:
    """(hash, copies, length): one row per distinct content, addressed by its hash."""
    return pages.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("hash")).agg(F.count("*").alias("copies"), F.max(F.length(content)).alias("length"))
