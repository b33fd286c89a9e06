"""Checks on a catalog: one row per check with the violations and a few samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def check(name: str, rows: DataFrame, bad: Column, key: str, sample: int = 20) -> DataFrame:
    """(name, violations, samples) of a row predicate; samples are the smallest keys, kept bounded while aggregating."""
    marked = rows.where(bad).select(F.col(key).cast("string").alias("k"))
    few = marked.orderBy("k").limit(sample).agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("samples"))
    return marked.agg(F.count("*").alias("violations")).crossJoin(few).select(F.lit(name).alias("name"), "violations", F.coalesce("samples", F.lit("")).alias("samples"))


def check_unique(name: str, rows: DataFrame, by: list[str], sample: int = 20) -> DataFrame:
    """Violations of uniqueness: surplus rows, with the first repeated keys."""
    repeated = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])).groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").withColumn("k", F.concat_ws("|", *by))
    few = repeated.orderBy("k").limit(sample).agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("samples"))
    return repeated.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).crossJoin(few).select(F.lit(name).alias("name"), "violations", F.coalesce("samples", F.lit("")).alias("samples"))


def check_reference(name: str, rows: DataFrame, column: str, targets: DataFrame, target: str, key: str) -> DataFrame:
    """Rows whose reference isn't null and isn't in the target table."""
    lost = rows.where(F.col(column).isNotNull()).join(targets.select(F.col(target).alias(column)).distinct(), column, "left_anti")
    return check(name, lost, F.lit(True), key)


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def validate_dictionary(entries: DataFrame) -> DataFrame:
    """(source, problem) of dictionary rows (source, target): blank, padded, repeated or circular ones."""
    padded = entries.where("source != trim(source) or target != trim(target)").select("source", F.lit("padded").alias("problem"))
    blank = entries.where("trim(source) = '' or trim(target) = ''").select("source", F.lit("blank").alias("problem"))
    repeated = entries.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source", F.lit("repeated").alias("problem"))
    a, b = entries.select("source", "target").distinct(), entries.select(F.col("source").alias("target"), F.col("target").alias("back")).distinct()
    circular = a.join(b, "target").where("back = source").select("source", F.lit("circular").alias("problem")).distinct()
    return padded.unionByName(blank).unionByName(repeated).unionByName(circular).distinct()
