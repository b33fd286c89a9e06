"""Keep-first, merges of duplicates, hashes and checks of uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in an explicit order; combinable arg-min, so that a hot key is reduced map-side."""
    packed = rows.select(*by, F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)]).alias("_order"), F.struct(*rows.columns).alias("_row"))
    return packed.groupBy(*by).agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def merge_duplicates(rows: DataFrame, by: list[str], *, union: list[str] = (), first: list[tuple[str, Column]] = (), order: Column) -> DataFrame:
    """One row per key: array columns united and sorted, other columns by their first non-null value in the given order."""
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(u), F.array().cast("array<string>")))))).alias(u) for u in union]
    aggs += [F.min_by(c, F.when(c.isNotNull(), order)).alias(name) for name, c in first]
    return rows.groupBy(*by).agg(*aggs)


def unique_gate(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value of each key that has exactly one distinct value; other keys are left out."""
    return rows.groupBy(*by).agg(F.min(value).alias(value), F.max(value).alias("_most")).where(F.col(value) == F.col("_most")).drop("_most")


def duplicates(rows: DataFrame, by: list[str], key: str, sample: int = 20) -> DataFrame:
    """Keys on more than one row, with the surplus and the first row keys. Of a hot key each task keeps ``sample`` rows only."""
    counted = rows.groupBy(*by, key).agg(F.count("*").alias("c"))
    copies = counted.groupBy(*by).agg(F.sum("c").alias("copies")).where("copies > 1")
    few = top_per_group(counted, by, [F.col(key)], sample).where(F.col(key).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(key)).alias("sample"))
    same = [F.col(f"c.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by]
    joined = copies.alias("c").join(few.alias("s"), reduce(lambda x, y: x & y, same), "left")
    return joined.select(*[f"c.{b}" for b in by], "c.copies", F.coalesce("s.sample", F.array()).alias("sample"))


def row_hash(columns: list[Column]) -> Column:
    """Hash of one record as JSON with explicit nulls."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def content_hash(rows: DataFrame, columns: list[Column], digits: int = 3) -> DataFrame:
    """(hash, rows): one hash for a table that doesn't depend on row order.

    Rows are hashed, hashes put into buckets by their first hex digits, each bucket hashed in sorted order, then the buckets. No
    task holds more than one of 16 ** digits buckets of hashes; repeated rows count.
    """
    hashed = rows.select(row_hash(columns).alias("h"))
    inner = hashed.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return inner.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps only k per group and task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def winner_margin(rows: DataFrame, by: list[str], score: str, tie: list[str], margin: float) -> DataFrame:
    """The best row of each group where it leads the runner-up by the margin, else no row. Two rows a group are kept map-side."""
    window = Window.partitionBy(*by).orderBy(F.col(score).desc(), *tie)
    two = rows.withColumn("_rank", F.row_number().over(window)).where("_rank <= 2")
    second = F.max(F.when(F.col("_rank") == 2, F.col(score))).over(Window.partitionBy(*by))
    return two.withColumn("runner_up", second).where("_rank = 1").drop("_rank").where(F.col("runner_up").isNull() | (F.col(score) - F.col("runner_up") >= margin))


def round_robin(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Turn of each row: the first of every group, then the second of every group, and so on.

    Rows are spread by ranges of (group, order) and ranked within each range; a range's rank starts after the rows of its
    group in the ranges before it. So a group that holds a third of all rows is ranked by many tasks.
    """
    from parvis.session import cut

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumn("_order", F.struct(*order))
    ranged = cut(named.repartitionByRange(parts, F.col(group), F.col("_order")).withColumn("_range", F.spark_partition_id()))
    inner = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_range").orderBy("_order")))
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_ahead"))
    met = inner.join(ahead, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return met.select(*rows.columns, (F.col("_ahead") + F.col("_rank")).cast("int").alias("turn"))
