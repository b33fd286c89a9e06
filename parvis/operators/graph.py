"""The catalog as nodes and edges, and changes to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def nodes(rows: DataFrame, key: Column, label: str, **properties: Column) -> DataFrame:
    """(id, label, properties MAP): one row per distinct id, properties as text."""
    items = [x for name, c in properties.items() for x in (F.lit(name), c.cast("string"))]
    return rows.select(key.cast("string").alias("id"), F.lit(label).alias("label"), F.create_map(*items).alias("properties") if items else F.create_map().cast("map<string,string>").alias("properties")).where("id is not null").groupBy("id", "label").agg(F.max_by("properties", F.to_json("properties")).alias("properties"))


def edges(rows: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return rows.select(source.cast("string").alias("source"), target.cast("string").alias("target"), F.lit(kind).alias("type")).where("source is not null and target is not null").distinct()


def link_edges(pages: DataFrame, *, url: str, links: str, fold) -> DataFrame:
    """(source, target) of the links between pages, folded, without links of a page to itself."""
    return pages.where(F.col(links).isNotNull()).select(fold(F.col(url)).alias("source"), F.explode(links).alias("l")).select("source", fold(F.col("l")).alias("target")).where("target != '' and source != target").distinct()


def undiscovered(links: DataFrame, known: DataFrame, *, url: Column) -> DataFrame:
    """Link targets that are no known page."""
    return links.select("target").distinct().join(known.select(url.alias("target")).distinct(), "target", "left_anti")


def orphans(all_nodes: DataFrame, all_edges: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes of the labels that no edge points to."""
    return all_nodes.where(F.col("label").isin(labels)).join(all_edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def counts(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes per label and edges per type."""
    return all_nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n")).unionByName(all_edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of the changes over rows of the current table, non-null values of a change winning; other rows stay."""
    cols = [c for c in current.columns if c != key]
    a = current.select(key, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = changes.select(key, *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in cols])


def replace_slice(current: DataFrame, fresh: DataFrame, *, source: str) -> DataFrame:
    """All rows but those of the sources that the fresh rows come from, plus the fresh rows, each once."""
    return current.join(fresh.select(source).distinct(), source, "left_anti").select(current.columns).unionByName(fresh.select(current.columns)).distinct()


def union_first(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Union of sources in order of precedence; the first row of each key stays."""
    from parvis.operators.dedupe import keep_first

    marked = reduce(DataFrame.unionByName, [p.withColumn("_source", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in marked.columns if c not in (*by, "_source")]
    return keep_first(marked, by, [F.col("_source"), *[F.to_json(F.struct(*rest))]]).drop("_source")


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): missing, extra and changed rows, with the names of the fields that differ."""
    a = old.select(key, F.lit(True).alias("_old"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = new.select(key, F.lit(True).alias("_new"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields]))
    state = F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "extra").when(F.size(changed) > 0, "changed")
    return both.select(key, state.alias("change"), F.when(state == "changed", F.array_join(changed, ",")).otherwise("").alias("fields")).where("change is not null")
