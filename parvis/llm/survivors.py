"""The surviving record of each duplicate group: votes on values, field by field.

Fields are unpivoted to long rows (group, field, value). Every row is a vote of weight trust * decay(age) for its normalised
value; votes are summed per value, the winner of each field is taken by max_by, and the winners are pivoted back. Both sums and
max_by combine map-side, so a group of any size is reduced in place: no window, no sort, no task that holds a group.

With a half-life the score of a value is the sum of its votes, and age runs from the latest time of the table. With
``half_life_days=None`` the half-life tends to zero: the latest vote outweighs all older ones together, so values compare by
their latest vote first and by the sum of trust after it. Rows without a readable time vote after all others, by the second
time. Ties are broken by trust, the second time and the row key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from parvis.llm.congregations import SHARED_HOSTS


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s　 ]+|[\s　 ]+$", "")


def readable_time(c: Column) -> Column:
    """ISO-like date and time, with or without zone; anything else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(c))


def web_address(c: Column) -> Column:
    """The value as written where it is a web address other than a map or social-network link, else null."""
    host = F.regexp_extract(F.lower(trimmed(c)), r"^https?://(?:[^/@\s]*@)?([a-z0-9\-]+(?:\.[a-z0-9\-]+)+)(?::\d+)?(?:[/?#]\S*)?$", 1)
    return F.when((host != "") & ~host.rlike(SHARED_HOSTS), c)


def votes(rows: DataFrame, fields: Mapping[str, tuple[Column, Column]], *, group: str, time: Column, second_time: Column, key: Column, trust: Column | None = None) -> DataFrame:
    """Long rows (group, field, value, norm, trust, readable, at, second, key) of the usable values.

    fields: name -> (value to keep, normalised value that votes are summed over); null where a row has no usable value.
    """
    weight = trust if trust is not None else F.lit(1.0)
    each = F.array(*[F.struct(F.lit(f).alias("field"), value.cast("string").alias("value"), norm.cast("string").alias("norm")) for f, (value, norm) in fields.items()])
    long = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.explode(each).alias("v"), weight.cast("double").alias("trust"), time.alias("at"), second_time.alias("second"), key.alias("key"))
    return long.select("group", "v.*", "trust", F.col("at").isNotNull().alias("readable"), "at", "second", "key").where("value is not null and norm is not null")


def winners(long: DataFrame, half_life_days: float | None = None) -> DataFrame:
    """(group, field, value, votes): the value with the highest score of each field."""
    lead = F.struct("readable", "at", F.when(~F.col("readable"), F.col("second")).alias("late"), "trust", "second", "key")
    if half_life_days is None:
        weight = F.col("trust")
    else:
        newest = long.agg(F.max(F.coalesce("at", "second"))).first()[0]
        age = (F.lit(newest).cast("double") - F.coalesce("at", "second").cast("double")) / 86400
        weight = F.col("trust") * F.pow(F.lit(0.5), age / half_life_days) * F.when(F.col("readable"), 1.0).otherwise(0.5)
    summed = long.groupBy("group", "field", "norm").agg(F.sum(weight).alias("votes"), F.max(F.struct(lead.alias("lead"), "value")).alias("top"))
    rank = F.struct("top.lead", "votes") if half_life_days is None else F.struct("votes", "top.lead")
    best = summed.groupBy("group", "field").agg(F.max_by(F.struct("top.value", "votes"), rank).alias("b"))
    return best.select("group", "field", "b.value", "b.votes")


def union_values(rows: DataFrame, *, group: str, values: str, field: str) -> DataFrame:
    """(group, field, value): every distinct non-blank element of an array column, outer blanks removed."""
    each = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.lit(field).alias("field"), F.explode(values).alias("value"))
    return each.select("group", "field", trimmed(F.col("value")).alias("value")).where("value != ''").distinct()


def place_survivors(candidates: DataFrame, denominations: DataFrame) -> DataFrame:
    """(group, field, value) for every map id on two or more rows: websiteUrl, denominationHint and each of sourceLists.

    Null map ids form no group; a field without a usable value has no row; repeated rows count as rows; other columns are ignored.
    """
    hint = F.lower(trimmed(F.col("denominationHint")))
    meanings = denominations.select(F.col("denominationId").alias("meant"), F.explode(F.array(F.lower(trimmed(F.col("denominationId"))), F.lower(trimmed(F.col("name"))))).alias("hint")).where("hint is not null").groupBy("hint").agg(F.min("meant").alias("meant"))
    own = candidates.select("place_row_id", "googleCid", "websiteUrl", "resolvedAt", "ingested_at", "sourceLists", hint.alias("hint"))
    rows = own.join(meanings, "hint", "left")
    site = web_address(F.col("websiteUrl"))
    fields = {"websiteUrl": (site, F.lower(trimmed(site))), "denominationHint": (F.col("meant"), F.col("meant"))}
    long = votes(rows, fields, group="googleCid", time=readable_time(F.col("resolvedAt")), second_time=F.col("ingested_at"), key=F.col("place_row_id"))
    repeated = candidates.where("googleCid is not null").groupBy(F.col("googleCid").alias("group")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    chosen = winners(long).select("group", "field", "value").unionByName(union_values(candidates, group="googleCid", values="sourceLists", field="sourceLists"))
    return chosen.join(repeated, "group", "left_semi")


def records(chosen: DataFrame) -> DataFrame:
    """One record per group: the chosen values pivoted back, lists as sorted arrays."""
    one = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
    return chosen.groupBy("group").agg(one("websiteUrl"), one("denominationHint"), F.sort_array(F.collect_set(F.when(F.col("field") == "sourceLists", F.col("value")))).alias("sourceLists"))
