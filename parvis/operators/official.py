"""Denominations from official lists, names, pages and models, with an audit row for every change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parvis.operators.resolve import cascade, mutual_best
from parvis.session import cut

UNKNOWN = "NOT_DETERMINED"


def reconcile(churches: DataFrame, matches: DataFrame, authoritative: DataFrame) -> DataFrame:
    """(church, before, after, status, score): labels set by one-to-one matches with official lists.

    churches (church BIGINT, denomination, human), matches (church, entry BIGINT, denomination, score), authoritative
    (denomination). Human labels stay and take their entry first; other churches take entries by falling score, the current
    label first among equals. A label of an authoritative list without a match is removed.
    """
    matches = cut(matches)  # read three times, and often dear
    human = churches.where("human is not null").select("church", "human")
    fixed = matches.join(human, "church").where("denomination = human").groupBy("church").agg(F.max_by(F.struct("entry", "score"), F.struct("score", -F.col("entry"))).alias("m")).select("church", "m.entry", "m.score")
    open_ = matches.join(human.select("church"), "church", "left_anti").join(fixed.select("entry"), "entry", "left_anti")
    own = open_.join(churches.select("church", F.col("denomination").alias("current")), "church")
    ranked = own.withColumn("score2", F.col("score") + F.when(F.col("denomination") == F.col("current"), 1e-9).otherwise(0.0))
    assigned = mutual_best(ranked.select(F.col("church").alias("a"), F.col("entry").alias("b"), F.col("score2").alias("score"))).select(F.col("a").alias("church"), F.col("b").alias("entry"))
    taken = assigned.join(matches, ["church", "entry"]).select("church", F.col("denomination").alias("official"), "score")
    listed = authoritative.select("denomination").distinct().withColumn("listed", F.lit(True))
    full = churches.join(taken, "church", "left").join(listed, "denomination", "left")
    status = (
        F.when(F.col("human").isNotNull(), "human kept")
        .when(F.col("official").isNotNull() & (F.col("official") == F.col("denomination")), "confirmed")
        .when(F.col("official").isNotNull(), "assigned")
        .when(F.coalesce("listed", F.lit(False)), "removed")
        .otherwise("unchanged")
    )
    after = F.when(status == "human kept", F.col("human")).when(status == "removed", None).otherwise(F.coalesce("official", "denomination"))
    return full.select("church", F.col("denomination").alias("before"), after.alias("after"), status.alias("status"), "score")


def determine(churches: DataFrame, overrides: DataFrame, by_name: DataFrame, by_page: DataFrame, by_list: DataFrame) -> DataFrame:
    """(church, before, after, confidence, source): denomination by precedence.

    The last override wins, then a stored human label, then a name that says otherwise than the label, then the label, then
    names, pages and lists. churches (church, denomination, human); overrides (church, value, position); the others
    (church, value[, confidence]).
    """
    last = overrides.groupBy("church").agg(F.max_by("value", "position").alias("override"))
    joined = churches.join(last, "church", "left")
    for df, name in ((by_name, "named"), (by_page, "paged"), (by_list, "on_list")):
        joined = joined.join(df.groupBy("church").agg(F.min("value").alias(name)), "church", "left")
    label = F.when(F.coalesce(F.col("denomination"), F.lit(UNKNOWN)) != UNKNOWN, F.col("denomination"))
    stored = F.when(F.col("human").isNotNull() & label.isNotNull(), label)
    stale = F.when(label.isNotNull() & (F.col("named") != label), F.col("named"))
    value, confidence, source = cascade([("override", F.col("override"), F.lit(1.0)), ("human", stored, F.lit(1.0)), ("name corrects", stale, F.lit(0.95)), ("label", label, F.lit(1.0)), ("name", F.col("named"), F.lit(0.95)), ("page", F.col("paged"), F.lit(0.93)), ("list", F.col("on_list"), F.lit(0.95))])
    return joined.select("church", F.col("denomination").alias("before"), value.alias("after"), confidence.alias("confidence"), source.alias("source"))


def best_of_chunks(guesses: DataFrame, *, key: str, tie: float = 0.05) -> DataFrame:
    """(key, value, score, conflict): best guess over the chunks of a text; a rival value within the tie is a conflict."""
    per_value = guesses.groupBy(key, "value").agg(F.max("score").alias("score"))
    top = per_value.groupBy(key).agg(F.max_by("value", F.struct("score", "value")).alias("value"), F.max("score").alias("score"), F.count("*").alias("n"), F.sort_array(F.collect_list("score"), False).alias("all"))
    return top.select(key, "value", "score", F.coalesce(F.get("all", F.lit(0)) - F.get("all", F.lit(1)) < tie, F.lit(False)).alias("conflict"))
