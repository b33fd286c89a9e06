"""Linking social accounts to churches by a cascade of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parvis.functions import similarity
from parvis.operators.dedupe import top_per_group, winner_margin
from parvis.operators.resolve import among_gram_candidates, containing_names, similar_names
from parvis.session import cut, large


def link_accounts(accounts: DataFrame, churches: DataFrame, links: DataFrame, *, shortlist: int = 3, threshold: float = 0.80, margin: float = 0.05, score: Column | None = None) -> DataFrame:
    """(account, church, source, score): every account by the first evidence that holds.

    accounts (account, name, url), churches (church, name), links (church, url), names in normal form, urls folded. A church
    whose pages link to the account wins at 1.0; then all names that are equal or contain each other; then, of the three
    churches with the best name scores of all, the one whose score reaches the threshold and leads by the margin. ``score`` replaces the name
    score by a model's, over columns x and y.
    """
    direct = accounts.join(links, "url").select("account", "church", F.lit("page link").alias("source"), F.lit(1.0).alias("score")).distinct()
    direct = cut(direct)
    rest = accounts.join(direct.select("account").distinct(), "account", "left_anti")
    named, known = rest.select(F.col("account").alias("a"), F.col("name").alias("x")), churches.select(F.col("church").alias("b"), F.col("name").alias("y"))
    holds = named.join(containing_names(named.select("x"), known.select("y")), "x").join(known, "y")
    containing = holds.select(F.col("a").alias("account"), F.col("b").alias("church"), F.lit("name").alias("source"), F.lit(1.0).alias("score"))
    containing = cut(containing)
    open_ = named.join(containing.select(F.col("account").alias("a")).distinct(), "a", "left_anti")
    least = 0.25 if score is not None else max(0.25, threshold)  # without a model lower scores can't be accepted
    scored = open_.join(similar_names(open_.select("x"), known.select("y"), least), "x").join(known, "y")
    few = top_per_group(scored, ["a"], [F.col("name_score").desc(), F.col("b")], shortlist).drop("rank").withColumn("score", score if score is not None else F.col("name_score")).where(F.col("score") >= threshold)
    won = winner_margin(few, ["a"], "score", ["b"], margin).select(F.col("a").alias("account"), F.col("b").alias("church"), F.lit("score").alias("source"), "score")
    return direct.unionByName(containing).unionByName(won)


def merge_estimates(accounts: DataFrame, churches: DataFrame, *, least: float = 0.82, margin: float = 0.08) -> DataFrame:
    """(account, church, kind, score): exact names, and estimates for review only, of the best of up to 80 candidates.

    A name that holds the other with both at least four characters counts 0.94; an estimate needs ``least`` and the margin.
    """
    exact = accounts.join(large(churches), accounts["name"] == churches["name"]).select("account", "church", F.lit("exact").alias("kind"), F.lit(1.0).alias("score"))
    rest = cut(accounts.join(large(exact.select("account").distinct()), "account", "left_anti"))
    named, known = rest.select(F.col("account").alias("a"), F.col("name").alias("x")), churches.select(F.col("church").alias("b"), F.col("name").alias("y"))
    # only pairs that reach ``least`` need their rank among the candidates
    holds = containing_names(named.select("x"), known.select("y")).where(F.least(F.length("x"), F.length("y")) >= 4).select("x", "y", F.lit(0.94).alias("score"))
    alike = similar_names(named.select("x"), known.select("y"), least).select("x", "y", F.col("name_score").alias("score"))
    # a pair that holds counts 0.94 whatever its likeness
    pairs = cut(holds.withColumn("h", F.lit(True)).unionByName(alike.withColumn("h", F.lit(False))).groupBy("x", "y").agg(F.max_by("score", "h").alias("score")).where(F.col("score") >= least))
    scored = large(cut(large(among_gram_candidates(pairs, known)).join(large(pairs), ["x", "y"]))).join(large(named), "x")
    best = winner_margin(scored, ["a"], "score", ["b"], margin).select(F.col("a").alias("account"), F.col("b").alias("church"), F.lit("estimated").alias("kind"), "score")
    return exact.unionByName(best)
