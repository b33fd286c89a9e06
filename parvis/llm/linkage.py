"""Records of the same thing in two tables without a common id: heuristic votes and a generative label model.

Candidates meet by equi-joins on exploded forms of name, plot, host and map cell. On each candidate, matching functions vote;
their outcomes are counted per pattern, which is all that reaches the driver, and at most the product of the outcome counts
whatever the number of candidates. Expectation-maximization learns how often each function gives each outcome for matches and
for others. Functions that stay correlated given the match (by their conditional mutual information) are merged into one joint
function, so that two views of one fact don't count twice. The result is a posterior confidence for every candidate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from parvis.llm import congregations as C
from parvis.operators.spatial import haversine_km
from parvis.session import cut, large

#: Name, number of outcomes, and the starting weights of the outcomes for matches and for others.
FUNCTIONS: tuple[tuple[str, tuple[float, ...], tuple[float, ...]], ...] = (
    ("name", (84, 9, 6, 1), (25, 5, 30, 40)),  # a form shared, shared but for a slip, alike, other
    ("place", (55, 42, 3), (10, 40, 50)),  # same, unknown, contradicting
    ("kind", (60, 35, 5), (40, 35, 25)),
    ("address", (60, 10, 10, 19, 1), (4, 4, 45, 12, 35)),  # same plot, same town, same area, unknown, other area
    ("distance", (45, 20, 8, 2, 25), (4, 3, 10, 58, 25)),  # < 100 m, < 600 m, < 3 km, more, unknown
    ("host", (30, 5, 65), (1, 34, 65)),  # same, other, unknown
    ("rare", (60, 28, 12), (30, 35, 35)),  # the shared form occurs for one place only, for more, no form shared
)


def _more_forms(rows: DataFrame, neighbours: bool) -> DataFrame:
    """(entity, hash): host with town, plot or beginning of the name, and map cell with beginning or end of the name."""
    c = F.col
    near = F.array(F.lit(-1), F.lit(0), F.lit(1)) if neighbours else F.array(F.lit(0))
    spot = c("latitude").isNotNull() & c("longitude").isNotNull() & c("main").isNotNull()
    ends = F.array(F.substring("main", 1, 4), F.concat(F.lit("$"), F.expr("right(main, 4)")))
    cells = F.flatten(F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.transform(ends, lambda e: F.xxhash64(F.lit("cell"), F.floor(c("latitude") / 0.004) + i, F.floor(c("longitude") / 0.005) + j, e))))))
    hosts = F.array(*[F.when(c("host").isNotNull() & x.isNotNull(), F.xxhash64(F.lit(n), "host", x)) for n, x in (("t", F.concat("area", "town")), ("p", c("plot")), ("n", F.substring("main", 1, 4)))])
    return rows.select("entity", F.explode(F.array_distinct(F.concat(hosts, F.when(spot, cells).otherwise(F.array().cast("array<bigint>"))))).alias("h")).where("h is not null")


def candidates(met: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Entity pairs (a, b, how, spread) whose names meet, or that share a host or a spot and part of the name (how null)."""
    other = _more_forms(left, True).withColumnRenamed("entity", "a").join(large(_more_forms(right, False).withColumnRenamed("entity", "b")), "h").select("a", "b", F.lit(None).cast("int").alias("how"), F.lit(None).cast("bigint").alias("spread"))
    return met.unionByName(other).groupBy("a", "b").agg(F.max("how").alias("how"), F.min("spread").alias("spread"))


def votes(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds pattern: the outcomes of FUNCTIONS as one mixed-radix number."""
    wide = C.with_profiles(pairs, left, right)
    c = F.col
    eq = lambda x: F.coalesce(c(f"a_{x}") == c(f"b_{x}"), F.lit(False))
    known = lambda x: c(f"a_{x}").isNotNull() & c(f"b_{x}").isNotNull()
    plot = eq("plot") | C.same_numbers("a", "b")
    km = haversine_km(c("a_latitude"), c("a_longitude"), c("b_latitude"), c("b_longitude"))
    outcomes = (
        F.when(c("how") >= 2, 0).when(c("how") == 1, 1).when(C.close_names(), 2).otherwise(3),
        F.when(c("how") == 4, 0).when(c("how") == 2, 2).otherwise(1),
        F.when(eq("kind"), 0).when(known("kind"), 2).otherwise(1),
        F.when(plot, 0).when(eq("town") & eq("area"), 1).when(eq("area"), 2).when(known("area"), 4).otherwise(3),
        F.when(km < 0.1, 0).when(km < 0.6, 1).when(km < 3, 2).when(km.isNotNull(), 3).otherwise(4),
        F.when(eq("host"), 0).when(known("host"), 1).otherwise(2),
        F.when(c("spread") <= 1, 0).when(c("spread").isNotNull(), 1).otherwise(2),
    )
    number = F.lit(0)
    for (_, m, _), outcome in zip(FUNCTIONS, outcomes):
        number = number * len(m) + outcome
    return wide.select("a", "b", number.alias("pattern"))


def fit(counts: dict[int, int], share: float = 0.3, rounds: int = 100, trust: float = 0.3, merge_over: float = 0.05) -> dict[int, float]:
    """Posterior of a match for each pattern.

    The starting rates and share stay in with the weight of ``trust`` times the candidates, so that few candidates, or candidates of
    one kind only, don't pull the two classes apart within the matches.
    """
    sizes = [len(f[1]) for f in FUNCTIONS]
    patterns = np.array(sorted(counts), np.int64)
    if not len(patterns):
        return {}
    weight = np.array([counts[int(p)] for p in patterns], float)
    outcomes, rest = [], patterns.copy()
    for k in reversed(sizes):
        outcomes.insert(0, rest % k)
        rest //= k
    prior = [np.stack([np.array(m, float) / sum(m), np.array(u, float) / sum(u)]) for _, m, u in FUNCTIONS]
    post = _em(outcomes, prior, weight, share, rounds, trust)
    merged: set[int] = set()
    pairs = []
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            pairs.append((_dependence(outcomes[i], outcomes[j], sizes[i], sizes[j], post, weight), i, j))
    groups: list[tuple[int, ...]] = []
    for d, i, j in sorted(pairs, reverse=True):
        if d > merge_over and not {i, j} & merged:
            merged |= {i, j}
            groups.append((i, j))
    groups += [(i,) for i in range(len(sizes)) if i not in merged]
    joint, joint_prior = [], []
    for g in groups:
        if len(g) == 1:
            joint.append(outcomes[g[0]])
            joint_prior.append(prior[g[0]])
        else:
            joint.append(outcomes[g[0]] * sizes[g[1]] + outcomes[g[1]])
            joint_prior.append(np.einsum("ti,tj->tij", prior[g[0]], prior[g[1]]).reshape(2, -1))
    post = _em(joint, joint_prior, weight, share, rounds, trust)
    return {int(p): float(x) for p, x in zip(patterns, post)}


def _em(outcomes, prior, weight, share, rounds, trust) -> np.ndarray:
    rates, total, start = prior, weight.sum(), share
    for _ in range(rounds):
        log = [np.log(s) + sum(np.log(r[t][o] + 1e-9) for r, o in zip(rates, outcomes)) for t, s in ((0, share), (1, 1 - share))]
        post = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        rates = []
        for p, o in zip(prior, outcomes):
            seen = np.stack([np.bincount(o, x * weight, minlength=p.shape[1]) for x in (post, 1 - post)])
            r = seen + trust * np.maximum(seen.sum(1, keepdims=True), 0.01 * total) * p
            rates.append(r / r.sum(1, keepdims=True))
        share = float((post * weight).sum() + trust * start * total) / (total * (1 + trust))
    return post


def _dependence(x, y, kx, ky, post, weight) -> float:
    """Conditional mutual information of two functions given the match, in nats."""
    out = 0.0
    for w in (post * weight, (1 - post) * weight):
        joint = np.bincount(x * ky + y, w, minlength=kx * ky).reshape(kx, ky) + 1e-9
        n = joint.sum()
        p = joint / n
        out += n / weight.sum() * float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())
    return out


def link(met: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, confidence) of every candidate pair of entities; ``met`` as congregations.meetings gives it. Empty tables give no pair."""
    spark = left.sparkSession
    voted = cut(votes(candidates(met, left, right), left, right))
    counts = {r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior = spark.createDataFrame(sorted(fit(counts).items()), "pattern int, confidence double")
    return voted.join(F.broadcast(posterior), "pattern").select("a", "b", "pattern", "confidence")
