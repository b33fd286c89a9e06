"""Packing texts into containers of fixed capacity by a configuration linear program over the histogram of sizes.

Only the histogram reaches the driver, at most one count per size up to the capacity. There the configuration LP (one
variable per way to fill a container) is solved by multiplicative weights: in each round the sizes have prices, a knapsack
dynamic program finds the best filling at these prices, and the prices of the sizes it covers fall. The fractional solution
is rounded down, twice; what is left over is filled by the same knapsack pricing, also on counts. The outcome is a table of runs "ranks r.. of size s go
to containers b.., a each", whose length depends on the capacity only. The items then find their container by the rank
within their size, which is worked out in two salted levels, so that no size, however frequent, is ranked in one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

CAPACITY = 2048


def default_vocabulary() -> str:
    """Path of the multilingual byte BPE ranks; PARVIS_TOKENIZER names another."""
    if path := os.environ.get("PARVIS_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every row; null texts have null."""
    path = vocabulary or default_vocabulary()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            counts = [None if x is None else len(encode(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "tokens"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, tokens bigint")


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken in the dearest filling of the capacity (unbounded)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, p = sizes[order], prices[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            value = best[c - s[:k]] + p[:k]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], choice[c] = value[j], j
    taken, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[order[choice[c]]] += 1
            c -= s[choice[c]]
    return taken


def fillings(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 500, rate: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """Fractional solution of the configuration LP: (patterns as rows, how much of each per full cover).

    The multiplicative weight of a size starts at its share of all room, so that prices start in proportion to size.
    """
    price = np.ones(len(sizes))
    seen: dict[bytes, int] = {}
    patterns, amount = [], []
    cover = np.zeros(len(sizes))
    for _ in range(rounds):
        taken = np.minimum(knapsack(sizes, price * sizes / capacity, capacity), counts)
        free = capacity - int(taken @ sizes)
        for j in np.argsort(-sizes):  # what the count limits left free
            if sizes[j] <= free and taken[j] < counts[j]:
                more = int(min(free // sizes[j], counts[j] - taken[j]))
                taken[j] += more
                free -= more * sizes[j]
        used = taken > 0
        step = float((counts[used] / taken[used]).min())
        key = taken.tobytes()
        if key not in seen:
            seen[key] = len(patterns)
            patterns.append(taken)
            amount.append(0.0)
        amount[seen[key]] += step
        gain = taken * step / counts
        cover += gain
        price *= np.exp(-rate * gain)
        price /= price.max()
    return np.array(patterns), np.array(amount) / max(1e-9, float(np.median(cover)))


def bounded_knapsack(sizes: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken, at most counts times, in the dearest filling of the capacity."""
    best = np.zeros(capacity + 1)
    parts, kept = [], []
    for j in np.flatnonzero(counts > 0):
        n, k = int(min(counts[j], capacity // sizes[j])), 1
        while n > 0:  # copies in powers of two
            m = min(k, n)
            w = m * int(sizes[j])
            more = best[:-w] + m * prices[j] if w else best
            better = np.zeros(capacity + 1, bool)
            better[w:] = more > best[w:] + 1e-12
            best[w:] = np.where(better[w:], more, best[w:])
            parts.append((j, m, w))
            kept.append(better)
            n, k = n - m, k * 2
    taken, c = np.zeros(len(sizes), np.int64), capacity
    for (j, m, w), better in zip(reversed(parts), reversed(kept)):
        if better[c]:
            taken[j] += m
            c -= w
    return taken


def rounded(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[int, np.ndarray]], int]:
    """(containers, filling) that pack the counts, and how many of the containers the LP's own fillings make.

    The fractional solution is rounded down, the LP solved again for what is left and rounded down again. What then remains,
    a few containers per size whatever the corpus, is filled one by one with the dearest filling of what is there, by the same
    knapsack pricing with large sizes dearer for their room. (More rounds of the LP leave a rest that fills worse.)
    """
    chosen, left = [], counts.copy()
    from_lp = 0
    for n in range(2):
        here = np.flatnonzero(left)
        if not len(here):
            break
        patterns, amount = fillings(sizes[here], left[here], capacity, rounds if n == 0 else max(60, rounds // 4))
        for i in np.argsort(-amount):
            used = patterns[i] > 0
            times = min(int(amount[i] + 1e-9), int((left[here][used] // patterns[i][used]).min()))
            if times > 0:
                taken = np.zeros(len(sizes), np.int64)
                taken[here] = patterns[i]
                chosen.append((times, taken))
                left = left - times * taken
                from_lp += times
    prices = sizes * (1 + 0.3 * sizes / capacity)
    while left.any():
        taken = bounded_knapsack(sizes, left, prices, capacity)
        used = taken > 0
        times = int((left[used] // taken[used]).min())
        chosen.append((times, taken))
        left = left - times * taken
    return chosen, from_lp


def plan(counts_by_size: dict[int, int], capacity: int, units: int = 512, rounds: int = 500) -> tuple[np.ndarray, int]:
    """Runs (size class start, ranks from, containers from, items a container) and the number of containers.

    Sizes are rounded up to capacity / units for the LP; the runs speak of these classes.
    """
    unit = max(1, capacity // units)
    room = capacity // unit
    classes: dict[int, int] = {}
    for size, n in counts_by_size.items():
        if size <= 0:
            continue
        c = min(room, -(-size // unit))
        classes[c] = classes.get(c, 0) + n
    if not classes:
        return np.zeros((0, 4), np.int64), 0
    sizes = np.array(sorted(classes), np.int64)
    counts = np.array([classes[int(s)] for s in sizes], np.int64)
    chosen, _ = rounded(sizes, counts, room, rounds)
    runs, rank, container = [], np.zeros(len(sizes), np.int64), 0
    for times, taken in chosen:
        for j in np.flatnonzero(taken):
            runs.append((sizes[j], rank[j], container, taken[j]))
            rank[j] += times * taken[j]
        container += times
    return np.array(sorted(runs), np.int64), container


def pack(items: DataFrame, *, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY, group: int = 200_000) -> DataFrame:
    """One row per piece: key, piece, size, container.

    Items up to the capacity stay whole; larger ones give full containers of their own and one rest, which is packed like an
    item. Items of size 0 need no room: container null. Null sizes are left out. Every row counts, repeated keys too.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()
    own = items.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")).where("size is not null and size >= 0")
    whole = (F.col("size") / capacity).cast("bigint")
    spread = own.withColumn("full", whole).withColumn("rest", F.col("size") - F.col("full") * capacity)
    counts = {r["rest"]: r for r in spread.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()}  # at most capacity rows
    runs, containers = plan({s: r.n for s, r in counts.items() if s > 0}, capacity)
    unit = max(1, capacity // 512)
    salts = max(1, -(-max((r.n for r in counts.values()), default=1) // group))
    rest = spread.where("rest > 0").withColumn("class", F.least(F.lit(capacity // unit), F.ceil(F.col("rest") / unit)).cast("bigint"))
    ranked = _before(rest, ["class"], F.lit(1).cast("bigint"), salts).withColumnRenamed("before", "rank")
    table = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        starts = (runs[:, 0] << 40) + runs[:, 1]
        for batch in batches:
            classes, ranks = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            i = np.searchsorted(starts, (classes << 40) + ranks, side="right") - 1
            container = runs[i, 2] + (ranks - runs[i, 1]) // runs[i, 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container)], ["key", "piece", "size", "container"])

    packed = ranked.select("key", F.col("full").alias("piece"), F.col("rest").alias("size"), "class", "rank").mapInArrow(place, f"key {kind}, piece bigint, size bigint, container bigint")
    # full containers are numbered on from there
    parts = max(1, -(-sum(r.n for r in counts.values()) // group))
    full = _before(spread.where("full > 0"), [], F.col("full"), parts)
    cut = full.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"), F.lit(capacity).cast("bigint").alias("size"), "before")
    cut = cut.select("key", "piece", "size", (F.lit(containers).cast("bigint") + F.col("before") + F.col("piece")).alias("container"))
    empty = spread.where("size = 0").select("key", F.lit(0).cast("bigint").alias("piece"), "size", F.lit(None).cast("bigint").alias("container"))
    return packed.unionByName(cut).unionByName(empty).withColumnRenamed("key", key)


def _before(rows: DataFrame, within: list[str], weight, salts: int) -> DataFrame:
    """Adds ``before``: the sum of weight over the rows that come before a row within its group, in some fixed order.

    Groups are cut by a salt of the key, summed up per salt (a table of groups x salts rows), and joined.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).withColumn("weight", weight)
    order = Window.partitionBy(*within, "salt").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = salted.withColumn("before", F.sum("weight").over(order) - F.col("weight"))
    if salts == 1:
        return inner.drop("salt", "weight")
    sums = salted.groupBy(*within, "salt").agg(F.sum("weight").alias("sum"))
    upto = Window.partitionBy(*within).orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = sums.select(*within, "salt", (F.sum("sum").over(upto) - F.col("sum")).alias("ahead"))
    return inner.join(ahead, [*within, "salt"]).withColumn("before", F.col("before") + F.col("ahead")).drop("salt", "weight", "ahead")
