import itertools
import random
from collections import defaultdict

import numpy as np

from parvis.llm import packing


def check(rows, items, capacity):
    """Every item whole or cut only beyond the capacity; no container over its capacity."""
    room, sizes = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["doc_id"]] += r["size"]
        if r["size"] == 0:
            assert r["container"] is None
        else:
            room[r["container"]] += r["size"]
    want = defaultdict(int)
    for k, s in items:
        if s is not None:
            want[k] += s
    assert dict(sizes) == dict(want)
    assert max(room.values(), default=0) <= capacity
    return sum(room.values()) / (capacity * max(1, len(room)))


def test_knapsack_is_optimal():
    r = random.Random(3)
    for _ in range(40):
        sizes = np.array(sorted(r.sample(range(1, 20), 4)))
        prices = np.array([r.random() for _ in sizes])
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - s] + p for s, p in zip(sizes, prices) if s <= c)])
        taken = packing.knapsack(sizes, prices, 30)
        assert taken @ sizes <= 30 and abs(taken @ prices - best[30]) < 1e-9


def test_bounded_knapsack_is_optimal():
    r = random.Random(4)
    for _ in range(30):
        sizes, counts = np.array(sorted(r.sample(range(1, 15), 4))), np.array([r.randint(0, 5) for _ in range(4)])
        prices = np.array([r.random() for _ in sizes])
        best = max(sum(a * p for a, p in zip(t, prices)) for t in itertools.product(*(range(n + 1) for n in counts)) if sum(a * x for a, x in zip(t, sizes)) <= 25)
        taken = packing.bounded_knapsack(sizes, counts, prices, 25)
        assert taken @ sizes <= 25 and (taken <= counts).all() and abs(taken @ prices - best) < 1e-9


def test_rounding_is_no_worse_than_largest_first():
    r = np.random.default_rng(5)
    for n in (60, 600, 6000):
        drawn = np.minimum(512, np.maximum(1, r.lognormal(4.2, 0.9, n))).astype(int)
        sizes, counts = np.unique(drawn, return_counts=True)
        chosen, from_lp = packing.rounded(sizes, counts, 512, 300)
        assert (sum(t * p for t, p in chosen) == counts).all() and max(p @ sizes for _, p in chosen) <= 512
        total, left, plain = sum(t for t, _ in chosen), counts.copy(), 0
        while left.any():
            free = 512
            for j in np.argsort(-sizes):
                k = min(left[j], free // sizes[j])
                left[j], free = left[j] - k, free - k * sizes[j]
            plain += 1
        assert total <= plain + 1 and total <= -(-int(sizes @ counts) // 512) + 2
        assert n < 6000 or from_lp > 0.6 * total


def test_plan_covers_all_counts():
    counts = {100: 50, 300: 7, 513: 20, 1700: 3, 2048: 2, 0: 9}
    runs, containers = packing.plan(counts, 2048)
    assert containers >= sum(s * n for s, n in counts.items()) / 2048
    assert packing.plan({}, 2048)[1] == 0


def test_packed_rows(spark):
    r = random.Random(7)
    items = [(i, r.choice([5, 40, 90, 130, 260, 511, 512, 513, 1500])) for i in range(800)] + [(5000, 0), (5001, None), (5002, 1024), (5002, 77), (5003, 1_000_000)]
    rows = spark.createDataFrame([(k, s, "x", 0) for k, s in items], "doc_id bigint, tokens bigint, container string, rank int")
    for group in (200_000, 50):
        got = packing.pack(rows, capacity=512, group=group).collect()
        assert check(got, items, 512) > 0.97
    assert packing.pack(rows.where("false"), capacity=512).count() == 0


def test_one_size_for_all(spark):
    rows = spark.createDataFrame([(i, 100) for i in range(999)], "doc_id bigint, tokens bigint")
    got = packing.pack(rows, capacity=512, group=100).collect()
    assert len({r["container"] for r in got}) == 200


def test_token_counts(spark):
    rows = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(rows).collect()}
    assert got[1] >= 2 and got[2] is None and got[3] == 0
