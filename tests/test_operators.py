import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from parvis import session
from parvis.operators import dedupe, graph, incremental, integrity, places, resolve, search, social, spatial


def test_keep_first_takes_the_first_in_order(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, None), (None, 3, "n")], "k string, o int, v string")
    got = {r["k"]: r["v"] for r in dedupe.keep_first(rows, ["k"], [F.col("o")]).collect()}
    assert got == {"a": "x", "b": None, None: "n"}


def test_content_hash_ignores_order(spark):
    rows = [(i, f"v{i}") for i in range(50)]
    a = spark.createDataFrame(rows, "k int, v string")
    b = spark.createDataFrame(rows[::-1], "k int, v string").repartition(3)
    h = lambda d: dedupe.content_hash(d, [F.col("k"), F.col("v")]).first()["hash"]
    assert h(a) == h(b)
    assert h(a) != h(a.withColumn("v", F.when(F.col("k") == 3, "z").otherwise(F.col("v"))))
    assert dedupe.content_hash(a.where("false"), [F.col("v")]).first()["rows"] == 0


def test_winner_needs_its_margin(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8), ("b", 1, 0.9), ("b", 2, 0.88), ("c", 1, 0.5)], "g string, k int, s double")
    assert {r["g"] for r in dedupe.winner_margin(rows, ["g"], "s", ["k"], 0.05).collect()} == {"a", "c"}


def test_mutual_best_equals_greedy(spark):
    r = random.Random(4)
    pairs = [(a, b, r.choice([0.2, 0.5, 0.5, 0.8, 0.9])) for a, b in product(range(12), range(10)) if r.random() < 0.4]
    used_a, used_b, want = set(), set(), set()
    for s, a, b in sorted(((-s, a, b) for a, b, s in pairs)):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    got = {(x["a"], x["b"]) for x in resolve.mutual_best(spark.createDataFrame(pairs, "a int, b int, score double")).collect()}
    assert got == want


def test_mutual_best_takes_repeated_rows_at_once(spark, monkeypatch):
    from parvis import session

    cuts, cut = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df: cuts.append(1) or cut(df))
    pairs = [(10 * a + i, 10 * b + j, s) for a, b, s in ((1, 1, 0.9), (1, 2, 0.5), (2, 2, 0.5)) for i in range(8) for j in range(6)]
    got = {(x["a"], x["b"]) for x in resolve.mutual_best(spark.createDataFrame(pairs, "a int, b int, score double")).collect()}
    assert got == {(10 + i, 10 + i) for i in range(6)} | {(16, 20), (17, 21)} | {(20 + i, 22 + i) for i in range(4)}
    assert len(cuts) <= 3 * 4 + 1  # a round for each pair of rows before


def test_matches_are_worked_out_once(spark):
    from parvis.operators import official

    churches = spark.createDataFrame([(1, "A", None), (2, "A", None)], "church bigint, denomination string, human string")
    matches = spark.range(1).selectExpr("id + 1 as church", "id as entry", "'B' as denomination", "0.9D as score")
    got = official.reconcile(churches, matches, spark.createDataFrame([("A",)], "denomination string"))
    assert "Range (" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(x["church"], x["after"]) for x in got.collect()} == {(1, "B"), (2, None)}


def test_rules_must_agree_and_vetoes_count(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma alpha"), (4, "none")], "id int, t string")
    rules = spark.createDataFrame([("A", "alpha", False), ("B", "beta", False), ("A", "gamma", True), ("C", "no", False)], "rule string, term string, veto boolean")
    assert {(r["key"], r["rule"]) for r in resolve.rule_matches(rows, rules, key="id", text="t").collect()} == {(2, "A")}


def test_model_scores_distinct_requests_once(spark):
    seen = []

    def model(batch):
        return [9.0 if x["a"] == "x" else 0.5 for x in batch]

    rows = spark.createDataFrame([("x",), ("x",), ("y",)], "a string")
    assert sorted(r["score"] for r in resolve.score_by_model(rows, model, columns=["a"]).collect()) == [0.5, 1.0, 1.0] and not seen


def test_graph_changes(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "z")], "id string, n int, s string")
    assert {tuple(r) for r in graph.diff(old, new, "id", ["n", "s"]).collect()} == {("a", "missing", ""), ("b", "changed", "n,s"), ("c", "extra", "")}
    assert {tuple(r) for r in graph.upsert(old, new, "id").collect()} == {("a", 1, "x"), ("b", 3, "y"), ("c", 4, "z")}
    n = graph.nodes(old, F.col("id"), "N")
    e = graph.edges(spark.createDataFrame([("q", "a"), ("q", None)], "s string, t string"), F.col("s"), F.col("t"), "E")
    assert [r["id"] for r in graph.orphans(n, e, ["N"]).collect()] == ["b"]


def test_dictionary_validation(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("c", "e"), (" f", "g"), ("h", "")], "source string, target string")
    assert {tuple(r) for r in integrity.validate_dictionary(d).collect()} == {("a", "circular"), ("b", "circular"), ("c", "repeated"), (" f", "padded"), ("h", "blank")}


def test_integrity_on_empty_tables(spark):
    t = spark.createDataFrame([], "id string, v int")
    assert [tuple(r) for r in integrity.check("x", t, F.lit(True), "id").collect()] == [("x", 0, "")]
    assert [tuple(r) for r in integrity.check_unique("y", t, ["id"]).collect()] == [("y", 0, "")]


def test_freshness_of_the_future(spark):
    now = F.lit("2026-01-31 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("2026-01-30",), ("2025-12-01",), ("2026-02-01",), (None,)], "t string").withColumn("t", F.col("t").cast("timestamp"))
    got = [tuple(r) for r in rows.select(incremental.is_fresh(F.col("t"), now), incremental.is_fresh_listing(F.col("t"), now)).collect()]
    assert got == [(True, True), (False, False), (False, True), (False, False)]


@pytest.mark.parametrize("ring,area", [([(0, 0), (4, 0), (4, 4), (0, 4)], 16.0), ([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], 10.0), ([(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], 16.0), ([(0, 0), (1, 0)], 0.0)])
def test_ear_clipping_keeps_the_area(ring, area):
    t = spatial.ear_clip(np.array(ring, float))
    got = sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in t)
    assert abs(got - area) < 1e-9


def test_hierarchy_finds_every_overlap():
    r = np.random.default_rng(1)
    low = r.random((300, 2))
    boxes = np.concatenate([low, low + r.random((300, 2)) * 0.1], 1)
    tree = spatial.build(boxes)
    q = boxes[:40]
    got = {(int(a), int(i)) for qs, ns in spatial.overlaps(tree, q, 64) for a, n in zip(qs, ns) for i in tree.order[tree.first[n] : tree.last[n]]}
    want = {(i, j) for i in range(40) for j in range(300) if (q[i, :2] <= boxes[j, 2:]).all() and (q[i, 2:] >= boxes[j, :2]).all()}
    assert want <= got


def test_near_pairs_against_brute_force(spark):
    r = random.Random(2)
    pts = [(i, 35 + r.random() * 0.01, 135 + r.random() * 0.01) for i in range(200)]
    pts += [(1000 + i, 35.005, 135.005) for i in range(40)] + [(2000, None, 135.0), (2001, 95.0, 135.0), (2002, 35.0, float("nan"))]
    rows = spark.createDataFrame([(i, {"latitude": a, "longitude": b}) for i, a, b in pts], "id bigint, loc struct<latitude:double,longitude:double>")
    use = spatial.usable(rows, key="id", location="loc")
    from math import asin, cos, radians, sin, sqrt

    def km(p, q):
        h = sin(radians(q[1] - p[1]) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin(radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0088 * asin(min(1, sqrt(h)))

    good = [p for p in pts if p[0] < 2000]
    want = {(p[0], q[0]) for p in good for q in good if p[0] < q[0] and km(p, q) <= 0.075}
    got = [tuple(x) for x in spatial.near_pairs(use, metres=75, chunk=10).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.near_pairs(use.where("false"), metres=75).count() == 0


def test_crowded_cells_are_split(spark):
    r = random.Random(3)
    pts = [(i, 135 + r.random() * 0.004, 35 + r.random() * 0.004) for i in range(400)]
    points = spark.createDataFrame(pts, "point bigint, longitude double, latitude double")
    discs = points.select(F.col("point").alias("region"), "latitude", "longitude", F.lit(0.05).alias("radius_km"))
    a = {tuple(x) for x in spatial.points_in_regions(points, spatial.triangulate_discs(discs), leaf=20).collect()}
    b = {tuple(x) for x in spatial.points_in_regions(points, spatial.triangulate_discs(discs), leaf=10_000).collect()}
    assert a == b and all((i, i) in a for i in range(400))


def test_shared_edges_count_once(spark):
    ring = [{"longitude": x, "latitude": y} for x, y in ((130.0, 30.0), (131.0, 30.0), (131.0, 31.0), (130.0, 31.0))]
    polygons = spark.createDataFrame([(7, ring), (8, None)], "region bigint, ring array<struct<longitude:double,latitude:double>>")
    points = spark.createDataFrame([(1, 130.5, 30.5), (2, 130.0, 30.0), (3, 129.0, 30.0)], "point bigint, longitude double, latitude double")
    assert sorted(tuple(x) for x in spatial.points_in_regions(points, spatial.triangulate_polygons(polygons)).collect()) == [(1, 7), (2, 7)]


AREAS = [
    places.Place("13", "東京都", ("東京",), "PREFECTURE", 35.7, 139.7, 50.0, {"en": "Tokyo"}),
    places.Place("131", "府中市", ("府中",), "MUNICIPALITY", 35.67, 139.48, 10.0, {}),
    places.Place("341", "府中市", ("府中",), "MUNICIPALITY", 34.57, 133.24, 10.0, {}),
    places.Place("27", "大阪府", ("大阪",), "PREFECTURE", 34.7, 135.5, 50.0, {}),
]


def test_places_are_resolved_by_intent():
    assert places.resolve("東京 教会", AREAS).place.code == "13"
    assert places.resolve("府中 教会", AREAS).reason == "ambiguous"
    assert places.resolve("府中 教会", AREAS, point=(34.6, 133.2)).place.code == "341"
    r = places.resolve("大阪府 府中", AREAS)
    assert r.place.code == "27" and r.reason == "explicit-prefecture" and r.explicit
    assert places.resolve("日本 教会", AREAS).place is None
    assert places.resolve("東京都 希望", AREAS).remainder == "希望"


def _catalog(spark):
    rows = [("a", "光の丘教会", "Hikari Church", 35.0, 135.0, ["13"]), ("b", "光の谷教会", "Hikari Tani", 35.1, 135.0, ["27"]), ("c", "星の丘", "Hoshi", 40.0, 140.0, ["13"])]
    docs = spark.createDataFrame(rows, "doc string, name string, name_local string, latitude double, longitude double, area_codes array<string>")
    docs = docs.selectExpr("*", "name as name_exact", "concat(name, ' ', name_local) as compact", "array('ja') as title_languages", "cast(null as string) as name_canonical", "cast(null as string) as name_reading", "cast(null as string) as minister")
    fields = ["name", "name_local", "name_canonical", "name_reading", "minister", "compact"]
    return docs, search.postings(docs, "doc", fields), search.statistics(docs, "doc", fields)


def test_search_tiers(spark):
    docs, posted, stats = _catalog(spark)
    ask = lambda **k: [(r["doc"], r["tier"]) for r in search.run(docs, posted, stats, search.Request(**k)).collect()]
    assert ask(query="光の丘教会")[0] == ("a", 1)
    assert {x for x, _ in ask(query="Hikari", language="en")} == {"a", "b"}
    assert {x for x, _ in ask(query="教会")} == {"a", "b", "c"}  # nothing but generic words: every document
    assert {x for x, _ in ask(query="東京 Hikari", area_code="13", remainder="Hikari", explicit_area=True)} == {"a"}
    assert {x for x, _ in ask(query="東京", area_code="13", remainder="")} == {"a", "c"}
    near = ask(query="教会", point=(35.0, 135.0))
    assert [x for x, _ in near] == ["a", "b"]
    with pytest.raises(ValueError):
        search.Request("x", limit=101)


def test_tokens_agree_with_query_analysis(spark):
    for t in ("Hello, World 42", "東京 バプテスト教会", "교회 A", "", "光"):
        got = spark.createDataFrame([(t,)], "t string").select(search.tokens(F.col("t")).alias("x")).first()["x"]
        assert list(dict.fromkeys(got)) == search.analyse(t)


def test_query_key_equals_row_key(spark):
    from parvis.functions.text import exact_key

    for t in ("　東京 教会 ", " Grace   Church ", "ＡＢ c", "a\u00a0b", "光 の　丘"):
        assert search.exact_key(t) == spark.createDataFrame([(t,)], "t string").select(exact_key(F.col("t")).alias("k")).first()["k"]


def test_turns_of_a_hot_group(spark):
    """A third of the rows in one group: ranks are exact and no task of the ranking holds the group."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"h{i % 40}") for i in range(3000)]
    d = spark.createDataFrame(rows, "k bigint, host string")
    got = {r["k"]: r["turn"] for r in dedupe.round_robin(d, "host", [F.col("k")]).collect()}
    seen, want = {}, {}
    for k, h in rows:
        seen[h] = seen.get(h, 0) + 1
        want[k] = seen[h]
    assert got == want
    assert dedupe.round_robin(d.where("false"), "host", [F.col("k")]).count() == 0


def test_duplicates_of_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"v{i}") for i in range(900)] + [(0, "hot"), (1, None), (2, None)]
    got = {r["v"]: (r["copies"], r["sample"]) for r in dedupe.duplicates(spark.createDataFrame(rows, "k bigint, v string"), ["v"], "k", 5).collect()}
    assert got == {"hot": (301, [0, 3, 6, 9, 12]), None: (2, [1, 2])}


def test_points_of_the_whole_world(spark):
    """The histogram stays bounded by wider cells, the answer stays exact."""
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([(x, y) for x in range(-179, 180, 9) for y in range(-89, 90, 9)])]
    square = [(1, [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (0.0, 0.0), (-50.0, 50.0)])]
    ring = spark.createDataFrame([(r, [{"longitude": x, "latitude": y} for x, y in c]) for r, c in square], "region bigint, ring array<struct<longitude:double,latitude:double>>")
    points = spark.createDataFrame(pts, "point bigint, longitude double, latitude double")
    held = {r["point"] for r in spatial.points_in_regions(points, spatial.triangulate_polygons(ring)).collect()}
    want = {i for i, x, y in pts if -50 < x < 50 and -50 < y < 50 and not y > abs(x)}
    edge = {i for i, x, y in pts if y == abs(x) or abs(x) == 50 or abs(y) == 50}
    assert held - edge == want - edge


def test_estimates_rank_only_what_can_win(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(4, 6)))
    heads = [word() for _ in range(9)]
    names = [r.choice(heads) + r.choice(heads) for _ in range(60)]
    churches = spark.createDataFrame([(b, r.choice(names) if b % 3 else r.choice(heads)) for b in range(400)], "church int, name string")
    accounts = spark.createDataFrame([(a, r.choice(names) + r.choice(["", "x", "a"])) for a in range(60)], "account int, name string")
    x, y = accounts.select(F.col("account").alias("key"), F.col("name").alias("t")), churches.select(F.col("church").alias("key"), F.col("name").alias("t"))
    few = {most: {(g["a"], g["b"]) for g in resolve.gram_candidates(x, y, key="key", text="t", most=most).collect()} for most in (7, 80)}
    pairs = accounts.select(F.col("name").alias("x")).join(churches.select(F.col("name").alias("y")).distinct(), F.expr("ascii(substring(x, 2)) = ascii(substring(y, 2))"))
    said, second = dict(map(tuple, accounts.collect())), dict(map(tuple, churches.collect()))
    for most, kept in few.items():
        want = {(a, b) for a, b in kept if said[a][1] == second[b][1]}
        got = {(a, g["b"]) for g in resolve.among_gram_candidates(pairs, churches.select(F.col("church").alias("b"), F.col("name").alias("y")), most, (20, 60)).collect() for a, n in said.items() if n == g["x"]}
        assert got == want and got
    monkeypatch.setattr(resolve, "gram_candidates", None)  # all names that share a bigram aren't paired
    monkeypatch.setattr(social, "gram_candidates", None, raising=False)
    assert social.merge_estimates(accounts, churches).count() > 0


def test_no_names_are_gathered_in_the_driver(spark, monkeypatch):
    """The driver memory of account_estimates: Spark judges exploded and checkpointed names by the files they once came from."""
    plans, kept = [], session.cut

    def seen(df):
        plans.append(df)
        return kept(df)

    monkeypatch.setattr(session, "cut", seen)
    monkeypatch.setattr(social, "cut", seen)
    accounts = spark.range(3).selectExpr("id as account", "concat('光の丘教会', id) as name")
    churches = spark.range(3).selectExpr("id as church", "concat('光の丘教會', id) as name")
    plans.append(social.merge_estimates(accounts, churches, margin=0.05))
    assert len(plans) > 9 and not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]
