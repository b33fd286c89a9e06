"""Which address records denote the same plot.

Addresses are parsed, equal readings are folded together, and what a reading leaves out is completed from what the corpus says
about its postcode. Readings of both tables meet in an index over (block, numbers, street token with at most one character
deleted), the blocks being the municipality and the postcode area of six digits, which holds neighbouring localities. Each
candidate is judged by the best assignment of the components of one to those of the other, with hard vetoes on numbers and on
areas that contradict each other; a veto on the unit is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parvis.llm import address as A
from parvis.session import cut, large

FIELDS = ("postcode", "prefecture", "municipality", "ward", "town", "numbers")
MOST_PLACES = 200_000


def gazetteer_rows(geonames: DataFrame) -> tuple:
    """The gazetteer as plain rows. It is a fixed list of administrative areas; more than MOST_PLACES is refused."""
    rows = geonames.select("code", "name", "aliases", "type", "prefectureCode", F.col("translations")["en"].alias("en")).limit(MOST_PLACES + 1).collect()
    if len(rows) > MOST_PLACES:
        raise ValueError(f"more than {MOST_PLACES} areas in the gazetteer")
    return tuple((r.code, r.name, tuple(r.aliases or ()), r.type, r.prefectureCode, r.en) for r in rows)


def read_addresses(rows: DataFrame, places: tuple, *, key: str, text: str, postcode: str | None = None) -> DataFrame:
    """key and the components of each row's address."""
    sent = rows.sparkSession.sparkContext.broadcast(places)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = A.gazetteer(sent.value)
        for batch in batches:
            read = [A.parse(t, z, known) for t, z in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*read)) if read else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns[:6]), pa.array(columns[6], pa.bool_()), pa.array(columns[7], pa.string())], ["key", *FIELDS, "latin", "unit"])

    zipped = F.col(postcode).cast("string") if postcode else F.lit(None).cast("string")
    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), zipped.alias("postcode"))
    return own.mapInArrow(scan, f"key {kind}, " + ", ".join(f"{f} string" for f in FIELDS) + ", latin boolean, unit string")


def _near(a: Column, b: Column) -> Column:
    """At most one edit apart, or one begins the other but for two characters."""
    return (F.levenshtein(a, b) <= 1) | ((F.levenshtein(a, b) <= 2) & (F.length(a) == F.length(b)) & (F.sort_array(F.split(a, "")) == F.sort_array(F.split(b, ""))))


def complete(read: DataFrame) -> DataFrame:
    """The readings with municipality, ward and town completed from the majority of native readings of the same postcode.

    A romanised town is rendered by what the native readings of its postcodes mostly call it. Both tables of majorities have
    one row per postcode and per romanised town and are joined, not broadcast by hand.
    """
    forms = cut(read.where("town is not null and numbers is not null").groupBy(*FIELDS, "latin").agg(F.count("*").alias("n")))
    native = forms.where("not latin and postcode is not null")
    towns = native.groupBy("postcode", "town").agg(F.sum("n").alias("n"), F.max_by("municipality", F.when(F.col("municipality").isNotNull(), F.col("n"))).alias("municipality"), F.max_by("ward", F.when(F.col("ward").isNotNull(), F.col("n"))).alias("ward"))
    best = towns.groupBy("postcode").agg(F.max_by(F.struct("municipality", "ward", "town", "n"), F.struct(F.col("municipality").isNotNull(), "n", "town")).alias("z")).select("postcode", F.col("z.municipality").alias("zm"), F.col("z.ward").alias("zw"), F.col("z.town").alias("zt"), F.col("z.n").alias("zn"))
    best = cut(best)
    latin = forms.where("latin and postcode is not null").join(large(best), "postcode").groupBy("town", "zt").agg(F.sum("n").alias("n"))
    said = latin.groupBy("town").agg(F.max_by("zt", F.struct("n", "zt")).alias("lt"))
    with_best = forms.join(large(best), "postcode", "left").join(large(said.withColumn("latin", F.lit(True))), ["town", "latin"], "left")
    agrees = F.col("municipality").isNull() | F.col("zm").isNull() | (F.col("municipality") == F.col("zm"))
    town = F.when(~F.col("latin"), F.col("town")).otherwise(F.coalesce("lt", F.when(agrees, F.col("zt")), F.col("town")))
    full = with_best.withColumn("read", town)
    fits = F.coalesce(agrees & _near(F.col("zt"), F.col("read")), F.lit(False))
    done = full.select(
        *FIELDS, "latin",
        F.coalesce("municipality", F.when(fits, F.col("zm"))).alias("municipality2"),
        F.coalesce("ward", F.when(fits, F.col("zw"))).alias("ward2"),
        F.when(fits & (F.col("zn") > 1), F.col("zt")).otherwise(F.col("read")).alias("town2"),
    )
    known = best.where("zn > 1 and zm is not null").select(F.col("zm").alias("municipality2"), F.col("zt").alias("town2")).distinct().withColumn("known", F.lit(True))
    return done.join(large(known), ["municipality2", "town2"], "left")


def _index(forms: DataFrame) -> DataFrame:
    """(hash of block, numbers and street token less one character; form)."""
    blocks = F.array_compact(F.array(F.concat(F.lit("m"), F.col("municipality2")), F.concat(F.lit("z"), F.substring("postcode", 1, 6))))
    places = F.sequence(F.lit(1), F.length("town2"))
    less = F.transform(places, lambda i: F.concat(F.substring(F.col("town2"), F.lit(1), i - 1), F.substring(F.col("town2"), i + 1, F.length("town2"))))
    tokens = F.array_distinct(F.concat(F.array("town2"), less))
    keys = F.flatten(F.transform(blocks, lambda b: F.transform(tokens, lambda t: F.xxhash64(b, F.col("numbers"), t))))
    return forms.select("form", F.explode(F.array_distinct(keys)).alias("h"))


COMPONENTS = ("prefecture", "municipality2", "ward2", "town2")


def assignment(a: tuple, b: tuple) -> float:
    """Least total cost of assigning the components of a to those of b; a component that the other lacks costs little."""
    cost = [[_cost(i, x, j, y) for j, y in enumerate(b)] for i, x in enumerate(a)]
    return min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(4)))


def _cost(i: int, x: str | None, j: int, y: str | None) -> float:
    if x is None or y is None:
        return 0.1 if i == j else 0.6
    if x == y:
        return 0.0 if i == j else 0.6
    if i == j == 3 and A.within_one(x, y) and (len(x) != len(y) or sorted(x) == sorted(y)):
        return 0.3  # a slip; another character in its place makes another town
    if i == j == 3 and (x.startswith(y) or y.startswith(x)) and abs(len(x) - len(y)) <= 2 and min(len(x), len(y)) > 1:
        return 0.4
    return 2.0


def verdict(a: dict, b: dict, most: float = 0.75) -> bool:
    """Do two completed readings denote one plot? Numbers must be equal and no area may contradict the other's."""
    if a["numbers"] != b["numbers"] or not a["numbers"]:
        return False
    for f in ("prefecture", "municipality2", "ward2"):
        if a[f] and b[f] and a[f] != b[f]:
            return False
    if a["known"] and b["known"] and a["town2"] != b["town2"]:
        return False
    za, zb = a["postcode"], b["postcode"]
    wrong = sum(x != y for x, y in zip(za, zb)) if za and zb else 0
    same_area = a["municipality2"] and a["municipality2"] == b["municipality2"]
    if not same_area and not (za and zb and (wrong == 0 or (wrong == 1 and a["town2"] == b["town2"]))):
        return False
    if wrong > 1 and (a["town2"] != b["town2"] or bool(a["ward2"]) != bool(b["ward2"])):
        return False
    return assignment(tuple(a[c] for c in COMPONENTS), tuple(b[c] for c in COMPONENTS)) <= most


def _verdict(most: float = 0.75) -> Column:
    """``verdict`` over columns a_* and b_*, so that pairs are judged within the JVM."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    differ = lambda x, y: F.filter(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
    x, y = c("a_town2"), c("b_town2")
    swapped = (F.length(x) == F.length(y)) & (F.levenshtein(x, y) == 2) & (F.sort_array(F.split(x, "")) == F.sort_array(F.split(y, ""))) & (F.size(differ(x, y)) == 2) & (F.element_at(differ(x, y), 2) - F.element_at(differ(x, y), 1) == 1)
    slip = ((F.length(x) != F.length(y)) & (F.levenshtein(x, y) == 1)) | swapped
    begins = (F.startswith(x, y) | F.startswith(y, x)) & (F.abs(F.length(x) - F.length(y)) <= 2) & (F.least(F.length(x), F.length(y)) > 1)

    def cost(i: int, j: int) -> Column:
        p, q = c(f"a_{COMPONENTS[i]}"), c(f"b_{COMPONENTS[j]}")
        if i != j:
            return F.when(p.isNull() | q.isNull() | (p == q), 0.6).otherwise(2.0)
        same = F.when(p.isNull() | q.isNull(), 0.1).when(p == q, 0.0)
        return (same.when(slip, 0.3).when(begins, 0.4) if i == 3 else same).otherwise(2.0)

    costs = [[cost(i, j) for j in range(4)] for i in range(4)]
    assigned = F.least(*[costs[0][p[0]] + costs[1][p[1]] + costs[2][p[2]] + costs[3][p[3]] for p in permutations(range(4))])
    za, zb = c("a_postcode"), c("b_postcode")
    zips = za.isNotNull() & zb.isNotNull()
    wrong = F.when(zips, F.size(differ(za, zb))).otherwise(0)
    near = yes(c("a_municipality2") == c("b_municipality2")) | (zips & ((wrong == 0) | ((wrong == 1) & x.eqNullSafe(y))))
    clash = F.lit(False)
    for f in COMPONENTS[:3]:
        clash = clash | yes(c(f"a_{f}") != c(f"b_{f}"))
    clash = clash | (yes(c("a_known")) & yes(c("b_known")) & ~x.eqNullSafe(y))
    clash = clash | ((wrong > 1) & (~x.eqNullSafe(y) | (c("a_ward2").isNull() != c("b_ward2").isNull())))
    return yes(c("a_numbers") == c("b_numbers")) & (c("a_numbers") != "") & ~clash & near & (assigned <= most)


def same_plots(left: DataFrame, right: DataFrame, *, unit_veto: bool = False) -> DataFrame:
    """(left key, right key) of rows whose addresses denote the same plot; both sides as read_addresses gives them.

    Rows without a street and numbers are in no pair. Equal readings are compared once, whatever their number; the keys are
    joined back at the end, where a hot address is split by adaptive skew joins. With ``unit_veto`` rows that name different
    floors or rooms are no pair.
    """
    both = cut(complete(left.unionByName(right)))
    identity = F.xxhash64(*[F.coalesce(F.col(f), F.lit("\0")) for f in FIELDS], "latin")
    forms = both.withColumn("form", identity)
    a = left.where("town is not null and numbers is not null").select(F.col("key").alias("left_key"), F.col("unit").alias("u1"), identity.alias("a"))
    b = right.where("town is not null and numbers is not null").select(F.col("key").alias("right_key"), F.col("unit").alias("u2"), identity.alias("b"))
    index = _index(forms)
    mine = index.join(a.select(F.col("a").alias("form")).distinct(), "form", "left_semi").withColumnRenamed("form", "a")
    theirs = index.join(b.select(F.col("b").alias("form")).distinct(), "form", "left_semi").withColumnRenamed("form", "b")
    candidates = mine.join(theirs, "h").select("a", "b").distinct()
    columns = [*COMPONENTS, "numbers", "postcode", "known"]
    wide = candidates.join(forms.select(F.col("form").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns]), "a").join(forms.select(F.col("form").alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns]), "b")
    wide = wide.select("a", "b", *[f"{s}_{c}" for s in "ab" for c in columns])
    pairs = wide.where(_verdict()).select("a", "b")
    rows = a.join(pairs, "a").join(b, "b")
    if unit_veto:
        rows = rows.where("u1 is null or u2 is null or u1 = u2")
    return rows.select("left_key", "right_key")
