"""Linking the spellings and records of one congregation across tables without a common id.

Names are rewritten to every canonical form (names.py), addresses read into parts (address.py, plots.py). Rows that a table
itself ties together (same map id, same record id, or equal in all that is read) form an entity. Entities of two tables meet
by equi-joins on exploded forms, and a shared form counts by its rarity: the fewer places an area has for it, the surer it
is. The address vetoes and breaks ties. A form that many places share is joined together with the place, town or plot, so
that a hot form yields no more candidates than can pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parvis.llm import address as A, names as N, plots
from parvis.session import cut, large

MOST_DENOMINATIONS = 10_000
#: Forms of an area that stand for more places than this are joined together with place, town and plot only.
SPREAD = 4


def denomination_words(denominations: DataFrame) -> tuple[str, ...]:
    """Names and name components of denominations, longest first. A small fixed list; more than MOST_DENOMINATIONS is refused."""
    rows = denominations.select("name", "churchNameComponents").limit(MOST_DENOMINATIONS + 1).collect()
    if len(rows) > MOST_DENOMINATIONS:
        raise ValueError(f"more than {MOST_DENOMINATIONS} denominations")
    return tuple(sorted({A.fold_name(x) for r in rows for x in [r[0], *(r[1] or ())] if x}, key=lambda x: (-len(x), x)))


#: Hosts that many unrelated records share: maps and social networks.
SHARED_HOSTS = r"(^|\.)(google|goo|facebook|fb|instagram|twitter|x|youtube|youtu|line|tiktok|threads)\.[a-z.]+$"


def sightings(rows: DataFrame, places: tuple, *, key: str, name: str, address: str, second: str | None = None, postcode: str | None = None, entity: str | None = None, location: str | None = None, website: str | None = None) -> DataFrame:
    """One row per input row: key, entity, nid with name and second name, address parts, latitude, longitude, host.

    The entity is a hash of the given column where it isn't blank, else of all that is read of the row, so that exact copies
    are one entity. Null and unreadable values give null parts.
    """
    sent = rows.sparkSession.sparkContext.broadcast(places)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = A.gazetteer(sent.value)
        for batch in batches:
            read = [A.parse(t, z, known) for t, z in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            where = [[r[i] for r in read] for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(3, 10)), *(pa.array(c, pa.string()) for c in where[:6]), pa.array(where[6], pa.bool_())], ["key", "entity", "nid", "name", "second", "latitude", "longitude", "host", *plots.FIELDS, "latin"])

    kind = rows.schema[key].dataType.simpleString()
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    number = lambda f: F.col(f"{location}.{f}").cast("double") if location else F.lit(None).cast("double")
    host = F.regexp_extract(F.lower(F.trim(text(website))), r"^(?:https?://)?(?:www\.)?([a-z0-9\-]+(?:\.[a-z0-9\-]+)+)", 1)
    host = F.when((host == "") | host.rlike(SHARED_HOSTS), None).otherwise(host)
    lat, lon = number("latitude"), number("longitude")
    inside = lat.between(20, 46) & lon.between(122, 154)
    read = rows.select(F.col(key).alias("key"), text(address).alias("address"), text(postcode).alias("zip"), text(name).alias("name"), text(second).alias("second"), F.nullif(F.trim(text(entity)), F.lit("")).alias("own"), F.when(inside, lat).alias("latitude"), F.when(inside, lon).alias("longitude"), host.alias("host"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    content = F.xxhash64(*map(blank, ("address", "zip", "name", "latitude", "longitude", "host")))
    nid = F.when(F.trim("name") != "", F.xxhash64("name", blank("second")))
    picked = read.select("key", "address", "zip", F.when(F.col("own").isNull(), content).otherwise(F.xxhash64("own", F.lit("own"))).alias("entity"), nid.alias("nid"), "name", "second", "latitude", "longitude", "host")
    schema = f"key {kind}, entity bigint, nid bigint, name string, second string, latitude double, longitude double, host string, " + ", ".join(f"{f} string" for f in plots.FIELDS) + ", latin boolean"
    return picked.mapInArrow(scan, schema)


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both tables without their keys; ``own`` tells the left ones."""
    return left.drop("key").withColumn("own", F.lit(True)).unionByName(right.drop("key").withColumn("own", F.lit(False)))


def located(rows: DataFrame) -> DataFrame:
    """The rows with municipality, town and plot completed from what the corpus says about postcodes."""
    forms = cut(plots.complete(rows.select(*plots.FIELDS, "latin")))
    identity = F.xxhash64(*[F.coalesce(F.col(f), F.lit("\0")) for f in plots.FIELDS], "latin")
    areas = forms.select(identity.alias("form"), "municipality2", "town2")
    known = forms.where("postcode is not null and municipality2 is not null").groupBy("postcode", "municipality2").agg(F.count("*").alias("n"))
    zips = known.groupBy("postcode").agg(F.max_by("municipality2", F.struct("n", "municipality2")).alias("zip_municipality"))
    # the first three digits stand for a municipality where nine in ten readings agree; that bears a wrong digit after them
    heads = known.groupBy(F.substring("postcode", 1, 3).alias("head"), "municipality2").agg(F.sum("n").alias("n")).groupBy("head").agg(F.max_by("municipality2", F.struct("n", "municipality2")).alias("head_municipality"), (F.max("n") / F.sum("n")).alias("share")).where("share >= 0.9").drop("share")
    full = rows.withColumn("form", identity).withColumn("parsed", F.col("town")).join(large(areas), "form", "left").join(large(zips), "postcode", "left").join(heads, F.substring("postcode", 1, 3) == F.col("head"), "left")
    area = F.coalesce("municipality2", "municipality", "zip_municipality", "head_municipality")
    plot = F.when(F.col("municipality2").isNotNull() & F.col("town2").isNotNull() & F.col("numbers").isNotNull(), F.xxhash64("municipality2", "town2", "numbers"))
    return full.select("own", "entity", "nid", area.alias("area"), F.col("town2").alias("town"), plot.alias("plot"), "numbers", "latitude", "longitude", "host", F.when(F.col("latin"), F.col("parsed")).alias("latin_town"))


def place_words(rows: DataFrame, places: tuple) -> DataFrame:
    """(what, word, value): "p" towns and areas that names may begin with, "q" native places of romanised ones.

    Towns come from the addresses of all rows, romanised ones with the native town mostly read for them; areas come from the
    gazetteer with and without their suffix.
    """
    fixed = set()
    for _, name, aliases, kind, _, english in places:
        if not name:
            continue
        plain = N.hiragana(A.fold_name(name))
        short = plain[:-1] if plain[-1] in "都道府県市区町村" and len(plain) > 2 else plain
        for w in {plain, short}:
            fixed.add(("p", w, short))
        if kind != "WARD":
            for x in (english, *(a for a in aliases or () if a and a.isascii())):
                if x:
                    fixed.add(("q", N.romaji(A._latin_area(x)).replace("-", ""), short))
    gazetteer = rows.sparkSession.createDataFrame(sorted(fixed), "what string, word string, value string")
    own = _native(F.col("town"))
    spelled = F.when(F.col("latin_town").isNotNull(), F.transform(F.array_distinct(F.array(F.col("latin_town"), F.regexp_replace("latin_town", "-(cho|machi|dori|mura|shi)$", ""))), lambda w: F.struct(F.lit("q").alias("what"), F.regexp_replace(N.romaji_column(w), "[- ]", "").alias("word"), own.alias("value"))))
    said = F.array_compact(F.concat(F.array(F.struct(F.lit("p").alias("what"), own.alias("word"), own.alias("value"))), F.coalesce(spelled, F.array().cast("array<struct<what:string,word:string,value:string>>"))))
    towns = rows.where(F.col("town").isNotNull() & ~F.col("town").rlike(r"^[\x00-\x7f]+$")).select("town", "latin_town").distinct().select(F.explode(said).alias("x")).select("x.*")
    return towns.unionByName(gazetteer).groupBy("what", "word").agg(F.max("value").alias("value"))


def _native(text: Column) -> Column:
    """Katakana to hiragana, as names are folded; the small ke between place names stays."""
    kata = "".join(chr(c) for c in range(0x30A1, 0x30F5))
    return F.translate(text, kata, "".join(chr(ord(c) - 0x60) for c in kata))


def lexicon(parsed: DataFrame, rows: DataFrame, places: tuple) -> DataFrame:
    """Places and learned readings; a reading of a place also makes the romanised word that place, any other is a plain word."""
    known = cut(place_words(rows, places))
    learned = N.learn_readings(parsed).join(large(known.where("what = 'p'").select("word", F.col("value").alias("place"))), "word", "left")
    place = F.col("place").isNotNull() & (F.length("word") > 1)
    row = lambda what, word, value: F.struct(F.lit(what).alias("what"), F.col(word).alias("word"), value.alias("value"))
    said = learned.select(F.explode(F.array(row("r", "word", F.col("reading")), F.when(place, row("q", "reading", F.col("place"))).otherwise(row("w", "reading", F.lit(""))))).alias("x")).select("x.*")
    return known.unionByName(said).groupBy("what", "word").agg(F.max("value").alias("value"))


def name_forms(rows: DataFrame, rewritten: DataFrame) -> DataFrame:
    """(own, entity, key, raw, rule, place, first, n) of all rewritings of all names of an entity.

    A form without a place is left out where the entity has the same form with one.
    """
    seen = rows.where("nid is not null").groupBy("own", "entity", "nid").agg(F.count("*").alias("n"))
    each = seen.join(large(rewritten), "nid").groupBy("own", "entity", "key", "raw", "rule", "place").agg(F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("first"))
    placed = F.max(F.col("place").isNotNull()).over(Window.partitionBy("own", "entity", "key"))
    return each.withColumn("placed", placed).where("place is not null or not placed").drop("placed")


def entities(rows: DataFrame, forms: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row per entity: main key and kind of its names, the majority of its area, town, plot, numbers and host, and its median
    location. Ties go to the greater value. The values of all fields are counted in one pass over long rows."""
    kinded = rows.join(large(kinds), "nid", "left")
    fields = {f: F.col(f).cast("string") for f in ("area", "town", "plot", "numbers", "host", "kind")}
    long = kinded.select("own", "entity", F.explode(F.array(*[F.struct(F.lit(i).alias("field"), v.alias("v")) for i, v in enumerate(fields.values())])).alias("x")).select("own", "entity", "x.field", "x.v", F.lit(1).cast("bigint").alias("n")).where("v is not null")
    main = forms.where("first > 0").select("own", "entity", F.lit(len(fields)).alias("field"), F.col("key").alias("v"), F.col("first").alias("n"))
    best = long.unionByName(main).groupBy("own", "entity", "field", "v").agg(F.sum("n").alias("n")).groupBy("own", "entity", "field").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    wide = best.groupBy("own", "entity").agg(*[F.max(F.when(F.col("field") == i, F.col("v"))).alias(k) for i, k in enumerate([*fields, "main"])])
    base = rows.groupBy("own", "entity").agg(F.percentile_approx("latitude", 0.5).alias("latitude"), F.percentile_approx("longitude", 0.5).alias("longitude"))
    return base.join(large(wide), ["own", "entity"], "left").withColumn("plot", F.col("plot").cast("bigint"))


PROFILE = ("main", "kind", "area", "town", "plot", "numbers", "host", "latitude", "longitude")


def same_numbers(a: str, b: str) -> Column:
    """Street numbers of two or more figures that agree within one area: one plot even where the town carries a slip."""
    n = F.col(f"{a}_numbers")
    return F.coalesce((F.col(f"{a}_area") == F.col(f"{b}_area")) & (n == F.col(f"{b}_numbers")) & n.contains("-"), F.lit(False))


def _less_one(text: Column) -> Column:
    """The text and the text less one character each."""
    return F.array_distinct(F.concat(F.array(text), F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))))


def meetings(everyone: DataFrame, forms: DataFrame) -> DataFrame:
    """(a, b, how, spread): left and right entities that share a form. how: 4 key and place, 3 key, 2 key of different places, 1 a
    key with one slip, 0 part of a key on one plot. spread: how many places of the area have the key.
    """
    c = F.col
    at = everyone.select("own", "entity", "area", "town", "plot")
    full = cut(forms.select("own", "entity", "key", "raw", "rule", "place").join(large(at), ["own", "entity"]))
    own = c("rule") == "own"
    here = F.when(c("area").isNotNull(), F.xxhash64("area", "rule", "key"))
    anywhere = F.when(own & c("place").isNotNull(), F.xxhash64(F.lit("anywhere"), "key", "place"))
    held = full.select("own", "entity", "place", "town", "plot", "area", ((c("rule") != "initial") | (c("raw") == "i")).alias("plain"), F.explode(F.array(F.struct(F.lit(True).alias("here"), here.alias("h")), F.struct(F.lit(False).alias("here"), anywhere.alias("h")))).alias("x")).select("*", "x.here", "x.h").drop("x").where("h is not null")
    # places of a form within the area, and areas of a form with its place
    spread = held.groupBy("h").agg(F.count_distinct(F.when(c("here"), c("place"))).alias("places"), F.count_distinct(F.when(c("here") & c("own"), c("town"))).alias("towns"), F.count_distinct(F.when(~c("here"), c("area"))).alias("areas"))
    wide = held.join(large(spread), "h").withColumn("spread", F.greatest("places", "towns", F.lit(1))).where("here or areas = 1")
    # a rare form meets as it is; one of many places together with what is to confirm it
    confirmed = F.array_compact(F.array(*[F.when(c(x).isNotNull(), F.xxhash64("h", F.lit(x), x)) for x in ("place", "town", "plot")]))
    keyed = wide.select("own", "entity", "place", "plain", "here", c("area").isNull().alias("lost"), F.when(c("here"), c("spread")).otherwise(1).alias("spread"), F.explode(F.when(c("here") & (c("spread") > SPREAD), confirmed).otherwise(F.array("h"))).alias("k"))
    # beginnings and ends of keys on one plot
    ends = F.array_distinct(F.array(F.xxhash64("plot", F.substring("key", 1, 6)), F.xxhash64("plot", F.lit("end"), F.expr("right(key, 6)"))))
    part = full.where(own & c("plot").isNotNull()).select("own", "entity", F.lit(None).cast("string").alias("place"), F.lit(True).alias("plain"), F.lit(None).cast("boolean").alias("here"), F.lit(False).alias("lost"), F.lit(None).cast("bigint").alias("spread"), F.explode(ends).alias("k")).distinct()
    keys = cut(keyed.unionByName(part))
    side = lambda f, s: f.select("k", "here", *[c(x).alias(f"{s}_{x}") for x in ("entity", "place", "plain", "lost", "spread")])
    met = side(keys.where("own"), "a").join(large(side(keys.where("not own"), "b").drop("here")), "k").where("(a_plain or b_plain) and (here is null or here or a_lost or b_lost)")
    agree = F.when(c("here").isNull(), 0).when(c("a_place") == c("b_place"), 4).when(c("a_place").isNull() | c("b_place").isNull(), 3).otherwise(2)
    met = met.select(c("a_entity").alias("a"), c("b_entity").alias("b"), agree.alias("how"), F.least("a_spread", "b_spread").alias("spread"))
    every = met.unionByName(slips(full))
    return every.groupBy("a", "b").agg(F.max("how").alias("how"), F.min(F.when(c("how") >= 2, c("spread"))).alias("spread"))


def slips(full: DataFrame) -> DataFrame:
    """(a, b, how 1, spread 1) of entities of one area with a key or a raw form that differ by one character left out, added or
    swapped with its neighbour. Only words unknown to the other side count as slips.

    The index holds hashes of the distinct words less one character; the words themselves are compared only where these meet.
    """
    c = F.col
    told = F.array(F.struct(F.lit("k").alias("s"), c("key").alias("word")), F.struct(F.lit("r").alias("s"), c("raw").alias("word")))
    words = full.where("area is not null and rule = 'own'").select("own", "entity", "area", "place", F.explode(told).alias("x")).select("own", "entity", "area", "place", "x.s", "x.word")
    words = words.where("length(word) <= 60 and (s = 'k' and length(word) >= 7 or s = 'r' and length(word) >= 3 and word rlike '[^\\x00-\\x7f]')").withColumn("w", F.xxhash64("area", "s", "word"))
    known = cut(words.groupBy("w", "area", "s", "word").agg(F.max("own").alias("left"), F.min("own").alias("all_left")).select("w", "area", "s", "word", "left", (~c("all_left")).alias("right")))
    index = known.select("w", "left", "right", F.explode(F.transform(_less_one(c("word")), lambda x: F.xxhash64("area", "s", x))).alias("h"))
    x, y = index.where("left").select(c("w").alias("x"), (~c("right")).alias("x_alone"), "h"), index.where("right").select(c("w").alias("y"), (~c("left")).alias("y_alone"), "h")
    near = x.join(large(y), "h").where("x != y and (x_alone or y_alone)").select("x", "y").distinct()
    word = lambda n: known.select(c("w").alias(n), c("word").alias(f"{n}_word"))
    letters = lambda w: F.sort_array(F.split(w, ""))
    one = (F.abs(F.length("x_word") - F.length("y_word")) == 1) | ((F.length("x_word") == F.length("y_word")) & (letters(c("x_word")) == letters(c("y_word"))))
    near = near.join(large(word("x")), "x").join(large(word("y")), "y").where(one).select("x", "y")
    side = lambda f, n, s: f.select(c("w").alias(n), c("entity").alias(s), c("place").alias(f"p{s}")).distinct()
    found = near.join(large(side(words.where("own"), "x", "a")), "x").join(large(side(words.where("not own"), "y", "b")), "y").where("pa is null or pb is null or pa = pb")
    return found.select("a", "b", F.lit(1).alias("how"), F.lit(1).cast("bigint").alias("spread"))


def with_profiles(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select(F.col("entity").alias("a"), *[F.col(x).alias(f"a_{x}") for x in PROFILE])
    b = right.select(F.col("entity").alias("b"), *[F.col(x).alias(f"b_{x}") for x in PROFILE])
    return pairs.join(large(a), "a").join(large(b), "b")


def close_names() -> Column:
    """Main keys that differ in few letters for their length."""
    return F.coalesce(F.levenshtein("a_main", "b_main") <= F.greatest(F.length("a_main"), F.length("b_main")) * 0.34, F.lit(False))


def same_names(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, score) of entities that meet: the chance that they name the same congregation.

    The rarity of the rewriting gives the odds, one place against the other places of the area that share it; the address
    multiplies them. Another area without the same plot rules a pair out.
    """
    pair = with_profiles(pairs, left, right)
    c = F.col
    same_plot = F.coalesce(c("a_plot") == c("b_plot"), F.lit(False)) | same_numbers("a", "b")
    same_town = F.coalesce((c("a_town") == c("b_town")) & (c("a_area") == c("b_area")), F.lit(False))
    towns = c("a_town").isNotNull() & c("b_town").isNotNull()
    other_area = F.coalesce(c("a_area") != c("b_area"), F.lit(False))
    other_kind = F.coalesce(c("a_kind") != c("b_kind"), F.lit(False))
    rare = 1 / F.coalesce("spread", F.lit(1))
    odds = rare / (1.35 - rare)
    odds = odds * F.when(c("how") == 4, 4.0).when(c("how") == 3, 1.0).when(c("how") == 2, 0.03).when(c("how") == 1, 0.25).otherwise(F.when(close_names(), 0.08).otherwise(0.005))
    odds = odds * F.when(same_plot, 60.0).when(same_town, 10.0).when(towns, 0.4).otherwise(1.0) * F.when(other_kind, 0.25).otherwise(1.0)
    return pair.select("a", "b", F.when(other_area & ~same_plot, 0.0).otherwise(odds / (1 + odds)).alias("score"))


def to_rows(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Entity pairs as pairs of row keys."""
    a = left.select(F.col("entity").alias("a"), F.col("key").alias("left_key"))
    b = right.select(F.col("entity").alias("b"), F.col("key").alias("right_key"))
    return a.join(large(pairs), "a").join(large(b), "b").select("left_key", "right_key", "score")


def meet(left: DataFrame, right: DataFrame, places: tuple, affiliations: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left entities, right entities, meetings) of two tables of sightings. Tables in between are checkpointed."""
    rows = cut(located(both_sides(left, right)))
    name = ["nid", "name", "second"]
    names = left.select(*name).unionByName(right.select(*name)).where("nid is not null").groupBy("nid").agg(F.max("name").alias("name"), F.max("second").alias("second"))
    parsed = cut(N.parse_names(names, affiliations))
    rewritten = N.rewrite_names(parsed, cut(lexicon(parsed, rows, places)))
    forms = cut(name_forms(rows, rewritten))
    everyone = cut(entities(rows, forms, parsed.select("nid", "kind")))
    met = cut(meetings(everyone, forms))
    return everyone.where("own"), everyone.where("not own"), met
