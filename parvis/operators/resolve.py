"""Entity resolution: blocks, candidates, assignment and rule cascades."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parvis.functions import similarity


MOST_RULES = 100_000
GRAM_BUCKETS = 16_384
GRAM_NUMBERS = 2**42


def blocked_pairs(left: DataFrame, right: DataFrame, *, key: str, blocks: Callable[[], Column]) -> DataFrame:
    """(a, b): keys of rows that share a block key; ``blocks`` gives an array of keys, nulls are left out."""
    a = left.select(F.col(key).alias("a"), F.explode(F.array_distinct(F.array_compact(blocks()))).alias("block"))
    b = right.select(F.col(key).alias("b"), F.explode(F.array_distinct(F.array_compact(blocks()))).alias("block"))
    return a.join(b, "block").select("a", "b").distinct()


def name_blocks(name: str, postal: str | None, address: str | None) -> Column:
    """Name itself, n-grams of it, postal code and the last eight characters of the address."""
    n = F.when(F.length(name) >= 5, 3).otherwise(2)
    keys = F.concat(F.array(F.concat(F.lit("n:"), F.col(name))), F.transform(similarity.grams(F.col(name), n), lambda g: F.concat(F.lit("g:"), g)))
    if postal:
        keys = F.concat(keys, F.array(F.concat(F.lit("p:"), F.nullif(postal, F.lit("")))))
    if address:
        keys = F.concat(keys, F.array(F.when(F.length(address) >= 8, F.concat(F.lit("a:"), F.right(address, F.lit(8))))))
    return keys


def gram_candidates(left: DataFrame, right: DataFrame, *, key: str, text: str, most: int = 80) -> DataFrame:
    """(a, b, shared): the right rows that share most bigrams with each left row, at most ``most``, ties by key."""
    from parvis.operators.dedupe import top_per_group

    bigrams = lambda side, name: side.select(F.col(key).alias(name), F.explode(similarity.grams(F.col(text), 2)).alias("g"))
    shared = bigrams(left, "a").join(bigrams(right, "b"), "g").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return top_per_group(shared, ["a"], [F.col("shared").desc(), F.col("b")], most).drop("rank")


def among_gram_candidates(pairs: DataFrame, right: DataFrame, most: int = 80, proofs: tuple[int, ...] = (500, 4_000)) -> DataFrame:
    """(x, y, b): the rows (b, y) of right whose name is paired with x in ``pairs`` (x, y) and that gram_candidates keeps for x.

    Only the rank of these pairs is worked out, over distinct names. Names that share s of g bigrams with x have one of any
    g - s + 1 of them; the rarest are taken. A pair is left out early where the names met by fewer of the rarest, of about so many
    rows as ``proofs`` says, already hold ``most`` better rows; the rest is ranked among all names.
    """
    from parvis.session import cut, large

    c, numbers = F.col, lambda n: gram_numbers(F.col(n), 2)
    bits = lambda n: [bit_word(F.transform(numbers(n), lambda g: bit_of(g)), w).alias(f"{n}_grams{w}") for w in (0, 1)]
    asked = cut(pairs.select("x", "y").distinct().select("x", "y", F.size(F.array_intersect(numbers("x"), numbers("y"))).alias("shared")).where("shared > 0"))
    names = cut(spread_names(right, "y", F.count("*").alias("n")).select("y", "n", numbers("y").alias("ys"), *bits("y")))
    held = gram_classes(names.select(F.explode("ys").alias("g")), c("g"))
    ranked = spread_names(asked, "x").select("x", ranked_grams(numbers("x"), held).alias("ranked"), *bits("x"))
    rows = lambda g: F.when(g >= GRAM_NUMBERS, F.pow(F.lit(2.0), (F.floor(g / GRAM_NUMBERS) - 1) / 4)).otherwise(0.0)
    upto = F.transform("ranked", lambda g, i: F.aggregate(F.slice("ranked", F.lit(1), i + 1), F.lit(0.0), lambda n, h: n + rows(h)))
    rarest = cut(ranked.select("x", F.transform("ranked", lambda g: g % GRAM_NUMBERS).alias("xs"), upto.alias("upto"), "x_grams0", "x_grams1"))

    def met(open_: DataFrame, budget: int | None) -> DataFrame:
        """(x, y, n, shared) of names that share as many bigrams with x as its last open pair, each once: at its first common bigram."""
        own = large(open_.groupBy("x").agg(F.min("shared").alias("least"))).join(large(rarest), "x")
        enough = F.size("xs") - c("least") + 1
        if budget is not None:
            enough = F.least(enough, F.greatest(F.lit(1), F.size(F.filter("upto", lambda n: n <= budget))))
        own = own.select("x", "xs", "least", "x_grams0", "x_grams1", F.posexplode(F.slice("xs", F.lit(1), enough)).alias("at", "g"))
        wanted = gram_classes(own, c("g"))
        ys = names.select("*", F.explode(F.filter("ys", lambda g: wanted(g) > 0)).alias("g"))
        # bits that y lacks stand for at least as many of x's bigrams, and of x's g bigrams g - s may lack. Only pairs within that
        # are compared, as numbers
        near = large(own).join(large(ys), "g").where(lacking("x_grams", "y_grams") <= F.size("xs") - c("least"))
        near = near.where((c("at") == 0) | ~F.arrays_overlap(F.slice("xs", F.lit(1), c("at")), "ys"))
        return near.select("x", "y", "n", "least", F.size(F.array_intersect("xs", "ys")).alias("shared")).where("shared >= least").drop("least")

    above = F.coalesce(F.sum("n").over(Window.partitionBy("x").orderBy(F.col("shared").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = lambda found, open_: large(found.groupBy("x", "shared").agg(F.sum("n").alias("n")).select("x", "shared", "n", (most - above).alias("room"))).join(large(open_.select("x", "shared").distinct()), ["x", "shared"])
    open_ = asked
    for budget in proofs:
        seen = open_.select("x", "shared", F.lit(0).alias("n")).distinct().unionByName(met(open_, budget).select("x", "shared", "n"))
        open_ = cut(large(open_).join(large(levels(seen, open_).where("room > 0").select("x", "shared")), ["x", "shared"]).select("x", "y", "shared"))
    full = cut(met(open_, None))
    last = cut(levels(full, open_).where("room > 0"))
    whole = large(large(open_).join(large(last.where("n <= room")), ["x", "shared"])).join(large(right), "y").select("x", "y", "b")
    # ties for the last places go by key; no name fills more of them than ``most`` of its rows
    leading = right.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("b"))).where(F.col("rank") <= most).drop("rank")
    ties = large(large(full.drop("n")).join(large(last.where("n > room").drop("n")), ["x", "shared"])).join(large(leading), "y")
    ties = large(ties.withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy("b"))).where("rank <= room").select("x", "y", "b")).join(large(open_.select("x", "y")), ["x", "y"], "left_semi")
    return whole.unionByName(ties)


def gram_classes(rows: DataFrame, gram: Column) -> Callable[[Column], Column]:
    """Classes of frequency of grams, in a table of GRAM_BUCKETS bytes: 0 where none of ``gram``'s bucket is in the rows, else one more
    than four times the binary logarithm. An order by class, then by gram is the same for all rows and needs no join."""
    bucket = lambda g: F.pmod(F.xxhash64(g), F.lit(GRAM_BUCKETS)).cast("int")
    held = bytearray(GRAM_BUCKETS)
    for b, n in rows.select(bucket(gram).alias("b")).groupBy("b").agg(F.count("*")).collect():
        held[b] = 1 + min(126, int(4 * math.log2(n)))
    table = F.lit(bytes(held))
    return lambda g: F.ascii(F.substring(table, bucket(g) + 1, F.lit(1)).cast("string"))


def gram_numbers(c: Column, n: int) -> Column:
    """The n-grams of a string, n at most 2, each as the number of its code points, under GRAM_NUMBERS."""
    return F.transform(similarity.grams(c, n), lambda g: F.ascii(g).cast("bigint") * 2_097_152 + F.ascii(F.substring(g, 2, 1)))


def ranked_grams(numbers: Column, classes: Callable[[Column], Column]) -> Column:
    """The grams from the rarest to the most frequent, each with its class above its number."""
    return F.array_sort(F.transform(numbers, lambda g: classes(g).cast("bigint") * GRAM_NUMBERS + g))


def bit_of(*c: Column) -> Column:
    """Which of 128 bits stands for a value."""
    return F.pmod(F.xxhash64(*c), F.lit(128)).cast("int")


def bit_word(hs: Column, w: int) -> Column:
    """The lower (w 0) or the upper 64 of the 128 bits numbered in ``hs``."""
    return F.aggregate(hs, F.lit(0).cast("bigint"), lambda m, h: m.bitwiseOR(F.when(F.floor(h / 64) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), h % 64)).otherwise(0)))


def lacking(a: str, b: str) -> Column:
    """How many of the 128 bits in columns a0, a1 are unset in b0, b1."""
    return F.bit_count(F.col(f"{a}0").bitwiseAND(F.bitwise_not(f"{b}0"))) + F.bit_count(F.col(f"{a}1").bitwiseAND(F.bitwise_not(f"{b}1")))


def spread_names(side: DataFrame, name: str, *aggs: Column) -> DataFrame:
    """The names, each once, over all tasks: few bytes, but much work each. Kept, as they are read more than once."""
    from parvis.session import cut

    spread = side.select(name).repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), name)
    return cut(spread.groupBy(name).agg(*aggs) if aggs else spread.distinct())


def containing_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y): all pairs of non-blank names of which one equals or contains the other; left (x), right (y).

    A name that holds the shorter one holds all its bigrams: the one that fewest names have joins it with them, in both directions.
    """
    from parvis.session import large

    left, right = spread_names(left.where("x != ''"), "x"), spread_names(right.where("y != ''"), "y")

    def within(long: DataFrame, x: str, short: DataFrame, y: str) -> DataFrame:
        every = F.array_union(gram_numbers(F.col(x), 2), gram_numbers(F.col(x), 1))  # single ones for names of one character
        held = gram_classes(long.select(F.explode(every).alias("g")), F.col("g"))
        rarest = short.select(y, F.get(ranked_grams(gram_numbers(F.col(y), 2), held), F.lit(0)).alias("g")).where(F.col("g") >= GRAM_NUMBERS)
        rarest = rarest.select(y, (F.col("g") % GRAM_NUMBERS).alias("g"))
        asked = gram_classes(rarest, F.col("g"))
        holders = long.select(x, F.explode(F.filter(every, lambda g: asked(g) > 0)).alias("g"))
        return large(holders).join(large(rarest), "g").where(F.col(x).contains(F.col(y))).select("x", "y")

    return within(left, "x", right, "y").union(within(right, "y", left, "x").where("x != y"))


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(x, y, name_score): all pairs of names whose fuzzy score is at least ``least`` (over 0); left (x), right (y).

    Candidates by an equi-join of the rarest grams of x with those of y, as many of each as leave no such pair out. Of g grams a
    dice score d needs d / (2 - d) * g shared, so one of any g - that + 1 is shared; k edits touch at most k characters and 2k
    bigrams of a name, so one of any k + 1 or 2k + 1 stays. As both sides rank grams in one order, two names that share as many
    also share one of the rarest of both. Bigrams serve names of four characters or more, as in the score.

    Names move with their grams and their characters as 128 bits each (a character that recurs counts each time): bits that one
    side lacks stand for at least as many members that it lacks. Of n grams in both a dice score d lets (1 - d) * n lack on either
    side, k edits let 2k grams and k characters lack on each. Only pairs within that are scored.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    from parvis.session import large

    left, right = spread_names(left.where("trim(x) != ''"), "x"), spread_names(right.where("trim(y) != ''"), "y")
    bigram_edits = 4 * (2 * least - 1) >= 2  # else two names within the edits may share no bigram

    def bits(name: str) -> list[Column]:
        c = F.col(name)
        each = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: bit_of(F.substring(c, i, F.lit(1)), i - F.length(F.replace(F.substring(c, F.lit(1), i), F.substring(c, i, F.lit(1)), F.lit("")))))
        return [bit_word(hs, w).alias(f"{name}_{kind}{w}") for kind, hs in (("grams", F.transform("made", lambda g: bit_of(g))), ("chars", each)) for w in (0, 1)]

    def keys(side: DataFrame, name: str, kinds: list[tuple[str, int, Column]]) -> DataFrame:
        gs = lambda n: gram_numbers(F.col(name), n)
        each = [F.when(use, F.struct(F.lit(k).alias("k"), gs(n).alias("keys"), gs(2 if k in "be" else 1).alias("made"))) for k, n, use in kinds]
        held = side.select(name, F.explode(F.array_compact(F.array(*each))).alias("of")).select(name, "of.*")
        return held.select(name, "k", "keys", F.size("made").alias(f"{name}_made"), F.length(name).alias(f"{name}_length"), *bits(name))

    x, y = F.length("x"), F.length("y")
    both, one = (lambda n: n >= 4), (lambda n: n < 4)
    kinds = lambda n, own: [("s", 1, one(n) if own else F.lit(True)), ("l", 1, both(n) if own else one(n)), ("b", 2, both(n)), *([] if bigram_edits else [("e", 1, both(n))])]
    xs, ys = keys(left, "x", kinds(x, True)), keys(right, "y", kinds(y, False))
    held = gram_classes(ys.select(F.explode("keys").alias("g")), F.col("g"))

    def rarest(side: DataFrame, name: str) -> DataFrame:
        edits = F.floor((1 - least) / least * F.length(name) + 1e-9)
        size = F.size("keys")
        by_dice, by_edit = size - F.ceil(least / (2 - least) * size - 1e-9) + 1, F.when(F.col("k") == "b", 2 * edits + 1).otherwise(edits + 1)
        needed = F.when(F.col("k") == "e", by_edit).when((F.col("k") == "b") & F.lit(not bigram_edits), by_dice).otherwise(F.greatest(by_dice, by_edit))
        few = F.slice(ranked_grams(F.col("keys"), held), F.lit(1), needed.cast("int"))
        return side.select("*", F.explode(few).alias("g")).drop("keys")

    met = large(rarest(xs, "x")).join(large(rarest(ys, "y")), ["k", "g"])
    c = F.col
    lacks = lambda kind, a, b: lacking(f"{a}_{kind}", f"{b}_{kind}")
    longer = F.greatest("x_length", "y_length")
    edits = F.floor((1 - least) * longer + 1e-9).cast("int")
    may_dice = lacks("grams", "x", "y") + lacks("grams", "y", "x") <= (1 - least) * (c("x_made") + c("y_made")) + 1e-9
    may_edit = (F.abs(c("x_length") - c("y_length")) <= edits) & (lacks("chars", "x", "y") <= edits) & (lacks("chars", "y", "x") <= edits) & (lacks("grams", "x", "y") <= 2 * edits) & (lacks("grams", "y", "x") <= 2 * edits)
    # scored where they meet: the pairs are many times the names, so that only those that pass are moved. Within explode the
    # score isn't drawn into the join, where it would be worked out without compiled code
    away = F.call_function("levenshtein", c("x"), c("y"), edits)  # -1 beyond
    score = F.when(c("x") == c("y"), 1.0).otherwise(F.greatest(F.when(may_dice, similarity.dice(c("x"), c("y"))), F.when(may_edit & (away >= 0), 1.0 - away / longer)))  # similarity.fuzzy
    scored = met.where(may_dice | may_edit).select("x", "y", F.explode(F.array(score)).alias("name_score"))
    return scored.where(F.col("name_score") >= least).distinct()


def identities(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, confidence): pairs of (key, name, address, postal) that share one of name_blocks and that the ladder of evidence holds for one.

    Of the pairs of a block only those are made that a rung can hold for: with names 0.82 alike, of one postal code, or of one
    address (only equal addresses reach 0.96). Grams that nearly all names share, such as the word for church, so cost nothing.
    """
    blocks = F.array_compact(name_blocks("name", "postal", "address"))
    side = lambda rows, k: rows.withColumn("blocks", blocks).select(F.col("key").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("name", "address", "postal", "blocks")])
    a, b = side(left, "a"), side(right, "b")
    alike = similar_names(a.select(F.col("a_name").alias("x")), b.select(F.col("b_name").alias("y")), 0.82).select("x", "y")
    met = a.join(b, F.col("a_postal") == F.col("b_postal")).select("a", "b")
    met = met.union(a.join(alike, F.col("a_name") == F.col("x")).join(b, F.col("b_name") == F.col("y")).where(F.arrays_overlap("a_blocks", "b_blocks")).select("a", "b"))
    met = met.union(a.join(b, (F.col("a_address") == F.col("b_address")) & (F.col("a_address") != "")).where(F.arrays_overlap("a_blocks", "b_blocks")).select("a", "b")).distinct()
    pairs = met.join(a, "a").join(b, "b").where("a_postal is null or b_postal is null or a_postal = b_postal")
    c = F.col
    na, nb, aa, ab = c("a_name"), c("b_name"), c("a_address"), c("b_address")
    score = similarity.identity_confidence(same_site=F.lit(False), postal_a=c("a_postal"), postal_b=c("b_postal"), same_name=(na == nb) & (na != ""), blank_address=(aa == "") | (ab == ""), name=similarity.fuzzy(na, nb), stem=similarity.stem_score(na, nb), address=similarity.address_score(aa, ab))
    return pairs.select("a", "b", score.alias("confidence")).where("confidence is not null")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """One-to-one assignment of (a, b, score): in each round the pairs that are best for both sides are taken.

    Equal to taking pairs by falling score (ties by a, then b), as that order is the same for both sides; every round is made of
    combinable aggregations, so no task sees all pairs. Where all best pairs of some rows of both sides have one score and join
    each of them with each, as those of repeated rows do, all are taken at once, the first with the first and so on: nothing
    else can take these rows before. Every round takes at least the best pair left, so the rounds end.
    """
    from parvis.session import cut, large

    left, taken = cut(pairs.select("a", "b", "score")), None

    def best(own: str, other: str) -> DataFrame:
        """Of each row its best score, the first row that has it with it, and the count and a hash of all that have."""
        hashed = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(other)).alias("h"), F.bit_xor(F.xxhash64(F.lit(own), other)).alias("i"))
        levels = left.groupBy(own, "score").agg(hashed.alias("all"), F.min(other).alias("first"))
        return levels.groupBy(own).agg(F.max_by(F.struct("score", "all", "first"), "score").alias(f"of_{own}"))

    def ranked(own: str, other: str) -> DataFrame:
        """The place of each row among those with the same best rows, where all of these have the same best rows, too."""
        whole = (F.count("*") == F.first(f"of_{own}.all.n")) & (F.min(f"of_{other}.all") == F.max(f"of_{other}.all"))
        alike = edges.groupBy(own).agg(F.first(f"of_{own}.all").alias("all"), whole.alias("whole")).where("whole")
        return alike.select(own, F.row_number().over(Window.partitionBy("all").orderBy(own)).alias(f"rank_{own}"))

    while True:
        edges = left.join(large(best("a", "b")), "a").join(large(best("b", "a")), "b").where("score = of_a.score and score = of_b.score")
        edges = cut(edges)
        both = edges.join(large(ranked("a", "b")), "a", "left").join(large(ranked("b", "a")), "b", "left")
        won = cut(both.where("of_a.first = b and of_b.first = a or rank_a = rank_b").select("a", "b", "score"))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(large(won.select("a")), "a", "left_anti").join(large(won.select("b")), "b", "left_anti"))
        if left.isEmpty():
            return taken


def rule_matches(rows: DataFrame, rules: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, rule) where every matching rule agrees; rules (rule, term, veto BOOLEAN). Terms under three characters are ignored.

    Rule lists are written by hand; more than MOST_RULES are refused. They are met by containment, the one join that needs a nested loop.
    """
    usable = rules.where("length(term) >= 3 or veto")
    if usable.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    met = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(usable), F.expr("instr(text, term) > 0"))
    per_rule = met.groupBy("key", "rule").agg(F.max(F.col("veto")).alias("vetoed")).where("not vetoed")
    return per_rule.groupBy("key").agg(F.min("rule").alias("rule"), F.max("rule").alias("last")).where("rule = last").drop("last")


def cascade(steps: list[tuple[str, Column, Column]]) -> tuple[Column, Column, Column]:
    """(value, confidence, source) of the first step whose value isn't null; steps are (source, value, confidence)."""
    value, confidence, source = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, v, c in reversed(steps):
        value, confidence, source = F.when(v.isNotNull(), v).otherwise(value), F.when(v.isNotNull(), c).otherwise(confidence), F.when(v.isNotNull(), F.lit(name)).otherwise(source)
    return value, confidence, source


def score_by_model(requests: DataFrame, model: Callable[[list[dict]], list[float]], *, columns: list[str]) -> DataFrame:
    """Distinct requests scored by a callable and joined back; the callable stands for a model and gets batches."""
    distinct = requests.select(*columns).distinct()

    def run(batches):
        for b in batches:
            yield b.assign(score=pd.Series([min(1.0, max(0.0, float(x))) for x in model(b.to_dict("records"))], dtype="float64", index=b.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema)
    return requests.join(distinct.mapInPandas(run, schema + ", score double"), columns)
