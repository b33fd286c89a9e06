import random

import pytest

from parvis.llm import leakage


def semi_global(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (a != b)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        assert leakage.myers(p, t) == semi_global(p, t)


def test_fold():
    assert leakage.fold("Ｔｈｅ  Quick-\nBROWN_fox!") == "thequickbrownfox"
    assert leakage.fold(None) == "" and leakage.fold(" … ") == ""


ITEM = "In exchange for a sack of barley, two rival bakers ransomed both the anvil and the gilded ferry from the pass above the town. The last beekeeper counted the narrow loom at the lane under a borrowed name before the winter came."
OTHER = "No ledger was as crooked as the one a blind cartographer lowered near the pass above the river, and nobody in the whole valley could remember when the market had last been open on a Sunday morning in autumn."


def slip(text, r, n):
    s = list(text)
    for _ in range(n):
        i = r.randrange(len(s))
        s[i : i + 1] = r.choice([[], ["x"], [s[i], s[i]]])
    return "".join(s)


@pytest.fixture(scope="module")
def leaks(spark):
    r = random.Random(5)
    filler = "The choir met in the hall and shared bread. " * 30
    docs = [
        (1, filler + ITEM + filler), (2, filler + ITEM.upper().replace(" ", "  \n") + filler), (3, slip(ITEM, r, 6)), (4, ITEM[: int(len(ITEM) * 0.62)] + filler), (5, filler + ITEM[: int(len(ITEM) * 0.35)] + filler),
        (6, filler), (7, None), (8, ""), (9, "x" * 2_000_000), (10, filler + OTHER[30:]), (1, filler + ITEM + filler), (None, ITEM),
    ]
    d = spark.createDataFrame([(a, b, "en", 1) for a, b in docs], "doc_id bigint, text string, item_id string, i int")
    items = spark.createDataFrame([(1, ITEM, "x"), (2, OTHER, "x"), (3, None, "x"), (4, " ", "x"), (None, ITEM, "x")], "item_id bigint, text string, doc_id string")
    return d, items


def test_found_pairs(leaks):
    got = sorted((r["doc_id"], r["item_id"]) for r in leakage.find_leaks(*leaks).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (10, 2)]


def test_blocks_of_items_change_nothing(leaks):
    a = {tuple(r) for r in leakage.find_leaks(*leaks).collect()}
    b = {tuple(r) for r in leakage.find_leaks(*leaks, block_chars=100).collect()}
    assert a == b


def test_empty_tables(leaks):
    d, items = leaks
    assert leakage.find_leaks(d.where("false"), items).count() == 0
    assert leakage.find_leaks(d, items.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_keys_of_any_kind(spark, kind):
    d = spark.createDataFrame([(1, ITEM), (2, "x")], "doc_id bigint, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    items = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string").selectExpr(f"cast(item_id as {kind}) as item_id", "text")
    assert [(str(r["doc_id"]), str(r["item_id"])) for r in leakage.find_leaks(d, items).collect()] == [("1", "7")]


def test_random_slips_lose_no_passage():
    """Passages of a little more than half with slips up to the rate, anywhere in the item, in any surroundings."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8))) for _ in range(300)]
    lost = 0
    for n in range(150):
        item = " ".join(r.choice(words) for _ in range(r.randint(25, 60)))
        folded = leakage.fold(item)
        half = len(folded) // 2 + 1
        length = int(len(folded) * 0.56)
        at = r.randint(0, len(folded) - length)
        passage = slip(folded[at : at + length], r, int(0.07 * half * r.random()))
        doc = " ".join(r.choice(words) for _ in range(80)) + passage + " ".join(r.choice(words) for _ in range(80))
        lost += not list(leakage.Index([(1, item)], leakage.RATE).search(doc))
    assert lost == 0


def test_shortest_passage_against_all_windows():
    r = random.Random(2)
    for _ in range(60):
        item = "".join(r.choice("abcd") for _ in range(60))
        region = slip(item[r.randint(0, 20) :][:40], r, r.randint(0, 6)) + "".join(r.choice("abcd") for _ in range(20))
        want = any(leakage.myers(item[i : i + 31], region) <= 3 and leakage.myers(item[i : i + 12], region) <= 2 and leakage.myers(item[i + 19 : i + 31], region) <= 2 for i in range(30))
        assert (leakage.shortest_passage(item, region, 31, 3) is not None) == want
