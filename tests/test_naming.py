import random

import pytest
from pyspark.sql import functions as F

from parvis.functions import address as A, naming as N, similarity
from parvis.operators import official, resolve, social


def one(spark, column, a):
    return spark.createDataFrame([(a,)], "a string").select(column.alias("v")).first()["v"]


def test_public_names(spark):
    assert one(spark, N.public_name(F.col("a")), "（宗）光の丘教会 / ") == "光の丘教会"
    assert one(spark, N.public_name(F.col("a")), "宗教法人　星教会") == "星教会"


def test_title_languages(spark):
    t = lambda s: one(spark, N.title_languages(F.col("a")), s)
    assert t("光教会 Hikari Church") == ["en", "ja"] and t("한인교회") == ["ko"] and t("Igreja da Paz") == ["pt"] and t("Hoshi") == ["en"]


def test_denomination_parts(spark):
    assert one(spark, N.denomination_part(F.col("a"), "ja"), "光福音教団") == "光福音"
    assert one(spark, N.denomination_part(F.col("a"), "en"), "jec Church") == "JEC"
    assert one(spark, N.denomination_part(F.col("a"), "pt"), "Igreja Batista") == "Batista"


def test_contacts(spark):
    assert one(spark, N.phone(F.col("a")), "住所 TEL：03-1234-5678 FAX 03-0000-1111") == "03-1234-5678"
    assert one(spark, N.fax(F.col("a")), "TEL 03-1234-5678 FAX 03-0000-1111") == "03-0000-1111"
    assert one(spark, N.email(F.col("a")), "mail: office (at) a.example まで") == "office@a.example"
    assert one(spark, N.email(F.col("a")), "none") is None


def test_ministers(spark):
    rows = spark.createDataFrame([(1, "主任牧師：山田 太郎、佐藤 花 TEL 03-1111-2222"), (2, "牧師 未定"), (3, None), (4, "副牧師 鈴木一 伝道師：林 次郎")], "k int, t string")
    assert {tuple(r) for r in N.ministers(rows, key="k", text="t").collect()} == {(1, "senior_pastor", "山田 太郎"), (1, "senior_pastor", "佐藤 花"), (4, "associate_pastor", "鈴木一"), (4, "evangelist", "林 次郎")}


def test_dictionary_takes_the_longest_match(spark):
    entries = spark.createDataFrame([("東京", "Tokyo"), ("東京都", "Tokyo-to"), ("教会", "Church"), ("京", "x")], "source string, target string")
    rows = spark.createDataFrame([(1, "東京都光教会"), (2, None), (3, "")], "k int, t string")
    got = {r["key"]: (r["translated"], r["unmatched"]) for r in N.translate_by_dictionary(rows, entries, key="k", text="t").collect()}
    assert got == {1: ("Tokyo-to 光 Church", ["光"]), 2: (None, []), 3: ("", [])}


@pytest.mark.parametrize("latin,want", [("Sapporo", "삿포로"), ("Nagoya", "나고야"), ("Tokyo", "도쿄"), ("Kobe", "고베"), ("xyz", None), ("", None), ("Sendai", "센다이")])
def test_hangul(latin, want):
    assert N.romaji_to_hangul(latin) == want


def test_localised_fallbacks(spark):
    schema = "values array<struct<languageCode string, name string, source string, reviewStatus string, confidence double>>, en string, ja string"
    rows = spark.createDataFrame([([("ko", "가", "GENERATED", "NEEDS_REVIEW", 0.9), ("ko", "나", "MANUAL", "REVIEWED", 0.1)], "E", "J"), ([("ko", "x", "MANUAL", "REJECTED", 1.0)], " ", "J"), ([], None, None)], schema)
    assert [r["v"] for r in rows.select(N.localised(F.col("values"), "ko", F.col("en"), F.col("ja")).alias("v")).collect()] == ["나", "J", None]


def test_slugs_become_unique(spark):
    rows = spark.createDataFrame([("a", "hope", ["tokyo"]), ("b", "hope", ["tokyo", "osaka"]), ("c", "hope", []), ("d", "faith", ["x"])], "k string, s string, p array<string>")
    got = {r["key"]: r["slug"] for r in N.resolve_slug_collisions(rows, key="k", slug="s", prefixes="p").collect()}
    assert got == {"a": "tokyo-hope", "b": "osaka-hope", "c": "hope-c", "d": "faith"}


def test_addresses_are_decomposed(spark):
    areas = spark.createDataFrame([("52", "霧崎県", "PREFECTURE", "52"), ("520104", "高沢市", "MUNICIPALITY", "52")], "code string, name string, type string, prefectureCode string")
    rows = spark.createDataFrame([(1, "〒103-2094　霧崎県高沢市葵区幸町５－３４－７０ 光ビル"), (2, None), (3, "高沢市")], "k int, t string")
    got = {r["key"]: r for r in A.decompose(rows, key="k", text="t", areas=areas).collect()}
    r = got[1]
    assert (r["postal_code"], r["prefecture"], r["prefecture_code"], r["municipality"], r["municipality_code"], r["city_ward"], r["locality"], r["number"], r["building"]) == ("103-2094", "霧崎県", "52", "高沢市", "520104", "葵区", "幸町", "5-34-70", "光ビル")
    assert got[2]["municipality"] is None and got[3]["municipality"] == "高沢市"


def test_accounts_follow_the_cascade(spark):
    accounts = spark.createDataFrame([(1, "光の丘教会", "u1"), (2, "星の谷教会公式", "u2"), (3, "虹の川教会", "u3"), (4, "zzzz", "u4")], "account bigint, name string, url string")
    churches = spark.createDataFrame([(10, "光の丘教会"), (20, "星の谷教会"), (30, "虹の川教會"), (40, "月の海教会")], "church bigint, name string")
    links = spark.createDataFrame([(40, "u1")], "church bigint, url string")
    got = {(r["account"], r["church"], r["source"]) for r in social.link_accounts(accounts, churches, links).collect()}
    assert got == {(1, 40, "page link"), (2, 20, "name"), (3, 30, "score")}
    assert {(r["account"], r["kind"]) for r in social.merge_estimates(accounts, churches, least=0.7).collect()} == {(1, "exact"), (2, "estimated"), (3, "estimated")}


def test_accounts_meet_every_church_by_name(spark):
    """A short church name within a long account name, and a name carried by more churches than any shortlist."""
    accounts = spark.createDataFrame([(1, "鬱鱒髙﨑菊本郷北命の里教会", "u1"), (2, "愛の園教会", "u2"), (3, "の丘光", "u3")], "account bigint, name string, url string")
    crowd = [(100 + i, f"菊本郷北{chr(0x5000 + i)}の里教会") for i in range(90)] + [(300 + i, "愛の園教会") for i in range(90)]
    churches = spark.createDataFrame([*crowd, (900, "命の里"), (901, "光の丘")], "church bigint, name string")
    links = spark.createDataFrame([], "church bigint, url string")
    got = {(r["account"], r["church"], r["source"]) for r in social.link_accounts(accounts, churches, links).collect()}
    assert got == {(1, 900, "name"), *((2, 300 + i, "name") for i in range(90)), (3, 901, "score")}


@pytest.mark.parametrize("least", [0.25, 0.5, 0.74, 0.8, 1.0])
def test_name_joins_against_brute_force(spark, least):
    r = random.Random(5)
    words = lambda n: sorted({"".join(r.choice("あいうabc") for _ in range(r.choice([1, 2, 3, 3, 4, 5, 6, 8, 11, 15]))) for _ in range(n)})
    xs, ys = words(120), words(120)
    ys += [x[:i] + r.choice("あいうabc") + x[i + 1 :] for x in xs if len(x) > 3 for i in (r.randrange(len(x)),)]
    left, right = spark.createDataFrame([(x,) for x in xs], "x string"), spark.createDataFrame([(y,) for y in ys], "y string")
    every = left.distinct().crossJoin(right.distinct()).withColumn("s", similarity.fuzzy(F.col("x"), F.col("y")))
    want = {(q["x"], q["y"]) for q in every.where(F.col("s") >= least).collect()}
    assert {(q["x"], q["y"]) for q in resolve.similar_names(left, right, least).collect()} == want
    assert {tuple(q) for q in resolve.containing_names(left, right).collect()} == {(x, y) for x in xs for y in set(ys) if x in y or y in x}


def test_name_joins_move_few_bytes(spark):
    """The disk of account_links: what both joins write for shuffles stays below 25 times the names themselves."""
    r = random.Random(3)
    words = lambda n: sorted({"".join(chr(0x4E00 + r.randrange(400)) for _ in range(r.randrange(4, 10))) + r.choice(["教会", "キリスト教会", "伝道所"]) for _ in range(n)})
    xs, ys = words(3_000), words(1_500)
    left, right = spark.createDataFrame([(x,) for x in xs], "x string"), spark.createDataFrame([(y,) for y in ys], "y string")
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages() -> dict[int, int]:
        context.listenerBus().waitUntilEmpty(30_000)
        got = context.statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteBytes() for i in range(got.size())}

    last = max(stages(), default=-1)
    resolve.containing_names(left, right).count()
    resolve.similar_names(left, right, 0.8).count()
    assert 0 < sum(n for k, n in stages().items() if k > last) < 25 * sum(len(n.encode()) for n in xs + ys)


def test_identities_of_all_blocks(spark):
    """Rows without a postal code meet by name and by address; two known codes that differ rule a pair out."""
    at = "霧崎県高沢市幸町5-34-70"
    schema = "key bigint, name string, address string, postal string"
    left = [(1, "光の丘教会", "", None), (2, "星の谷教会", at, None), (3, "愛の園教会", at, "1000001"), (4, "虹の川教会", "", "1000002"), (5, "", "", None), (6, None, "", None)]
    right = [(10, "光の丘教会", at + "8", "1000009"), (20, "星の谷の教会", at, "1000003"), (30, "愛の園教会", at, "1000004"), (40, "虹の川教会", "", "1000002"), (50, "", "", None), (60, "xyz", at, None)]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {(r["a"], r["b"]): r["confidence"] for r in resolve.identities(a, b).collect()}
    pairs = resolve.blocked_pairs(a, b, key="key", blocks=lambda: resolve.name_blocks("name", "postal", "address"))
    assert set(got) == {(1, 10), (2, 20), (4, 40)} and set(got) <= {tuple(r) for r in pairs.collect()}
    assert got[1, 10] == got[4, 40] == 0.90 and got[2, 20] > 0.8


def test_reconciliation_keeps_human_labels(spark):
    churches = spark.createDataFrame([(1, "A", None), (2, "A", "A"), (3, "B", None), (4, None, None), (5, "X", None)], "church bigint, denomination string, human string")
    matches = spark.createDataFrame([(1, 11, "A", 0.9), (2, 11, "A", 0.95), (4, 12, "B", 0.8), (3, 12, "B", 0.7)], "church bigint, entry bigint, denomination string, score double")
    listed = spark.createDataFrame([("A",), ("B",)], "denomination string")
    got = {r["church"]: (r["after"], r["status"]) for r in official.reconcile(churches, matches, listed).collect()}
    assert got == {1: (None, "removed"), 2: ("A", "human kept"), 3: (None, "removed"), 4: ("B", "assigned"), 5: ("X", "unchanged")}


def test_precedence_of_labels(spark):
    churches = spark.createDataFrame([(1, "A", None), (2, "A", "x"), (3, "A", None), (4, "NOT_DETERMINED", None), (5, None, None)], "church bigint, denomination string, human string")
    over = spark.createDataFrame([(1, "P", 1), (1, "Q", 2)], "church bigint, value string, position int")
    named = spark.createDataFrame([(2, "B"), (3, "B"), (4, "C")], "church bigint, value string")
    paged = spark.createDataFrame([(4, "D"), (5, "D")], "church bigint, value string")
    none = spark.createDataFrame([], "church bigint, value string")
    got = {r["church"]: (r["after"], r["source"]) for r in official.determine(churches, over, named, paged, none).collect()}
    assert got == {1: ("Q", "override"), 2: ("A", "human"), 3: ("B", "name corrects"), 4: ("C", "name"), 5: ("D", "page")}


def test_best_of_chunks(spark):
    g = spark.createDataFrame([(1, "a", 0.9), (1, "a", 0.5), (1, "b", 0.88), (2, "c", 0.7)], "k int, value string, score double")
    assert {tuple(r) for r in official.best_of_chunks(g, key="k").collect()} == {(1, "a", 0.9, True), (2, "c", 0.7, False)}


@pytest.mark.parametrize("text,want", [("三重県四日市市諏訪町1-5", "四日市市"), ("東京都東村山市本町1-2-3", "東村山市"), ("新潟県十日町市千歳町3", "十日町市"), ("東京都羽村市緑ヶ丘5", "羽村市"), ("広島県廿日市市下平良1", "廿日市市"), ("長野県大町市大町3887", "大町市"), ("東京都町田市森野2", "町田市"), ("千葉県市川市八幡1", "市川市"), ("北海道余市郡余市町朝日町26", "余市町"), ("奈良県吉野郡東吉野村小川99", "東吉野村"), ("東京都新宿区西新宿2", "新宿区")])
def test_municipalities_are_whole(spark, text, want):
    """By pattern where the gazetteer is empty, and by the gazetteer's longest name otherwise."""
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "k bigint, t string")
    areas = spark.createDataFrame([("13", "東京都", "PREFECTURE", "13"), ("15", "新潟県", "PREFECTURE", "15"), ("1", "東村", "MUNICIPALITY", "13"), ("2", "東村山市", "MUNICIPALITY", "13"), ("3", "十日町市", "MUNICIPALITY", "15")], "code string, name string, type string, prefectureCode string")
    for known in (areas, areas.where("false")):
        got = {r["key"]: r["municipality"] for r in A.decompose(rows, key="k", text="t", areas=known).collect()}
        assert got == {1: want, 2: None, 3: None}


def test_slugs_are_unique_across_groups(spark):
    rows = [(1, "grace", ["tokyo", "ueno"]), (2, "grace", ["tokyo", "ueno"]), (3, "grace", ["tokyo", "ueno"]), (4, "tokyo-grace", None), (5, "grace-3", []), (6, "grace-3", None), (7, "alone", ["x"])] + [(100 + i, "hot", ["a", f"p{i % 7}"]) for i in range(200)]
    got = N.resolve_slug_collisions(spark.createDataFrame(rows, "k bigint, s string, p array<string>"), key="k", slug="s", prefixes="p").collect()
    slugs = {r["key"]: r["slug"] for r in got}
    assert len(got) == len(rows) == len(set(slugs.values()))
    assert slugs[4] == "tokyo-grace" and slugs[7] == "alone" and slugs[1] == "ueno-grace" and slugs[100] == "a-hot"
