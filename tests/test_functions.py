from pyspark.sql import functions as F

from parvis.functions import language, similarity, text as X, url as U


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()["v"]


def test_exact_key_drops_blanks_only_beside_kana_or_han(spark):
    assert one(spark, X.exact_key(F.col("a")), a="　東京 教会 ") == "東京教会"
    assert one(spark, X.exact_key(F.col("a")), a=" Grace   Church ") == "grace church"
    assert one(spark, X.exact_key(F.col("a")), a=None) is None


def test_query_fold(spark):
    assert one(spark, X.query_fold(F.col("a")), a="ＡＢＣ　１") == "abc 1"


def test_entity_forms(spark):
    assert one(spark, X.entity_name(F.col("a")), a="東京（中央）キリスト教会") == "東京中央教会"
    assert one(spark, X.entity_address(F.col("a")), a="〒100-0001 東京1丁目2番地3号") == "東京1-2-3"


def test_scripts(spark):
    assert one(spark, X.to_hiragana(F.col("a")), a="カトリック教会") == "かとりっく教会"
    assert one(spark, X.to_simplified(F.col("a")), a="聖靈會") == "圣灵会"


def test_snippet_is_clamped_and_marked(spark):
    text = "あ" * 200 + "祈り" + "い" * 200
    got = one(spark, X.snippet(F.col("a"), F.lit("祈り")), a=text)
    assert got.startswith("…") and got.endswith("…") and len(got) == 182 and "祈り" in got
    assert one(spark, X.snippet(F.col("a"), F.lit("x")), a="short  text") == "short text"


def test_chunks(spark):
    assert one(spark, F.size(X.chunks(F.col("a"))), a="x" * 6000) == 1
    assert one(spark, F.size(X.chunks(F.col("a"))), a="x" * 6001) == 2
    assert one(spark, X.chunks(F.col("a")), a="  ") == [""]


def test_slug_and_check_digit(spark):
    assert one(spark, X.slug(F.col("a")), a="Église Saint's & Co.") == "eglise-saints-and-co"
    assert one(spark, X.check_digit(F.col("a")), a="13101") == 6


def test_utf8_read_as_latin1(spark):
    assert one(spark, X.read_as_utf8(F.col("a")), a="教会".encode().decode("latin-1")) == "教会"
    assert one(spark, X.read_as_utf8(F.col("a")), a="Café") == "Café"


def test_similarity_identities(spark):
    f = similarity.fuzzy(F.col("a"), F.col("b"))
    assert one(spark, f, a="教会", b="教会") == 1.0
    assert one(spark, f, a="", b="教会") == 0.0
    assert one(spark, f, a="教会", b="教") == 2 / 3
    assert one(spark, similarity.address_score(F.col("a"), F.col("b")), a="東京都1-2", b="1-2") == 0.92
    assert abs(spark.range(1).select(similarity.entity_score(F.lit(0.8), F.lit(0.6)).alias("v")).first()["v"] - 0.71) < 1e-9
    assert spark.range(1).select(similarity.entity_score(F.lit(0.2), F.lit(0.9)).alias("v")).first()["v"] == 0.2


def test_romanised_addresses(spark):
    s = similarity.romanised_address_score(F.col("a"), F.col("b"), {"霧崎県": "Kirisaki"})
    assert abs(one(spark, s, a="〒103-3551 霧崎県高沢市1-2", b="1-2 Naka, Takasawa, Kirisaki, 103-3551") - 1.0) < 1e-9
    assert one(spark, s, a="〒103-3551 霧崎県1-2", b="1-2 Naka, Kirisaki, 103-3552") == 0.0


def test_urls(spark):
    assert one(spark, U.canonical(F.col("a")), a="HTTPS://Www.A.Example/B/?q=1#x") == "https://www.a.example/B?q=1"
    assert one(spark, U.link_fold(F.col("a")), a="http://A.example/b/?q#f") == "https://a.example/b"
    assert one(spark, U.comparable_site(F.col("a")), a="https://www.a.example/index.html") == "a.example"
    assert one(spark, U.host_suffixes(F.col("a")), a="https://m.a.example/x") == ["m.a.example", "a.example", "example"]
    assert one(spark, U.platform(F.col("a")), a="https://www.facebook.example/p1") == "FACEBOOK"


def test_languages(spark):
    d = lambda s: one(spark, language.detect_query(F.col("a")), a=s)
    assert [d("교회"), d("きょうかい"), d("教会"), d("hội thánh"), d("igreja"), d("gereja"), d("church"), d("xyz")] == ["ko", "ja", "ja", "vi", "pt", "id", "en", "en"]
    c = lambda s: one(spark, language.canonical_code(F.col("a")), a=s)
    assert [c("zh_TW"), c("zh"), c("EN"), c("pt-BR"), c(" ")] == ["zh-Hant", "zh-Hans", "en", "pt", None]


def test_ngram_classifier(spark):
    train = spark.createDataFrame([("en", "the church and the choir"), ("pt", "a igreja e o coral da cidade")] * 3, "lang string, text string")
    profile = language.profiles(train, language="lang", text="text", least=1)
    got = language.classify(spark.createDataFrame([(1, "the choir"), (2, "coral da igreja")], "id int, text string"), profile, key="id", text="text")
    assert {r["id"]: r["language"] for r in got.collect()} == {1: "en", 2: "pt"}
