import pytest
from pyspark.sql import functions as F

from parvis.functions import localise as L
from parvis.operators.stages import Stages
from parvis.sources import directories as D, exports


def test_titles_are_decomposed(spark):
    rows = spark.createDataFrame([("光の丘教会 Hikari Church (한인교회)",), ("Grace Church",), (None,), ("123",)], "t string")
    got = [tuple(r["p"]) for r in rows.select(L.decompose_title("t").alias("p")).collect()]
    assert got == [("光の丘教会", "Hikari Church", "한인교회", "JAPANESE_AND_LATIN_AND_KOREAN_NAMES"), (None, "Grace Church", None, "LATIN_NAME"), (None, None, None, None), (None, None, None, "OTHER")]


def test_names_are_localised_with_word_order(spark):
    entries = spark.createDataFrame([("東京", "Tokyo", "place"), ("希望", "Hope", "word"), ("教会", "Church", "congregation")], "source string, target string, kind string")
    rows = spark.createDataFrame([(1, "東京希望教会"), (2, "東京謎教会"), (3, None)], "k int, t string")
    ask = lambda lang: {r["key"]: (r["name"], r["complete"]) for r in L.localise(rows, entries, key="k", text="t", language=lang).collect()}
    assert ask("en") == {1: ("Tokyo Hope Church", True), 2: ("東京謎教会", False), 3: (None, False)}
    assert ask("pt")[1] == ("Igreja Tokyo Hope", True)


def test_migration_is_idempotent(spark):
    rows = spark.createDataFrame([("a", True, "x"), ("a", False, "x"), (None, False, "x"), ("x", None, "x"), ("a", False, None)], "c string, p boolean, f string")
    v, o = L.migrate(F.col("c"), F.col("p"), F.col("f"))
    once = rows.select(v.alias("c"), "p", "f", o.alias("o"))
    assert [(r["c"], r["o"]) for r in once.collect()] == [("a", "protected"), ("x", "replaced"), ("x", "added"), ("x", "unchanged"), ("a", "no translation")]
    assert {r["o"] for r in once.select(o.alias("o")).collect()} == {"protected", "unchanged", "no translation"}


@pytest.mark.parametrize("language,name,want", [("en", "Kanda Catholic Church in Japan Church", "Kanda Catholic Church"), ("pt", "Igreja Católica no Japão Kanda", "Igreja Católica Kanda"), ("en", "Grace Church", "Grace Church")])
def test_country_is_taken_out(spark, language, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(L.without_country(F.col("n"), language).alias("v")).first()["v"] == want


def test_matches_have_offsets(spark):
    run = L.matches({"東京": "Tokyo", "東京都": "Tokyo-to"})
    assert [tuple(x) for x in spark.createDataFrame([("在東京都内",)], "t string").select(run("t").alias("m")).first()["m"]] == [(1, 4, "Tokyo-to")]


def test_directory_pages(spark):
    parser = D.table_parser({"name": ("教会名",), "address": ("住所",)})
    page = "<table><tr><th>教会名</th><th>住所</th></tr><tr><td><a href='https://a.example/'>光教会</a></td><td>高沢市 1-2</td></tr></table>"

    def broken(url, html):
        raise ValueError("no table")

    pages = spark.createDataFrame([("u", page), ("v", None)], "url string, html string")
    assert [(r["name"], r["address"], r["website"], r["error"]) for r in D.parse_pages(pages, parser).collect()] == [("光教会", "高沢市 1-2", "https://a.example/", None)]
    assert [r["error"] for r in D.parse_pages(pages, broken).collect()] == ["ValueError: no table"]


def test_saved_place_links(spark):
    rows = spark.createDataFrame([("https://m.example/?cid=12",), ("https://m.example/x!1s0x1:0xff@35.5,139.25,17z",), ("https://m.example/",)], "u string")
    got = [(r["i"], r["p"] and tuple(r["p"])) for r in rows.select(D.place_id(F.col("u")).alias("i"), D.place_point(F.col("u")).alias("p")).collect()]
    assert got == [("12", None), ("255", (35.5, 139.25)), (None, None)]


def test_page_charsets(spark):
    rows = spark.createDataFrame([(bytearray("教会".encode("cp932")),), (bytearray("教会".encode()),), (bytearray(b"<meta charset=euc-jp>" + "教会".encode("euc-jp")),), (None,)], "b binary")
    assert [r["t"] for r in rows.select(D.decode_page("b").alias("t")).collect()] == ["教会", "教会", "<meta charset=euc-jp>教会", None]


def test_stages_resume(spark, tmp_path):
    calls = []

    def work(n):
        calls.append(n)
        return spark.range(n)

    s = Stages(spark, f"file://{tmp_path}/s", "v1")
    assert s.run("a", lambda: work(3)).count() == 3 and s.run("a", lambda: work(4)).count() == 3
    assert Stages(spark, f"file://{tmp_path}/s", "v1").run("a", lambda: work(5)).count() == 3
    assert Stages(spark, f"file://{tmp_path}/s", "v2").run("a", lambda: work(6)).count() == 6 and calls == [3, 6]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("b", "星教会", "ja"), ("a", "Hope Church", "en")], "id string, name string, lang string")
    m = exports.logical_export(rows, str(tmp_path / "x"), key="id")
    assert m["rows"] == 2 and exports.servable(m, m) == [] and len(exports.servable(m, {**m, "rows": 3})) == 1
    exports.write_index(rows, str(tmp_path / "i"), key="id", fields=["name"], language="lang")
    assert {r["term"] for r in spark.read.parquet(str(tmp_path / "i/postings")).where("lang = 'en'").collect()} == {"hope", "church"}
    pages = exports.page_models(rows, ["ja", "en"], key="id", name=F.col("name"), localised={})
    assert pages.count() == 4 and exports.stale_paths(pages, pages.where("language = 'ja'")).count() == 2
