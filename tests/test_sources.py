import json

import pytest
from pyspark.sql import functions as F

from parvis.sources import html, readers, snapshots
from parvis.streaming import events


def test_church_catalog_splits_rejected(spark, tmp_path):
    good = {"id": "a", "name": "A", "location": {"latitude": 35, "longitude": 135}}
    rows = [good, {**good, "name": "B"}, {"id": "", "name": "x"}, {"id": "c", "name": "C", "location": {"latitude": 95, "longitude": 1}}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    ok, bad = readers.church_catalog(spark, str(tmp_path / "c.json"))
    assert [(r["id"], r["name"]) for r in ok.collect()] == [("a", "A")]
    assert bad.count() == 2


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\r\n1,"a ""b""\nc"\r\n')
    assert [tuple(r) for r in readers.strict_csv(spark, str(tmp_path / "a.csv"), "k string, v string").collect()] == [("1", 'a "b"\nc')]


def test_saved_places_headers(spark, tmp_path):
    (tmp_path / "一覧.csv").write_text("﻿タイトル,メモ,URL,コメント\n光教会,メモ1,https://a.example/,\n", encoding="utf-8")
    (tmp_path / "other.csv").write_text("Title,Note,URL,Comment\nHope,n,https://b.example/,c\n")
    got = {(r["list"], r["title"], r["note"], r["url"]) for r in readers.saved_places(spark, str(tmp_path)).collect()}
    assert got == {("一覧", "光教会", "メモ1", "https://a.example/"), ("other", "Hope", "n", "https://b.example/")}


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿# note\n教会,church\n光, light\n", encoding="utf-8")
    assert {tuple(r) for r in readers.dictionary(spark, str(tmp_path / "d.csv")).collect()} == {("教会", "church"), ("光", "light")}
    (tmp_path / "e.csv").write_text("a,b\na,c\n")
    with pytest.raises(ValueError):
        readers.dictionary(spark, str(tmp_path / "e.csv"))


def test_geonames_and_alternates(spark, tmp_path):
    cells = lambda i, name, cls, code, pop, cc="JP": "\t".join([i, name, name, "", "35", "139", cls, code, cc, "", "", "", "", "", pop, "", "", "", ""])
    (tmp_path / "g.txt").write_text("\n".join([cells("1", "Naka", "P", "PPL", "10"), cells("2", "Hill", "T", "HLL", "0"), cells("3", "Far", "P", "PPL", "1", "KR"), cells("4", "Chapel", "S", "CH", "0")]))
    places = readers.geonames_dump(spark, str(tmp_path / "g.txt"))
    assert {r["geonameid"] for r in places.collect()} == {"1", "4"}
    alt = spark.createDataFrame([("1", "1", "en", "Old", None, None, None, "1"), ("2", "1", "en", "Naka City", "1", None, None, None), ("3", "1", "en", "Nakatown", None, None, None, None)], readers.ALTERNATE_NAMES)
    assert [tuple(r) for r in readers.best_alternate_names(places, alt, ["en"]).collect()] == [("1", "en", "Naka City")]


def test_social_exports(spark, tmp_path):
    (tmp_path / "y.csv").write_text("id,url,title\nU1,https://youtube.com/a,A\nU1,https://youtube.com/a,A\n")
    (tmp_path / "f.json").write_text(json.dumps({"pages_followed_v2": [{"title": "t", "data": [{"name": "教会".encode().decode("latin-1")}]}]}))
    got = {(r["platform"], r["accountName"]) for r in readers.social_exports(spark, youtube=str(tmp_path / "y.csv"), facebook=str(tmp_path / "f.json")).collect()}
    assert got == {("YOUTUBE", "A"), ("FACEBOOK", "教会")}


def test_html(spark):
    page = "<html><head><title> A  b </title><style>x{}</style></head><body><h1>x</h1><main><h1>光の丘教会</h1>Hi <script>no()</script>there <a href='/about#t'>a</a><a href='img.png'>i</a><a href='https://o.example/'>o</a></main></body></html>"
    title, text, head, links = html.read(page)
    assert (title, head) == ("A b", "光の丘教会") and "no()" not in text and "Hi there" in text
    row = spark.createDataFrame([("https://h.example/p", page), ("https://h.example/q", None)], "url string, html string").withColumn("h", html.parse("html"))
    got = row.select(html.same_host_links(F.col("url"), F.col("h.links")).alias("l")).collect()
    assert [r["l"] for r in got] == [["https://h.example/about"], []]


def test_snapshot_commits_and_conflicts(spark, tmp_path):
    c = snapshots.Catalog(spark, f"file://{tmp_path}/cat")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    first = c.commit({"t": (rows, "id")})
    assert (first.sequence, first.changed, c.current()) == (1, True, 1)
    again = c.commit({"t": (rows.orderBy(F.desc("id")), "id")}, expected=1)
    assert (again.sequence, again.changed) == (2, False) and c.verify(2)
    with pytest.raises(snapshots.Conflict):
        c.commit({"t": (rows, "id")}, expected=1)
    assert c.load("t").count() == 2 and c.current() == 2


def test_streams_agree_with_batch(spark, tmp_path):
    src = spark.createDataFrame([(i, f"2026-01-01 0{i % 3}:10:00", i % 2, "view", float(i)) for i in range(12)], "event_id bigint, t string, user_id bigint, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = events.start(stream, events.latest_by_key(f"file://{tmp_path}/out", ["user_id"], "ts"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r["user_id"], str(r["ts"])) for r in spark.read.parquet(str(tmp_path / "out/0")).collect()}
    assert got == {(0, "2026-01-01 02:10:00"), (1, "2026-01-01 02:10:00")}
    assert sum(r["events"] for r in events.windowed(src).collect()) == 12
    assert sum(r["events"] for r in events.sessions(src).collect()) == 12
