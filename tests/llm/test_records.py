import pytest
from pyspark.sql import functions as F

from parvis.llm import address as A, congregations, linkage, mojibake, names as N, plots, survivors
from parvis.session import cut

AREAS = (
    ("52", "霧崎県", ("霧崎",), "PREFECTURE", "52", "Kirisaki"), ("57", "燈洲都", ("燈洲",), "PREFECTURE", "57", "Hishu"), ("520104", "高沢市", ("高沢",), "MUNICIPALITY", "52", "Takasawa"), ("570101", "南橋市", ("南橋", "Minamihashi-shi"), "MUNICIPALITY", "57", "Minamihashi"),
    ("5701012", "青区", (), "WARD", "57", "Ward B"), ("5701014", "桜区", (), "WARD", "57", "Ward D"),
)


@pytest.mark.parametrize("text,postcode,want", [
    ("〒103-2094 霧崎県高沢市幸町 五丁目３４‐７０", None, ("1032094", "52", "520104", None, "幸町", "5-34-70")),
    ("霧崎県 高沢市 幸町五丁目三十四番七十号 メゾンビル3階", "１０３２０９４", ("1032094", "52", "520104", None, "幸町", "5-34-70")),
    ("日本、〒１００－００２２ 燈洲都南橋市青区大字つつじガ谷1454番地の49", None, ("1000022", "57", "570101", "5701012", "つつじヶ谷", "1454-49")),
    ("2-chome 3-77 Chidori-dori, Minamihashi-shi, Hishu, 100-0079, Japan", None, ("1000079", "57", "570101", None, "chidori-dori", "2-3-77")),
    ("〒103-2094 幸町5の34の70, 高沢市, 霧崎県 会館", None, ("1032094", "52", "520104", None, "幸町", "5-34-70")),
    ("高沢市", None, (None, "52", "520104", None, None, None)), (None, "103-2094", ("1032094", None, None, None, None, None)), ("", None, (None,) * 6),
])
def test_addresses_are_read(text, postcode, want):
    assert A.parse(text, postcode, A.Gazetteer(list(AREAS)))[:6] == want


def test_numerals():
    assert [A.numeral(x) for x in ("五", "十", "二十三", "百二", "九〇")] == [5, 10, 23, 102, 90]


def test_within_one():
    assert all(A.within_one(a, b) for a, b in (("ab", "ab"), ("ab", "abc"), ("abc", "acb"), ("abc", "axc"), ("", "a")))
    assert not any(A.within_one(a, b) for a, b in (("ab", "cd"), ("a", "abc"), ("abcd", "badc")))


def test_same_plots(spark):
    left = [(1, "〒103-2094 霧崎県高沢市幸町5-34-70"), (2, "霧崎県高沢市幸町5-34-71"), (3, "高沢市"), (4, None), (5, "〒103-2094 幸町五丁目34番70号"), (6, "霧崎県高沢市幸幸町5-34-70"), (1, "〒103-2094 霧崎県高沢市幸町5-34-70")]
    right = [(11, "霧崎県高沢市幸町五丁目34-70 3F", "103-2094"), (12, "霧崎県高沢市港町5-34-70", None), (13, None, "103-2094"), (14, "燈洲都南橋市幸町5-34-70", None)]
    a = plots.read_addresses(spark.createDataFrame([(k, t, "x") for k, t in left], "k bigint, a string, town string"), AREAS, key="k", text="a")
    b = plots.read_addresses(spark.createDataFrame(right, "k bigint, a string, z string"), AREAS, key="k", text="a", postcode="z")
    assert sorted(tuple(r) for r in plots.same_plots(a, b).collect()) == [(1, 11), (1, 11), (5, 11), (6, 11)]
    floor = plots.read_addresses(spark.createDataFrame([(8, "霧崎県高沢市幸町5-34-70 2F"), (9, "霧崎県高沢市幸町5-34-70 3階")], "k bigint, a string"), AREAS, key="k", text="a")
    assert {r["left_key"] for r in plots.same_plots(floor, b).collect()} == {8, 9}
    assert {r["left_key"] for r in plots.same_plots(floor, b, unit_veto=True).collect()} == {9}
    assert plots.same_plots(a.where("false"), b).count() == 0 and plots.same_plots(a, b.where("false")).count() == 0


def test_judging_by_columns_is_the_same(spark):
    """The Column expression against the plain function with all assignments tried, over random components."""
    r = __import__("random").Random(8)
    towns, codes = ["幸町", "幸幸町", "幸", "町幸", "台町北", "台北町", "港", "幸町北", None], ["1", "2", None]
    one = lambda: {"prefecture": r.choice(codes), "municipality2": r.choice(codes), "ward2": r.choice(codes), "town2": r.choice(towns), "numbers": r.choice(["1-2", "1-2", "3", None]), "postcode": r.choice(["1234567", "1234567", "1234568", "1234578", None]), "known": r.choice([True, None])}
    pairs = [(one(), one()) for _ in range(3000)]
    names = list(pairs[0][0])
    rows = [(k, *(a[n] for n in names), *(b[n] for n in names)) for k, (a, b) in enumerate(pairs)]
    schema = "k int, " + ", ".join(f"{s}_{n} {'boolean' if n == 'known' else 'string'}" for s in "ab" for n in names)
    got = {x["k"] for x in spark.createDataFrame(rows, schema).where(plots._verdict()).collect()}
    assert got == {k for k, (a, b) in enumerate(pairs) if plots.verdict(a, b)} and len(got) > 50


D = ("灯火ルーテル教会", "灯ルーテル", "単立")

# Names of real congregations; each must yield forms though no word list knows them.
REAL = """東京バプテスト教会|日本基督教団 銀座教会|横浜グレースチャペル|本郷台キリスト教会|Tokyo Union Church|St. Alban's Anglican Church|Yodobashi Church|ウェスレアン・ホーリネス淀橋教会|カトリック麹町聖イグナチオ教会|日本基督教団富士見町教会|霊南坂教会|番町教会|信濃町教会
高円寺教会|Shinjuku Shalom Church|新宿シャローム教会|東京カベナント教会|恵泉キリスト教会|久遠キリスト教会|大和カルバリーチャペル|Yamato Calvary Chapel|浅草教会|神田キリスト教会|聖アンデレ教会|聖オルバン教会|聖マーガレット教会|横浜海岸教会|Yokohama Union Church|神戸栄光教会
大阪女学院教会|平安教会|京都ノートルダム教会|洛陽教会|札幌北光教会|札幌独立キリスト教会|仙台青葉荘教会|名古屋中央教会|広島流川教会|長崎銀屋町教会|沖縄バプテスト教会|那覇中央教会|函館ハリストス正教会|ニコライ堂|山手カトリック教会|Sacred Heart Cathedral|浦上教会|大浦天主堂
鹿児島加治屋町教会|高知教会|松山城東教会|金沢元町教会|新潟教会|静岡草深教会|甲府教会|Franciscan Chapel Center""".replace("\n", "|").split("|")


def test_every_real_name_has_forms():
    assert len(REAL) >= 50
    for name in REAL:
        native, latin, spots, _ = N.parts(name, D)
        forms = N.rewritings(native, latin, spots, {})
        assert forms and all(len(f[1]) > 1 for f in forms), name
    keys = {x: N.rewritings(*N.parts(x, D)[:3], {})[0][1] for x in REAL}
    assert len(set(keys.values())) >= len(REAL) - 3  # 神戸栄光 and the like stay apart


@pytest.mark.parametrize("a,b", [
    ("新宿シャローム教会", "新宿しゃろーむ　キリスト教會"), ("Tokyo Union Church", "TOKYO-UNION CH."), ("St. Alban's Church", "Saint Albans Church"), ("日本基督教団 銀座教会", "宗教法人 銀座キリスト教会★"), ("ぶどうのき教会", "Budou-no-Ki Church"), ("しょうなんみなと教会", "Shonan Minato Church"),
    ("横浜グレースチャペル", "横浜グレース千ャペル"), ("第1のぞみ教会", "第一ノゾミ教会 礼拝堂"), ("灯火ルーテル教会 北原教会", "灯火ルーテル会 北原教会"), ("Hosino To Church", "ほしのとう教会"), ("グレ一スチャペル", "グレースチャペル"),
])
def test_spellings_share_a_form(a, b):
    one, other = ({f[1] for f in N.rewritings(*N.parts(x, D)[:3], {})} for x in (a, b))
    assert one & other


def test_rewriting_rules():
    known = {"p": {"高沢": "高沢"}, "q": {"takasawa": "高沢"}, "r": {"栄光": "eiko", "第一": "daiiti", "山": "yama"}, "w": {"eiko": "", "yama": "", "daiiti": ""}}
    native = N.rewritings(*N.parts("高沢第一栄光の山ｷﾘｽﾄ教会", D)[:3], known)
    assert native[0][:2] == ("高沢", "daiitieikonoyama") and any(f[0] is None for f in native)
    for text in ("Takasawa Daiichi Eiko-no-Yama Church", "Daiichi Eikono Yama Takasawa Ch.", "Daiiti Eiko no Yama Church, Takasawa"):
        assert ("高沢", "daiitieikonoyama") in {f[:2] for f in N.rewritings(*N.parts(text, D)[:3], known)}, text
    assert ("daiitieikonoyama") in {f[1] for f in N.rewritings(*N.parts("Somewhere Daiichi Eiko no Yama Church", D)[:3], known)}
    initials = {f[1] for f in N.rewritings(*N.parts("John Henry Newman Chapel", D)[:3], {}) if f[3] == "initial"}
    assert initials & {f[1] for f in N.rewritings(*N.parts("J. H. Newman Chapel", D)[:3], {}) if f[3] == "initial" and f[2] == "i"}
    assert {f[1] for f in N.rewritings(*N.parts("Bob Miller Mission", D)[:3], {})} & {f[1] for f in N.rewritings(*N.parts("Robert Miller Mission", D)[:3], {})}
    assert {f[1] for f in N.rewritings(*N.parts("Union Grace Tokyo", D)[:3], {}) if f[3] == "sorted"} & {f[1] for f in N.rewritings(*N.parts("Tokyo Union Grace", D)[:3], {}) if f[3] == "sorted"}


def test_unreadable_names():
    for x in (None, "  ", "", "★★", "12345"):
        assert N.rewritings(*N.parts(x, D)[:3], {}) == []
    long = "教会" * 100_000
    assert len(N.rewritings(*N.parts(long, D)[:3], {})) == 1


def test_readings_are_learned_from_rows(spark):
    rows = [(i, f"{p}{w}の{v}教会", f"{a.title()} no {b.title()} Church") for i, (p, w, v, a, b) in enumerate([("", "緑陰", "灯台", "ryokuin", "todai"), ("北", "緑陰", "門", "kita ryokuin", "mon"), ("", "緑陰", "灯台", "ryokuin", "todai"), ("北", "慈愛", "灯台", "kita jiai", "todai"), ("", "慈愛", "門", "jiai", "mon"), ("", "慈愛", "灯台", "jiai", "todai"), ("北", "緑陰", "灯台", "kita ryokuin", "todai"), ("", "慈愛", "門柱", "jiai", "monchu"), ("北", "慈愛", "門", "kita jiai", "mon"), ("東", "慈愛", "門", "higashi jiai", "mon")])]
    parsed = N.parse_names(spark.createDataFrame(rows, "nid bigint, name string, second string"), D)
    got = dict(map(tuple, N.learn_readings(parsed).collect()))
    assert got["緑陰"] == "ryokuin" and got["慈愛"] == "ziai" and got["灯台"] == "todai" and got["北"] == "kita"


def _meet(spark, left, right):
    def rows(data):
        d = spark.createDataFrame([(k, e, n, a, {"latitude": la, "longitude": lo}, w, "clash") for k, e, n, a, la, lo, w in data], "k bigint, e string, n string, a string, l struct<latitude:double,longitude:double>, w string, area string")
        return cut(congregations.sightings(d, AREAS, key="k", name="n", address="a", entity="e", location="l", website="w"))

    left, right = rows(left), rows(right)
    return left, right, *congregations.meet(left, right, AREAS, D)


LEFT = [
    (1, "c1", "高沢第一栄光の山教会", "霧崎県高沢市幸町5-34-70", 32.7387, 131.3618, "https://eiko.example/"), (2, "c1", "Daiichi Eiko no Yama Church", None, None, None, None), (3, "c2", "南橋星の塔教会", "燈洲都南橋市青区本町1-2-3", 35.0, 135.0, None),
    (4, None, "第一栄光の山教会", "燈洲都南橋市桜区台町9-9-9", 35.1, 135.1, None), (5, None, None, None, None, None, None), (6, "c3", "幸町光の丘教会", "霧崎県高沢市幸町5-34-70", 32.7387, 131.3618, None),
]
RIGHT = [(21, "d1", "第一栄光の山キリスト教会（高沢）", "高沢市幸町五丁目34-70", 32.739, 131.362, None), (22, "d2", "星の塔教会", "南橋市青区本町1丁目2番3号", None, None, None), (23, "d1", "第一えいこうの山教会", "霧崎県高沢市幸町5-34-70", None, None, None), (24, None, "", "", None, None, None)]


def test_congregations_are_linked_by_name(spark):
    left, right, a, b, met = _meet(spark, LEFT, RIGHT)
    pairs = congregations.same_names(met, a, b).where("score >= 0.5")
    got = sorted((r["left_key"], r["right_key"]) for r in congregations.to_rows(pairs, left, right).collect())
    assert got == [(1, 21), (1, 23), (2, 21), (2, 23), (3, 22)]


def test_a_form_of_many_places_needs_the_place(spark):
    towns = ["幸町", "港町", "本町", "泉町", "城町", "台町", "塩町", "鶴町"]
    left = [(i, f"c{i}", f"{t}希望教会", f"霧崎県高沢市{t}1-2-{i + 1}", None, None, None) for i, t in enumerate(towns)]
    right = [(100 + i, None, "希望教会", f"高沢市{t}1丁目2-{i + 1}", None, None, None) for i, t in enumerate(towns)] + [(200, None, "希望教会", "高沢市", None, None, None), (201, None, "希望教会", None, None, None, None)]
    lr, rr, a, b, met = _meet(spark, left, right)
    pairs = congregations.same_names(met, a, b).where("score >= 0.5")
    assert sorted((r["left_key"], r["right_key"]) for r in congregations.to_rows(pairs, lr, rr).collect()) == [(i, 100 + i) for i in range(len(towns))]
    assert met.where("how >= 2").count() <= 2 * len(towns)  # a hot form isn't expanded to all pairs


def test_linkage_by_votes(spark):
    more_left, more_right = [], []
    for i, (w, t) in enumerate([("光", "幸町"), ("星", "港町"), ("愛", "本町"), ("虹", "泉町"), ("道", "城町"), ("羊", "台町"), ("麦", "塩町"), ("暁", "鶴町")]):
        at = (32.70 + i / 100, 131.30 + i / 100)
        more_left.append((100 + i, f"l{i}", f"{t}{w}の谷教会", f"霧崎県高沢市{t}1-2-{i + 1}", *at, None))
        more_right.append((200 + i, f"r{i}", f"{w}の谷教会" if i % 2 else f"{t}{w}の谷キリスト教会", f"高沢市{t}1丁目2-{i + 1}", *(at if i % 3 else (None, None)), None))
        more_right.append((300 + i, f"n{i}", f"別所{w}の谷伝道所", f"霧崎県高沢市別所{i + 3}-8-{i + 11}", at[0] + 0.2, at[1] + 0.2, None))
    left, right, a, b, met = _meet(spark, LEFT + more_left, RIGHT + more_right)
    linked = linkage.link(met, a, b).where("confidence >= 0.5").withColumn("score", F.col("confidence"))
    got = {(r["left_key"], r["right_key"]) for r in congregations.to_rows(linked, left, right).collect()}
    assert got == {(1, 21), (1, 23), (2, 21), (2, 23), (3, 22), *((100 + i, 200 + i) for i in range(8))}
    assert linkage.link(met.where("false"), a.where("false"), b).count() == 0


def test_label_model_learns_from_agreement():
    def number(*o):
        n = 0
        for (_, m, _), x in zip(linkage.FUNCTIONS, o):
            n = n * len(m) + x
        return n

    good, bad, mixed = number(0, 0, 0, 0, 0, 2, 0), number(2, 2, 2, 4, 3, 1, 1), number(0, 1, 1, 3, 4, 2, 0)
    post = linkage.fit({good: 500, bad: 900, mixed: 20})
    assert post[good] > 0.99 and post[bad] < 0.01 and 0.3 < post[mixed] <= 1
    assert linkage.fit({}) == {}


PLACES = [
    (1, "c", "http://old.example/", " DN-a ", ["x ", ""], "2025-01-01T00:00:00Z", "2025-01-02"), (2, "c", "https://maps.google.example/?cid=1", "unknown", ["y"], "2026-01-01T00:00:00+09:00", "2026-01-02"), (3, "c", "https://new.example/", None, None, "2025-06-01 00:00:00+00:00", "2025-06-02"),
    (4, "c", "https://late.example/", "B name", ["x"], "unknown", "2026-06-02"), (5, "s", "https://one.example/", "dn-a", ["q"], "2025-01-01T00:00:00Z", "2025-01-02"), (6, None, "https://n.example/", "dn-a", ["q"], None, "2025-01-02"), (7, "e", None, None, None, None, "2025-01-01"), (8, "e", "", " ", [" "], "", None),
]


def test_survivors(spark):
    rows = spark.createDataFrame([(*r[:5], r[5], r[6], "m", "h") for r in PLACES], "place_row_id bigint, googleCid string, websiteUrl string, denominationHint string, sourceLists array<string>, resolvedAt string, t string, meant string, hint string").withColumn("ingested_at", F.col("t").cast("timestamp"))
    dn = spark.createDataFrame([("dn-a", "A name"), ("dn-b", "B name"), (None, None)], "denominationId string, name string")
    got = sorted(tuple(r) for r in survivors.place_survivors(rows, dn).collect())
    assert got == [("c", "denominationHint", "dn-a"), ("c", "sourceLists", "x"), ("c", "sourceLists", "y"), ("c", "websiteUrl", "https://new.example/")]
    assert survivors.place_survivors(rows.where("false"), dn).count() == 0
    one = survivors.records(survivors.place_survivors(rows, dn)).first()
    assert one["sourceLists"] == ["x", "y"] and one["websiteUrl"] == "https://new.example/"


def test_half_life_lets_many_votes_win(spark):
    rows = spark.createDataFrame([(1, "g", "a", "2026-01-03"), (2, "g", "b", "2026-01-02"), (3, "g", "b", "2026-01-01")], "k bigint, g string, v string, t string").withColumn("t", F.col("t").cast("timestamp"))
    long = survivors.votes(rows, {"v": (F.col("v"), F.col("v"))}, group="g", time=F.col("t"), second_time=F.col("t"), key=F.col("k"))
    assert survivors.winners(long).first()["value"] == "a"
    assert survivors.winners(long, half_life_days=365).first()["value"] == "b"


TEXTS = ["北命の港教会の公式アカウントです。毎週日曜日に礼拝をしています。", "Oração e comunhão — atenção às mudanças", "성가대원은 마당에서 화해를 배웠다고 말했습니다", "主日學的孩子說，盼望不是一天學會的功課。"]


@pytest.mark.parametrize("true,wrong", [("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac-roman"), ("utf-8", "cp932"), ("utf-8", "gb18030"), ("cp932", "latin-1"), ("euc-jp", "latin-1"), ("cp949", "latin-1")])
def test_garbled_texts_are_found(true, wrong):
    g = mojibake.automaton()
    for t in TEXTS:
        try:
            bad = t.encode(true).decode(wrong, "replace")
        except UnicodeEncodeError:
            continue
        if bad != t and not bad.isascii():
            assert g.spans(bad), (true, wrong, bad)
            if "�" not in bad and (true, wrong) in (("utf-8", "latin-1"), ("utf-8", "mac-roman")):
                assert g.restore(bad)[0] == t


def test_correct_texts_stay():
    g = mojibake.automaton()
    for t in [*TEXTS, "ÀÉÎÕÜ Choir", "Café «Ânimo»", "¿Quién soy? ½", "IRMÃ LÚCIA E A ORAÇÃO DA MANHÃ", "縁側の会 繭・糸・絆", "鬱鱒髙﨑", "ｷﾘｽﾄ教会", "Père & Fils — À LA CARTE", "Hội thánh Ân Điển", "", "御言葉の野😀"]:
        assert g.spans(t) == [] and g.restore(t) == (t, False)


def test_mixed_text_keeps_its_correct_part(spark):
    bad = "礼拝は" + "十一時".encode().decode("latin-1") + "からです"
    rows = [(1, bad, None), (2, None, "ok"), (3, "", " "), (4, "x" * 500_000, "café"), (1, bad, None)]
    got = mojibake.repair(spark.createDataFrame([(*r, "z") for r in rows], "id bigint, a string, b string, garbled string"), ["a", "b"], key="id").collect()
    assert [(r["key"], r["field"], r["original"]) for r in got] == [(1, "a", "礼拝は十一時からです")] * 2


RESTORED = [("utf-8", "cp1252", 1.0), ("utf-8", "latin-1", 1.0), ("utf-8", "cp1251", 1.0), ("utf-8", "cp437", 1.0), ("utf-8", "mac-roman", 1.0), ("utf-8", "cp1250", 1.0), ("utf-8", "cp932", 0.5), ("utf-8", "gb18030", 0.5), ("cp932", "cp1252", 0.5), ("cp932", "latin-1", 0.5), ("euc-jp", "cp1252", 0.5), ("cp949", "cp1252", 1.0)]
PLAIN = ["北命の港教会の公式アカウントです。毎週日曜日に礼拝をしています。どなたでもどうぞ。", "秋の朝、子どもたちが庭で花に水をやりました。集まりは午後二時からです。", "성가대원은 마당에서 화해를 배웠다고 말했습니다. 다음 모임은 교육관에서 열립니다."]


@pytest.mark.parametrize("true,wrong,least", RESTORED)
def test_originals_are_restored(true, wrong, least):
    """Where no byte was lost, values come back letter by letter, outside the repertoire too (emoji); of the pairs in which one
    garbled text has several readings at least the given share does. The README has the shares over many texts."""
    g, done, right = mojibake.automaton(), 0, 0
    for t in PLAIN[2:] if true == "cp949" else [*PLAIN, *(x + "😀" for x in PLAIN)]:
        try:
            raw = t.encode(true)
            bad = "".join(mojibake._single(wrong)[b] for b in raw) if wrong not in ("cp932", "gb18030") else raw.decode(wrong)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if bad.isascii() or bad == t:
            continue
        done += 1
        right += g.restore(bad)[0] == t
    assert right >= least * done


def test_packed_automaton_finds_the_same():
    g = mojibake.unpacked(mojibake.packed())
    for t in TEXTS:
        bad = t.encode().decode("latin-1")
        assert g.spans(bad) == mojibake.automaton().spans(bad) and g.restore(bad) == (t, False)


def _broadcasts(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def _profiles(spark):
    fields = "'hikari' as main, 'church' as kind, 'A' as area, 't' as town, 5L as plot, '1-2' as numbers, 'h' as host, 35D as latitude, 139D as longitude"
    return spark.range(1).selectExpr("id as entity", *fields.split(", "))


def test_no_exploded_rows_are_gathered_in_the_driver(spark):
    names = spark.createDataFrame([(1, "光の丘教会", None)], "nid bigint, name string, second string")
    parsed = N.parse_names(names, ())
    lexicon = spark.range(1).selectExpr("'p' as what", "concat('光', id) as word", "'光' as value")
    profiles = _profiles(spark)
    pairs = spark.range(1).selectExpr("id as a", "id as b", "3 as how", "1L as spread")
    assert _broadcasts(N.rewrite_names(parsed, lexicon)) == 0
    assert _broadcasts(congregations.same_names(pairs, profiles, profiles)) == 0


def test_no_candidates_are_gathered_in_the_driver(spark):
    met = spark.range(1).selectExpr("id as a", "id as b", "3 as how", "1L as spread")
    assert _broadcasts(linkage.candidates(met, _profiles(spark), _profiles(spark))) == 0
