import random

import numpy as np
from pyspark.sql import functions as F

from parvis.llm import boilerplate, quality, tree


def test_tree_separates():
    r = np.random.default_rng(0)
    x = r.random((400, 3))
    y = (x[:, 1] > 0.4) & (x[:, 2] < 0.7)
    t = tree.Tree(4).fit(x, y)
    assert ((t.score(x) >= 0.5) == y).mean() > 0.97


def test_held_out_accuracy():
    """Other seeds give other words, sites and pools: nothing of the test was in the fit."""
    for seed in (11, 12):
        x, y = boilerplate.table_of(boilerplate.labelled_sites(600, seed=seed))
        got = boilerplate.fitted().score(x) >= 0.5
        assert (got == (y > 0)).mean() > 0.95
        assert (got & (y > 0)).sum() > 0.93 * got.sum() and (got & (y > 0)).sum() > 0.93 * y.sum()


MENUS = (["私たちについて", "ミニストリー", "動画配信", "オンライン献金", "メルマガ登録", "利用規約"], ["Über uns", "Gemeindebrief", "Spenden", "Impressum", "Datenschutz"], ["О нас", "Расписание", "Проповеди", "Контакты", "Пожертвования"])
WHO = (["子どもたち", "長老", "近所の方", "若者", "聖歌隊"], ["Die Kinder", "Der Chor", "Eine Nachbarin", "Viele Familien", "Die Jugend"], ["Дети", "Соседи", "Хор", "Молодёжь", "Старейшины"])
DO = (["が庭で落ち葉を集め、焼き芋を分け合いました", "が会堂の屋根を直し、夜まで語り合いました", "が港の市場で花を売り、募金を届けました", "が古い手紙を読み、昔を思い出しました"], [" sammelten im Garten Laub und teilten Kuchen", " sangen am Abend ohne Orgel und lachten viel", " reparierten lange das alte Dach am Turm", " lasen alte Briefe und dachten an früher"], [" собрали листья в саду за старой церковью", " долго пели вечером без органа и смеялись", " читали старые письма и вспоминали прошлое", " продавали цветы на рынке у самой реки"])


def _sites():
    """Pages of sites whose menus are in no list: (page_id, url, title, content, body lines)."""
    out, pick = [], random.Random(4)
    for k in range(36):
        menu, end = MENUS[k % 3], "。" if k % 3 == 0 else ". "
        for n in range(4):
            told = ["".join(pick.choice(WHO[k % 3]) + pick.choice(DO[k % 3]) + end for _ in range(pick.randint(2, 4))).strip() for _ in range(3)]
            lines = [f"Site {k} name", *[f"- {m}" for m in menu], *told, menu[-1], f"© 20{10 + k % 9} Site {k} name"]
            body = list(range(1 + len(menu), 4 + len(menu)))
            out.append((10 * k + n, f"https://s{k}.example/{n}", None, "\n".join(lines), body))
    return out


def test_foreign_menu_words(spark):
    sites = _sites()
    pages = spark.createDataFrame([s[:4] for s in sites], "page_id bigint, url string, title string, content string")
    got = {tuple(r) for r in boilerplate.find_body_lines(pages).collect()}
    want = {(s[0], n) for s in sites for n in s[4]}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_body_of_a_page(spark):
    extra = [(9001, None, "t", None), (9002, None, "t", ""), (9003, "x", "t", " \n\n"), (9004, None, None, "x" * 300_000)]
    rows = [s[:4] for s in _sites()]
    pages = spark.createDataFrame([(*r, "clash") for r in rows + rows[:1] + extra], "page_id bigint, url string, title string, content string, body string")
    lines = boilerplate.find_body_lines(pages).groupBy("page_id").count()
    counts = {r["page_id"]: r["count"] for r in lines.collect()}
    assert counts[0] == 2 * counts[1] > 0 and not {9001, 9002, 9003} & set(counts)  # repeated rows count
    bodies = {r["page_id"]: r["body"] for r in boilerplate.extract_body(pages).where("page_id > 9000").collect()}
    assert bodies[9001] is None and bodies[9002] == "" and bodies[9003] == ""
    assert boilerplate.find_body_lines(pages.where("false")).count() == 0
    assert boilerplate.extract_body(pages.drop("url", "title")).count() == pages.count()


def test_recurrence_is_the_same_in_spark(spark):
    sites = _sites()
    pages = spark.createDataFrame([(k // 4, c) for k, (_, _, _, c, _) in enumerate(sites)], "site bigint, content string")
    known, repeated = boilerplate.recurrence(pages)
    plain, of = boilerplate._recurring([(k // 4, c) for k, (_, _, _, c, _) in enumerate(sites)])
    assert {k: (round(a, 9), round(b, 9)) for k, a, b in known} == {k: (round(a, 9), round(b, 9)) for k, (a, b) in plain.of.items()}
    assert {r["site"]: set(r["repeated"]) for r in repeated.collect()} == of


PROSE = "The talk on rest left a bright impression on our pastor, and the children asked for a longer discussion in the old chapel. "
SAMPLES = {
    "prose": [PROSE * 3, "わたしたちは丘の上の会堂に集まり、子どもたちと一緒に讃美歌を歌いました。雨の朝でしたが、たくさんの方が来てくださいました。\n" * 2, "다음 모임은 교육관에서 열리며 기도 제목을\n준비합니다. 다음 모임은 마당에서 열리며\n담요를 준비합니다.", "教會成立已經八年，我們一直默默服事，大家都為這個社區祈禱。" * 3, "Report\n" + PROSE * 2],
    "other": ["讃美 414番 静かな岸辺\n7月7日 遠足\n祈祷会 18:00\n" * 5, "| a | 12 | 33-1 |\n| b | 14 | 35-1 |\n" * 8, '{"k1":52,"v":[7,2]}\n' * 9, "教会 " * 120, (PROSE.strip() + "\n") * 40, "https://a.example/1\nhttps://b.example/2\n" * 6, "", "   ", "…", None, "zl mlzs cgyn dwqw qz ndkgzfvx hwr vkslj wmth xg cgljq lq vcgf xgjxglttxdh lajbwrnvn mtymg " * 3, "或鮎按渥阿袷唖暗梓娃闇鮎葵挨鯵袷按斡安按握鮎或旭逢按粟暗宛旭哀偉袷穐粟悪渥飴或逢" * 3],
}


def test_text_types(spark):
    rows = [(i, t, 0.0) for i, t in enumerate(SAMPLES["prose"])] + [(100 + i, t, 0.0) for i, t in enumerate(SAMPLES["other"])]
    docs = spark.createDataFrame(rows * 2, "doc_id bigint, text string, p_prose double")
    got = quality.text_types(quality.text_statistics(docs)).groupBy("doc_id").agg(F.min("p_prose").alias("p")).collect()
    assert {r["doc_id"] for r in got if r["p"] >= 0.5} == set(range(len(SAMPLES["prose"])))
    assert quality.text_types(quality.text_statistics(docs.where("false"))).count() == 0


def test_statistics_do_not_depend_on_the_batch():
    texts = [t for group in SAMPLES.values() for t in group]
    whole = quality.statistics(texts)
    for i, t in enumerate(texts):
        alone = quality.statistics([t])
        assert all(np.isclose(whole[k][i], alone[k][0]) for k in quality.FIELDS), t
    small = quality.statistics(texts, at_once=50)
    assert all(np.allclose(whole[k], small[k]) for k in quality.FIELDS)


def test_statistics_of_a_known_text():
    s = quality.statistics(["Hello world.\nBye\n\n12 34"])
    assert (s["n_words"][0], s["n_lines"][0], round(float(s["end_ratio"][0]), 3)) == (3, 3, 0.333)


OTHER_SCRIPTS = [
    "В воскресенье дети собрали листья в саду за церковью. Соседи принесли хлеб и остались на долгий разговор о жизни и вере.", "Την Κυριακή τα παιδιά μάζεψαν φύλλα στον κήπο πίσω από την εκκλησία. Οι γείτονες έφεραν ψωμί.", "في يوم الأحد جمع الأطفال الأوراق في الحديقة خلف الكنيسة وأحضر الجيران الخبز وبقوا للحديث.",
    "ในวันอาทิตย์เด็กๆ เก็บใบไม้ในสวนหลังโบสถ์ เพื่อนบ้านนำขนมปังมาและอยู่คุยกันนาน", "रविवार को बच्चों ने गिरजाघर के पीछे बगीचे में पत्ते इकट्ठे किए और पड़ोसी रोटी लाए।", "Dimanche les enfants ont ramassé des feuilles dans le jardin derrière l'église, et les voisins ont apporté du pain.",
]


def test_prose_of_other_scripts(spark):
    rows = [(i, t * 3) for i, t in enumerate(OTHER_SCRIPTS)] + [(50, "12 | 44 | 9\n" * 20)]
    got = quality.text_types(quality.text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string")), keep=()).collect()
    assert {r["doc_id"] for r in got if r["p_prose"] >= 0.5} == set(range(len(OTHER_SCRIPTS)))


def test_common_words_of_any_length():
    s = quality.statistics(["which những orang", "xhich nhxng oranq"])
    assert float(s["common_ratio"][0]) == 1.0 and float(s["common_ratio"][1]) == 0.0
