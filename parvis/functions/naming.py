"""Public names: cleanup, language of a title, localised values, parts of names, contacts and ministers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from parvis.functions.text import nfkc, trim_all

_EDGE = r"[\s/|｜・･:：;；,_，\-‐‑‒–—―~〜]+"


def public_name(c: Column) -> Column:
    """A name without labels of the legal entity and without separators at its ends."""
    plain = F.regexp_replace(nfkc(c), r"[(\[{【〈《「『]\s*宗(?:教法人)?\s*[)\]}】〉》」』]", "")
    plain = F.trim(F.regexp_replace(F.replace(plain, F.lit("宗教法人"), F.lit("")), r"\s+", " "))
    return F.trim(F.regexp_replace(plain, f"^{_EDGE}|{_EDGE}$", ""))


# Words of titles that only one language uses for a congregation (fixed values).
TITLE_WORDS = {"id": "gereja|jemaat", "pt": "igreja|assembleia|congregação|comunidade|ministerio", "es": "iglesia|cristiana", "de": "kirche|gemeinde", "fr": "église|eglise", "it": "chiesa", "tl": "simbahan", "en": "church|christ|christian|bible|gospel|chapel|ministry|ministries|fellowship|community|grace"}


def title_languages(c: Column) -> Column:
    """Languages a title shows: by script, and by words of congregations; other Latin titles count as English."""
    kana, han, hangul = c.rlike("[\\u3040-\\u30FF]"), c.rlike("[\\u3400-\\u9FFF]"), c.rlike("[\\uAC00-\\uD7AF\\u1100-\\u11FF]")
    words = [F.when(c.rlike(rf"(?iu)\b({w})\b"), code) for code, w in TITLE_WORDS.items()]
    script = [F.when(kana | (han & ~hangul), "ja"), F.when(hangul, "ko")]
    by_word = F.array_compact(F.array(*words))
    plain = F.when((F.size(by_word) == 0) & c.rlike("[A-Za-z]{2,}"), "en")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*script, plain), by_word))))


# What a denomination's name loses inside a church's name, per language: suffixes, prefixes (fixed values).
AFFIXES = {
    "ja": (("教会", "教団"), ()), "en": ((" Church", " Denomination"), ()), "ko": ((" 교회", "교회", " 교단", "교단"), ()), "pt": ((), ("Igreja ", "Igrejas ")), "id": ((), ("Gereja ",)),
    "vi": ((), ("Hội Thánh ", "Giáo hội ", "Nhà thờ ")), "zh-Hans": (("教会", "教派"), ()), "zh-Hant": (("教會", "教派"), ()),
}


def denomination_part(c: Column, language: str) -> Column:
    """A denomination's name without its word for congregation; lower-case English acronyms are set in capitals."""
    out = F.trim(c)
    suffixes, prefixes = AFFIXES[language]
    for s in suffixes:
        out = F.when(F.endswith(out, F.lit(s)), F.substring(out, F.lit(1), F.length(out) - len(s))).otherwise(out)
    for p in prefixes:
        out = F.when(F.startswith(out, F.lit(p)), F.substring(out, F.lit(len(p) + 1), F.length(out))).otherwise(out)
    out = F.trim(out)
    return F.when(out.rlike("^[a-z][a-z0-9.-]*$"), F.upper(out)).otherwise(out) if language == "en" else out


_ORDER = {"MANUAL": 800, "OFFICIAL": 700, "GENERATED": 500, "IMPORTED": 400}
_REVIEW = {"REVIEWED": 1000, "UNREVIEWED": 0, "NEEDS_REVIEW": -100}


def localised(values: Column, language: str, english: Column, japanese: Column) -> Column:
    """Best value for a language from array<struct<languageCode, name, source, reviewStatus, confidence>>.

    Rejected values are out; without metadata a value ranks 600. Then the fallbacks: Chinese takes the other script and
    Japanese before English, other languages take English before Japanese, at last any value.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))

    def rank(x: Column) -> Column:
        source, review = F.lit(400), F.lit(0)
        for k, v in _ORDER.items():
            source = F.when(x["source"] == k, v).otherwise(source)
        for k, v in _REVIEW.items():
            review = F.when(x["reviewStatus"] == k, v).otherwise(review)
        return F.when(x["source"].isNull() & x["reviewStatus"].isNull(), 600).otherwise(source + review)

    def best(code: str) -> Column:
        own = F.filter(values, lambda x: (x["languageCode"] == code) & (F.trim(x["name"]) != "") & ~F.coalesce(x["reviewStatus"] == "REJECTED", F.lit(False)))
        ranked = F.transform(own, lambda x: F.struct(rank(x).alias("r"), F.coalesce(x["confidence"], F.lit(0.0)).alias("c"), x["name"].alias("name")))
        return F.array_max(ranked)["name"]

    first = F.get(F.filter(F.transform(values, lambda x: x["name"]), lambda n: F.trim(n) != ""), F.lit(0))
    other = {"zh-Hans": "zh-Hant", "zh-Hant": "zh-Hans"}.get(language)
    if other:
        return F.coalesce(best(language), best(other), blank(japanese), best("ja"), blank(english), best("en"), first)
    return F.coalesce(best(language), blank(english), best("en"), blank(japanese), best("ja"), first)


_NUMBER = r"([0-9０-９()（）+\-ー－‐/\s　]{8,})"


def phone(c: Column) -> Column:
    return F.nullif(trim_all(F.regexp_extract(c, r"(?:TEL|Tel|℡|電話(?:番号)?)[\s　]*[:：]?[\s　]*" + _NUMBER, 1)), F.lit(""))


def fax(c: Column) -> Column:
    return F.nullif(trim_all(F.regexp_extract(c, r"(?:FAX|Fax)[\s　]*[:：]?[\s　]*" + _NUMBER, 1)), F.lit(""))


def email(c: Column) -> Column:
    """First e-mail address, with the sign restored where it was spelled out."""
    found = F.regexp_extract(c, r"(?i)[A-Z0-9._%+\-]+(?:@|＠|\s*(?:\[at]|\(at\)|※)\s*)[A-Z0-9.\-]+\.[A-Z]{2,}", 0)
    return F.nullif(F.regexp_replace(found, r"(?i)\s*(?:\[at]|\(at\)|※|＠)\s*", "@"), F.lit(""))


# Roles of ministers: id and the words for it in directories (fixed values).
ROLES = {
    "senior_pastor": ("主任牧師", "主管牧師"), "lead_pastor": ("担任牧師", "主任担任教師", "担任教師"), "associate_pastor": ("副牧師", "補教師"), "cooperating_pastor": ("協力牧師",), "acting_pastor": ("代理牧師",), "pastor_emeritus": ("名誉牧師", "隠退牧師"),
    "pastor": ("牧師", "正教師"), "evangelist": ("伝道師", "伝道者", "伝教者"), "missionary": ("宣教師",), "priest": ("司祭", "司牧"), "deacon": ("輔祭",), "elder": ("長老",), "minister": ("教職", "教師"), "person_in_charge": ("責任者",),
}


def ministers(rows: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, role, name) of people named after a role in directory text, several names per role split; each once."""
    words = sorted(((w, r) for r, ws in ROLES.items() for w in ws), key=lambda x: -len(x[0]))
    pattern = "|".join(w for w, _ in words)
    plain = F.regexp_replace(F.translate(F.col(text), " 　", "  "), r"[ \t]+", " ")
    found = F.expr("regexp_extract_all(t, p, 0)")
    inline = rf"(?:{pattern})(?: ?[：:・] ?| )(.+?)(?= ?(?:(?:{pattern})[：:・ ]|TEL|Tel|電話|FAX|Fax|https?://|〒|\d{{3}}-\d{{4}}|$))"
    each = rows.select(F.col(key).alias("key"), plain.alias("t"), F.lit(inline).alias("p")).select("key", F.explode(found).alias("m"))
    role = F.lit(None).cast("string")
    for w, r in reversed(words):
        role = F.when(F.startswith(F.col("m"), F.lit(w)), r).otherwise(role)
    names = F.split(F.regexp_replace("m", rf"^(?:{pattern}) ?[：:・]? ?", ""), r" ?[、,，／/] ?")
    out = each.select("key", role.alias("role"), F.explode(names).alias("name")).select("key", "role", F.trim(F.regexp_replace("name", r"[（(][^）)]*[）)]|[。;；\s]+$", "")).alias("name"))
    return out.where(F.length("name").between(2, 30) & ~F.col("name").rlike(r"\d|教会|伝道所|不在|募集中|未定|礼拝|です|ます")).distinct()


class Trie:
    """Longest matches of dictionary keys, left to right."""

    def __init__(self, entries: dict[str, str], least: int = 2) -> None:
        self.root: dict = {}
        for k in entries:
            if len(k) >= least:
                node = self.root
                for c in k:
                    node = node.setdefault(c, {})
                node[""] = entries[k]

    def parts(self, text: str) -> Iterator[tuple[str, str | None]]:
        """(piece, its translation or None) in order; what no key matches is one piece."""
        i = start = 0
        while i < len(text):
            node, end, said = self.root, -1, None
            for j in range(i, len(text)):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    end, said = j + 1, node[""]
            if end < 0:
                i += 1
                continue
            if start < i:
                yield text[start:i], None
            yield text[i:end], said
            i = start = end
        if start < len(text):
            yield text[start:], None


def translate_by_dictionary(rows: DataFrame, entries: DataFrame, *, key: str, text: str, most: int = 500_000) -> DataFrame:
    """(key, translated, matched, unmatched): text cut by longest match and rendered piece by piece, unknown pieces kept.

    entries (source, target) is a dictionary; it is collected within a checked bound and broadcast.
    """
    known = entries.limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} dictionary entries")
    sent = rows.sparkSession.sparkContext.broadcast({r["source"]: r["target"] for r in known if r["source"]})

    def run(batches):
        trie = Trie(sent.value)
        for b in batches:
            pieces = [list(trie.parts(t)) if t else [] for t in b["text"]]
            yield pd.DataFrame({"key": b["key"], "translated": [None if t is None else " ".join(x if s is None else s for x, s in p).strip() for t, p in zip(b["text"], pieces)], "matched": [[x for x, s in p if s is not None] for p in pieces], "unmatched": [[x for x, s in p if s is None] for p in pieces]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, translated string, matched array<string>, unmatched array<string>")


_INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
_SOUND = {"k": "ㅋ", "s": "ㅅ", "t": "ㅌ", "n": "ㄴ", "h": "ㅎ", "m": "ㅁ", "y": "ㅇ", "r": "ㄹ", "w": "ㅇ", "g": "ㄱ", "z": "ㅈ", "d": "ㄷ", "b": "ㅂ", "p": "ㅍ", "j": "ㅈ", "ch": "ㅊ", "ts": "ㅆ", "sh": "ㅅ", "f": "ㅎ", "": "ㅇ", "ky": "ㅋ", "gy": "ㄱ", "ny": "ㄴ", "hy": "ㅎ", "my": "ㅁ", "ry": "ㄹ", "by": "ㅂ", "py": "ㅍ"}
_VOWEL = {"a": 0, "i": 20, "u": 13, "e": 5, "o": 8, "ya": 2, "yu": 17, "yo": 12, "wa": 9, "eu": 18}
_SOFT = {"ㅋ": "ㄱ", "ㅌ": "ㄷ", "ㅊ": "ㅈ"}


def romaji_to_hangul(text: str | None) -> str | None:
    """Korean spelling of romanised Japanese, syllable by syllable; None where a part can't be read. The first of a word is soft."""
    if not text or not text.strip():
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    out = []
    for word in re.split(r"[\s\-]+", plain.strip()):
        word = re.sub(r"ou|oo", "o", re.sub("uu", "u", word))
        i, got = 0, ""
        while i < len(word):
            m = re.match(r"(ky|gy|ny|hy|my|ry|by|py|sh|ch|ts|[kstnhmyrwgzdbpjf]?)([aiueo])", word[i:])
            if m:
                c, v = m.groups()
                vowel = {"a": "ya", "u": "yu", "o": "yo"}.get(v, v) if len(c) == 2 and c[1] in "yh" and c not in ("ch", "sh") or c == "y" or c == "sh" and v in "auo" else v
                vowel = "eu" if (c, v) in (("s", "u"), ("ts", "u"), ("z", "u")) else "wa" if (c, v) == ("w", "a") else vowel
                sound = _SOUND[c]
                if i == 0:
                    sound = _SOFT.get(sound, sound)
                got += chr(0xAC00 + (_INITIALS.index(sound) * 21 + _VOWEL[vowel]) * 28)
                i += len(m[0])
            elif word[i] in "nm" and got:
                got = got[:-1] + chr(ord(got[-1]) + 4) if (ord(got[-1]) - 0xAC00) % 28 == 0 else got
                i += 1
            elif got and i + 1 < len(word) and word[i] == word[i + 1] or word[i : i + 2] == "tc":
                got = got[:-1] + chr(ord(got[-1]) + 19) if (ord(got[-1]) - 0xAC00) % 28 == 0 else got
                i += 1
            else:
                return None
        out.append(got)
    return " ".join(out)


@F.pandas_udf(T.StringType())
def hangul(s: pd.Series) -> pd.Series:
    return s.map(romaji_to_hangul)


def geoname_rejection(c: Column, reviewed: DataFrame | None = None) -> Column:
    """Why a place name is unusable: only katakana, or a block of an address; null where it is usable."""
    name = F.trim(c)
    return F.when(name.rlike("^[ァ-ヺヽヾー・]+$"), "KATAKANA_ONLY").when(name.rlike("^[〇一二三四五六七八九十百千万0-9０-９]+丁目$"), "ADDRESS_BLOCK")


# Signals of accounts (fixed patterns).
CHURCH_SIGNAL = "(?i)教会|伝道所|チャペル|礼拝堂|聖堂|church|chapel|parish|congregation|igreja|교회|성당|gereja"
OTHER_SIGNAL = "(?i)神学校|学院|保育園|幼稚園|学校|大学|キャンプ|聖書協会|放送|出版社|書店|ミニストリー|ministry|seminary|school|camp|association|music|musician|singer|artist"
JAPAN_SIGNAL = "(?i)[ぁ-んァ-ヶ一-龯]|japan|tokyo|osaka|kyoto|kobe|nagoya|yokohama|sapporo|fukuoka|okinawa"


def account_exclusion(name: Column, description: Column) -> Column:
    """Why an account is no church of the country, null where it may be one."""
    text = F.concat_ws(" ", name, F.coalesce(description, F.lit("")))
    church = text.rlike(CHURCH_SIGNAL)
    return F.when(text.rlike(OTHER_SIGNAL) & ~church, "other organisation").when(~church, "no church").when(~text.rlike(JAPAN_SIGNAL), "abroad")


def resolve_slug_collisions(rows: DataFrame, *, key: str, slug: str, prefixes: str) -> DataFrame:
    """(key, slug): slugs made unique over all rows, by location prefixes where names collide.

    A slug of one row stays. Rows of a shared slug propose their first prefix, then the next, at last their key: in each round a
    proposal that no earlier round gave away goes to its least key, the others propose again. Every round is an anti-join and
    an arg-min, so that no task holds a group, and the longest prefix list bounds the rounds. Keys must be unique.
    """
    from parvis.session import cut

    own = cut(rows.select(F.col(key).alias("key"), F.col(slug).alias("base"), F.coalesce(F.col(prefixes), F.array().cast("array<string>")).alias("options")))
    shared = own.groupBy("base").agg(F.count("*").alias("n")).where("n > 1").select("base")
    done = cut(own.join(shared, "base", "left_anti").select("key", F.col("base").alias("slug")))
    left = own.join(shared, "base", "left_semi").withColumn("options", F.concat(F.transform(F.filter("options", lambda o: o.isNotNull() & (o != "")), lambda o: F.concat(o, F.lit("-"), F.col("base"))), F.array(F.concat("base", F.lit("-"), F.col("key").cast("string")))))
    turn = 0
    left = cut(left.select("key", "options"))
    while not left.isEmpty():
        at = F.lit(turn)
        last = F.element_at("options", -1)  # beyond the list: the key's own slug, made longer until it is free
        proposed = left.select("key", "options", F.when(at < F.size("options"), F.get("options", at)).otherwise(F.concat(last, F.repeat(F.lit("-x"), F.greatest(at - F.size("options") + 1, F.lit(1))))).alias("slug"))
        free = proposed.join(done.select("slug"), "slug", "left_anti")
        won = cut(free.groupBy("slug").agg(F.min("key").alias("key")).select("key", "slug"))
        done, left, turn = cut(done.unionByName(won)), cut(left.join(won.select("key"), "key", "left_anti")), turn + 1
    return done
