"""Rewriting names of organisations to canonical forms, whatever words they are made of.

A written name is first brought to one alphabet of characters (width, old and look-alike characters, kana of one kind); legal
forms, affiliations and kinds are taken off wherever they stand; brackets and slashes give further spellings. What remains is
rewritten to every canonical form the rules allow: with and without a known place in front or behind, kana and known kanji
read to one romanisation, romanised words joined so that hyphens and particles don't matter, words sorted, nicknames and
abbreviations replaced, words cut to initials. The words themselves come from nowhere but the rows: readings of kanji are
learned from rows that give a native and a romanised name, places are what stands in addresses and the gazetteer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from parvis.llm.address import VARIANTS, fold_name, within_one
from parvis.session import cut, large

# Kinds of congregations, native and romanised, legal forms and confessions (fixed values of the domain, longest match first).
KINDS = {
    "福音キリスト教会": "gospel", "キリスト福音教会": "gospel", "クリスチャンチャーチ": "church", "クリスチャンセンター": "church", "キリスト教会": "church", "基督教会": "church", "キリスト集会": "mission", "バイブルチャーチ": "church", "フェローシップ": "church",
    "福音教会": "gospel", "ふくいん教会": "gospel", "華人教会": "church", "中文教会": "church", "中華教会": "church", "きょうかい": "church", "伝道教会": "mission", "キリ教会": "church", "チャペル": "chapel", "チャーチ": "church",
    "伝道所": "mission", "集会所": "mission", "修道院": "church", "大聖堂": "church", "聖堂": "church", "教会": "church", "集会": "mission",
}
LATIN_KINDS = {
    "church": "church", "ch": "church", "kyokai": "church", "kyoukai": "church", "cathedral": "church", "chapel": "chapel", "mission": "mission", "dendosho": "mission", "gospel": "gospel", "fukuin": "gospel", "christian": "", "christ": "", "kirisuto": "", "igreja": "", "iglesia": "",
    "gereja": "", "fellowship": "", "assembly": "", "the": "", "of": "", "in": "",
}
ROOMS = ("礼拝堂", "会堂", "本館", "別館")
LEGAL = ("宗教法人", "(宗)", "一般社団法人", "(一社)", "プロテスタント", "カトリック")
_BODY = re.compile(r"(教団|連合|連盟|公会|教区|兄弟団|伝道団|同盟)$")
# Short forms of given names and of words in names (a parameter of the operators; fixed values).
NICKNAMES = {
    "st": "saint", "ste": "saint", "mt": "mount", "ft": "fort", "bros": "brothers", "intl": "international", "univ": "university", "bill": "william", "will": "william", "bob": "robert", "rob": "robert", "dick": "richard", "jim": "james", "joe": "joseph", "tom": "thomas", "tony": "anthony",
    "mike": "michael", "nick": "nicholas", "dave": "david", "dan": "daniel", "ben": "benjamin", "sam": "samuel", "tim": "timothy", "ken": "kenneth", "liz": "elizabeth", "beth": "elizabeth", "kate": "katherine", "peggy": "margaret", "sue": "susan", "1st": "daiiti", "2nd": "daini", "3rd": "daisan", "i": "daiiti", "ii": "daini", "iii": "daisan",
}
LONGEST = 200  # a longer text is no name made of parts: it has one form, the whole folded text

_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_HANGUL = re.compile(r"[가-힣]")
# Kanji that look like katakana, folded where they stand in a katakana word (fixed values).
_LOOKALIKE = {"千": "チ", "卜": "ト", "一": "ー", "ニ": "ニ", "二": "ニ", "八": "ハ", "口": "ロ", "夕": "タ", "力": "カ", "工": "エ", "才": "オ"}
_SOLID = re.compile(r"[\s・･、,,.。\-_~〜★☆✿†◆◇●○■□♪※☕♡♥]+")


_ORNAMENT = re.compile(r"[†※\u2190-\u27bf\u2b00-\u2bff\U0001f000-\U0001faff]")


def hiragana(text: str) -> str:
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヴ" else c for c in text)


@lru_cache(maxsize=1)
def _syllables() -> dict[str, str]:
    """Romanisation of each kana by its Unicode name, e.g. HIRAGANA LETTER SMALL YA."""
    out = {}
    for cp in range(0x3041, 0x3097):
        name = unicodedata.name(chr(cp), "").removeprefix("HIRAGANA LETTER ").lower()
        out[chr(cp)] = name.replace("small ", "~")
    return out


def kana_romaji(text: str) -> str:
    """Kana letter by letter; other characters stay. Contracted and doubled sounds are joined."""
    table, out = _syllables(), ""
    double = False
    for c in text:
        r = table.get(c)
        if c == "っ":
            double = True
            continue
        if r is None:
            out += "" if c == "ー" else c
        elif r.startswith("~"):
            small = r[1:]
            if small[0] == "y" and out.endswith("i"):
                out = out[:-1] + small
            elif out and out[-1] in "aiueo":
                out = out[:-1] + small
            else:
                out += small
        else:
            out += (r[0] if double and r[0] not in "aiueo" else "") + r
        double = False
    return out


_SYSTEMS = (("tch", "tt"), ("ssh", "ssy"), ("cch", "tt"), ("shi", "si"), ("chi", "ti"), ("tsu", "tu"), ("sh", "sy"), ("ch", "ty"), ("fu", "hu"), ("ji", "zi"), ("jy", "zy"), ("j", "zy"), ("di", "zi"), ("du", "zu"), ("mb", "nb"), ("mp", "np"), ("mm", "nm"))


def romaji(text: str) -> str:
    """One romanisation of letters: no accents, one spelling system, no long vowels. Other characters stay."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c) or "゙" <= c <= "゚")
    text = unicodedata.normalize("NFC", text)
    for a, b in _SYSTEMS:
        text = text.replace(a, b)
    return re.sub(r"ou|o[ho](?=[^aiueo]|$)|oo", "o", text).replace("uu", "u").replace("yi", "i")


def _particles(text: str) -> str:
    """One form of the particles that connect kanji."""
    text = re.sub(r"(?<=[㐀-鿿])[ケガがヵカ](?=[丘谷崎瀬原浜岡沢])", "ヶ", text)
    return re.sub(r"(?<=.)[ノ之](?=.|$)", "の", text)


def romaji_column(text):
    """The same folding of plain letters as a Column expression."""
    text = F.lower(text)
    for a, b in _SYSTEMS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"ou|o[ho](?=[^aiueo]|$)|oo", "o"), "uu", "u"), "yi", "i")


def one_slip(a: str, b: str) -> bool:
    """Equal, or one character dropped, added or swapped with its neighbour."""
    return within_one(a, b) and (len(a) != len(b) or sorted(a) == sorted(b))


def fold(text: str) -> str:
    """One width, everyday characters, katakana look-alikes in katakana words, arabic ordinals in kanji, no ornaments."""
    s = unicodedata.normalize("NFKC", text).translate(VARIANTS)
    s = re.sub(r"[︀-️​-‏]", "", s)
    like = "".join(_LOOKALIKE)
    for _ in range(2):  # twice: in a row of look-alikes each becomes the neighbour of the next
        s = re.sub(rf"(?<=[ァ-ヶー])[{like}](?=[ァ-ヶー{like}])|(?<=[ァ-ヶー])千(?![一-鿿])|(?<=[ァ-ヶー])卜|[千卜](?=[ャュョァィェォー])|(?<=[ャュョ])一", lambda m: _LOOKALIKE[m[0]], s)
    s = s.replace("ャベル", "ャペル")
    s = re.sub(r"第([1-9])", lambda m: "第" + "〇一二三四五六七八九"[int(m[1])], s)
    s = re.sub(r"(?<![A-Za-z\d])(1st|I)\s?(?=[぀-鿿])", "第一", s)
    s = re.sub(r"(?<![A-Za-z\d])(2nd|II)\s?(?=[぀-鿿])", "第二", s)
    return _ORNAMENT.sub("", s)


@lru_cache(maxsize=1)
def _kind_rules():
    """Exact kinds at the end and in front, and the kinds that bear a slip by the characters they may end with."""
    doubled = {k[: i + 1] + k[i:] for k in KINDS if len(k) == 2 for i in (0, 1)}
    each = "|".join([*KINDS, *doubled])
    rooms = "|".join(dict.fromkeys([*ROOMS, *(r[:i] + r[i + 1 :] for r in ROOMS if len(r) > 2 for i in range(len(r)))]))
    return re.compile(f"(?<=.)({each})$"), re.compile(f"^({each})(?=..)"), re.compile(f"(?<=..)({rooms})$"), [k for k in KINDS if len(k) > 2]


def _ends(s: str) -> tuple[str, str | None]:
    """The name without rooms and kinds at its ends, and the kind that says most; a kind may carry one slip."""
    behind, before, room, slippery = _kind_rules()
    kind = None
    for _ in range(3):
        s = room.sub("", s)
        k, m = None, behind.search(s)
        for x in slippery:  # a longer kind with a slip goes before a shorter one without
            if len(x) > (len(m[1]) if m else 0) and s[-1:] in x[-2:]:
                n = next((n for n in (len(x), len(x) + 1, len(x) - 1) if n > 1 and len(s) > n and (len(x) > 3 or n == len(x)) and s[-n] in x and (one_slip(s[-n:], x) or s[-n] == x[0] and s[-1] == x[-1] and within_one(s[-n:], x))), 0)
                if n:
                    s, k = s[:-n], x
                    break
        if k is None and m:
            s, k = s[: m.start()], m[1] if m[1] in KINDS else next(k for k in KINDS if len(k) == 2 and set(k) == set(m[1]))
        elif k is None and (m := before.search(s)):
            s, k = s[m.end() :], m[1] if m[1] in KINDS else next(k for k in KINDS if len(k) == 2 and set(k) == set(m[1]))
        if k is None:
            break
        kind = KINDS[k] if kind is None or KINDS[k] != "church" else kind
    return s, kind


def parts(text: str | None, affiliations: tuple[str, ...] = ()) -> tuple[str | None, list[str], list[str], str | None]:
    """(native name, romanised words, places said beside it, kind) without legal forms, affiliations and kinds.

    Null, blank and unreadable texts give (None, [], [], None). A text of more than LONGEST characters is one native name.
    """
    if not text or not text.strip():
        return None, [], [], None
    if len(text) > LONGEST:
        return re.sub(r"\s+", " ", fold(text)).strip() or None, [], [], None
    s = fold(text)
    for x in LEGAL:
        s = s.replace(x, " ")
    inner = re.findall(r"[(【\[「](.*?)[)】\]」]", s)
    outer = re.split(r"\s*[/|]\s*|\s\|\s", re.sub(r"[(【\[「)】\]」].*?(?:[)】\]」]|$)", " ", s))
    native, latin, spots, kind = None, [], [], None
    for inside, x in [(False, x) for x in outer] + [(True, x) for x in inner]:
        x = x.strip(" ・、,|/([【「")
        if not x or x in affiliations:
            continue
        if _CJK.search(x):
            bare = re.sub(r"(?<=[぀-鿿])\s*[A-Za-z][A-Za-z\s.'\-]*$", "", x).strip()
            words = bare.split()
            while len(words) > 1 and words[0].lower().strip(".") in LATIN_KINDS:
                words = words[1:]
                bare = " ".join(words)
            if len(words) > 1 and _BODY.search(words[0]):
                bare = " ".join(words[1:])
            solid = _SOLID.sub("", bare)
            for d in affiliations:
                if solid == d or not d or not (d[0] in solid[:2] or d[1:2] and d[1] in solid[:2] or solid.endswith(d)):
                    continue
                n = next((n for n in (len(d), len(d) - 1, len(d) + 1) if (len(d) > 3 or n == len(d)) and (solid.startswith(d) if len(d) < 4 else within_one(solid[:n], d))), 0)
                if n and len(solid) > n + 1:
                    solid = solid[n:]
                elif len(d) > 2 and solid.endswith(d) and len(solid) > len(d) + 1:
                    solid = solid[: -len(d)]
            if inside and (_BODY.search(solid) or any(within_one(solid, d) or sorted(solid) == sorted(d) for d in affiliations if len(d) > 1)):
                continue
            core, k = _ends(solid)
            if k is None and (m := re.search("|".join(KINDS), core)) and m.start() > 1 and 0 < len(core) - m.end() <= 6:
                spots.append(fold_name(core[m.end() :]))  # the place behind the kind
                core, k = core[: m.start()], KINDS[m[0]]
            if core in KINDS:
                lead = re.findall(r"[A-Za-z][A-Za-z.']*", x)
                latin = latin or [w.lower() for w in lead]
                kind = kind or KINDS[core]
            elif native is None and (not inside or k) and core:
                native = hiragana(_particles(core))
            elif inside and core and k is None and len(core) <= 8:
                spots.append(fold_name(core))
            kind = kind or k
        elif re.search(r"[A-Za-z]", x) and not _HANGUL.search(x) and not latin:
            head, *tails = [y.strip() for y in x.split(",")]
            for raw in re.split(r"[\s\-]+", head.lower()):
                raw = re.sub(r"['’`.]", "", raw)
                known = raw if raw in LATIN_KINDS else next((k for k in LATIN_KINDS if len(k) > 4 and one_slip(raw, k)), None)
                if known is not None:
                    kind = kind or LATIN_KINDS[known] or None
                elif w := re.sub(r"[^\w]", "", raw):
                    latin.append(w)
            spots += [re.sub(r"\s+", "-", t.lower()) for t in tails if t]
    return native, latin, spots, kind


def spoken(words: list[str], nicknames: dict[str, str] | None = None) -> list[str]:
    """Romanised words with nicknames and abbreviations replaced."""
    table = NICKNAMES if nicknames is None else nicknames
    return [table.get(w, w) for w in words]


def read(native: str, readings: dict[str, str]) -> str:
    """The romanisation of a native name: known words longest first, kana by rule; kanji without a reading stay."""
    out, i = "", 0
    longest = max(map(len, readings), default=0)
    while i < len(native):
        n = next((n for n in range(min(longest, len(native) - i), 0, -1) if native[i : i + n] in readings), 0)
        if n:
            out += readings[native[i : i + n]]
            i += n
        else:
            j = i + 1
            while j < len(native) and not any(native[j : j + n] in readings for n in range(min(longest, len(native) - j), 0, -1)):
                j += 1
            out += kana_romaji(native[i:j])
            i = j
    return romaji(out)


def rewritings(native: str | None, latin: list[str], spots: list[str], lexicon: dict[str, dict[str, str]], nicknames: dict[str, str] | None = None) -> list[tuple[str | None, str, str, str]]:
    """Every (place, key, raw form, rule) of a name. The first one is the likeliest reading.

    ``lexicon`` maps kinds of knowledge to what it says of the name's own pieces: "p" known places, "q" native places of
    romanised ones, "r" readings, "w" romanised words that aren't places. Rules: "own" the name itself, "sorted" its words in one order, "initial" its words cut to
    initials.
    """
    places, said, readings, common = lexicon.get("p", {}), lexicon.get("q", {}), lexicon.get("r", {}), lexicon.get("w", {})
    out: list[tuple[str | None, str, str, str]] = []
    told = [p for x in spots if (p := said.get(romaji(x).replace("-", "")) if x.isascii() else hiragana(x) if hiragana(x) in places else None)]
    if native:
        if len(native) > LONGEST:
            return [(None, native, native, "own")]
        cut = [n for n in range(min(8, len(native) - 1), 0, -1) if native[:n] in places and native[n] not in "のノ之ヶ"]
        if not told:
            out += [(native[:n], read(native[n:], readings), native[n:], "own") for n in cut if len(native) - n > 1 or n > 1]
        out.append((told[0] if told else None, read(native, readings), native, "own"))
        if told:
            out += [(native[:n], read(native[n:], readings), native[n:], "own") for n in cut if native[:n] == told[0]]
    if latin:
        words = spoken(latin, nicknames)
        seen = [(told[0] if told else None, words)]
        for n in (1, 2):
            if len(words) > n:
                for place, rest in ((romaji("".join(words[:n])), words[n:]), (romaji("".join(words[-n:])), words[:-n])):
                    if place in said and rest[0] != "no":
                        seen.insert(0, (said[place], rest))
        known = [w == "no" or r in common or r.removesuffix("no") in common for w, r in zip(words, map(romaji, words))]
        if any(k and w != "no" for k, w in zip(known, words)) and not (known[0] and known[-1]):  # unknown words around known ones are a place
            i, j = known.index(True), len(known) - known[::-1].index(True)
            i += words[i] == "no" and j - i > 1
            seen.insert(0, (None, words[i:j]))
        for place, rest in seen:
            key = romaji("".join(rest))
            out.append((place, key, key, "own"))
            if len(rest) > 2:
                out.append((place, romaji("".join(sorted(rest))), key, "sorted"))
            if len(rest) > 1 and len(rest[-1]) > 2:
                out.append((place, romaji("".join(w[0] for w in rest[:-1]) + rest[-1]), "i" if any(len(w) == 1 for w in rest[:-1]) else "", "initial"))
    return [(p, k, r, how) for p, k, r, how in dict.fromkeys(out) if k]


def parse_names(names: DataFrame, affiliations: tuple[str, ...]) -> DataFrame:
    """(nid, native, latin, words, spots, asks, kind) of distinct (nid, name, second) rows; ``second`` is a romanised name given
    beside, ``words`` the romanised words of one of the two, ``asks`` the romanised pieces that may be places."""
    sent = names.sparkSession.sparkContext.broadcast(affiliations)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            got = [parts(x, known) for x in batch.column(1).to_pylist()]
            other = [[romaji(w) for w in spoken(parts(x, known)[1] or g[1])] for x, g in zip(batch.column(2).to_pylist(), got)]
            asks = [[*{romaji(w).replace("-", "") for w in (*(spoken(g[1])), *map("".join, zip(g[1], g[1][1:])), *(x for x in g[2] if x.isascii()))}] for g in got]
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], words), pa.array(other, words), pa.array([g[2] for g in got], words), pa.array(asks, words), pa.array([g[3] for g in got], pa.string())],
                ["nid", "native", "latin", "words", "spots", "asks", "kind"],
            )

    return names.select("nid", "name", "second").mapInArrow(scan, "nid bigint, native string, latin array<string>, words array<string>, spots array<string>, asks array<string>, kind string")


def _pieces(text, least: int, most: int, only_start: bool = False):
    """Array of the substrings of a string column from ``least`` to ``most`` characters."""
    n = F.length(text)
    starts = F.array(F.lit(1)) if only_start else F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(LONGEST)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: i + k - 1 <= n), lambda k: F.substring(text, i, k)))))


_KANJI_PIECE = r"^(?!.*[のノ]$)(?![のノ]).*[\x{3400}-\x{9fff}々].*$"


def learn_readings(parsed: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """(word, reading): what romanised words stand for, by how often a piece of the native name and a word of the romanised one
    of the same row go together (Dice coefficient of distinct rows). Counts are combinable; the longest piece wins ties."""
    both = parsed.select("native", "words").where(f"native is not null and size(words) > 0 and length(native) <= {LONGEST}").distinct()
    # particles joined to a word are taken off, a particle of its own counts only at the end
    words = F.transform("words", lambda w, i: F.when((w == "no") & (i + 1 < F.size("words")), None).when((F.length(w) > 3) & w.endswith("no") & (i + 1 < F.size("words")), F.regexp_replace(w, "no$", "")).otherwise(w))
    pairs = both.select(F.filter(_pieces(F.col("native"), 1, 4), lambda s: s.rlike(_KANJI_PIECE)).alias("s"), F.array_distinct(F.array_compact(words)).alias("t"))
    # one pass: a piece with a word, a piece alone and a word alone are three kinds of rows of one count
    one = F.concat(
        F.flatten(F.transform("s", lambda s: F.transform(F.col("t"), lambda t: F.struct(s.alias("s"), t.alias("t"))))),
        F.transform("s", lambda s: F.struct(s.alias("s"), F.lit("").alias("t"))),
        F.transform("t", lambda t: F.struct(F.lit("").alias("s"), t.alias("t"))),
    )
    n = cut(pairs.select(F.explode(one).alias("x")).groupBy("x.s", "x.t").agg(F.count("*").alias("n")).where(f"n >= {least}"))
    met = n.where("s != '' and t != ''").join(large(n.where("t = ''").select("s", F.col("n").alias("ns"))), "s").join(large(n.where("s = ''").select("t", F.col("n").alias("nt"))), "t")
    met = met.withColumn("dice", 2 * F.col("n") / (F.col("ns") + F.col("nt"))).where(F.col("dice") >= share)
    # the longest piece that goes with the word nearly as well as the best one
    good = met.withColumn("most", F.max("dice").over(Window.partitionBy("t"))).where("dice >= 0.85 * most")
    best = good.groupBy("t").agg(F.max_by(F.struct("s", "dice"), F.struct(F.length("s"), "dice", "s")).alias("b"))
    return best.groupBy(F.col("b.s").alias("word")).agg(F.max_by("t", F.struct("b.dice", "t")).alias("reading"))


def rewrite_names(parsed: DataFrame, lexicon: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(nid, place, key, raw, rule, first): every rewriting of every parsed name.

    ``lexicon`` holds (what, word, value). The pieces of each name meet it by an equi-join on the word, so that it may be of
    any size; what is gathered for a name is bounded by its own length.
    """
    plain = F.coalesce(F.col("native"), F.lit(""))
    short = F.length(plain) <= LONGEST
    places = F.concat(F.when(short, _pieces(plain, 1, 8, True)).otherwise(F.array().cast("array<string>")), F.coalesce("spots", F.array().cast("array<string>")))
    kanji = F.when(short, F.filter(_pieces(plain, 1, 4), lambda s: s.rlike(_KANJI_PIECE))).otherwise(F.array().cast("array<string>"))
    ask = F.concat(
        F.transform(places, lambda w: F.struct(F.lit("p").alias("what"), w.alias("word"))),
        F.transform(kanji, lambda w: F.struct(F.lit("r").alias("what"), w.alias("word"))),
        F.transform("asks", lambda w: F.struct(F.lit("q").alias("what"), w.alias("word"))),
        F.transform("asks", lambda w: F.struct(F.lit("w").alias("what"), F.when(F.length(w) > 3, F.regexp_replace(w, "no$", "")).otherwise(w).alias("word"))),
    )
    pieces = parsed.select("nid", F.explode(F.array_distinct(ask)).alias("x")).select("nid", "x.what", "x.word")
    hits = pieces.join(large(lexicon), ["what", "word"]).groupBy("nid").agg(F.collect_set(F.struct("what", "word", "value")).alias("hits"))
    full = parsed.select("nid", "native", "latin", "spots").join(large(hits), "nid", "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for nid, native, words, spots, found in zip(*(c.to_pylist() for c in batch.columns)):
                own: dict[str, dict[str, str]] = {}
                for h in sorted(found or (), key=lambda h: (h["what"], h["word"], h["value"])):
                    own.setdefault(h["what"], {})[h["word"]] = h["value"]
                for n, r in enumerate(rewritings(native, words or [], spots or [], own, nicknames)):
                    ids.append(nid)
                    rows.append((*r, n == 0))
            c = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c[i], pa.string()) for i in range(4)), pa.array(c[4], pa.bool_())], ["nid", "place", "key", "raw", "rule", "first"])

    return full.mapInArrow(scan, "nid bigint, place string, key string, raw string, rule string, first boolean")
