"""Text normalisers as Column expressions; pandas UDFs only where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

KANA_OR_HAN = "[\\u3040-\\u30FF\\u3400-\\u9FFF]"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))

# Traditional characters and their simplified forms, for search keys only (fixed values).
TRADITIONAL = "會東門國廣體聖靈經復愛禮節團華聯協總區縣鄉鎮島澤濱邊龍長萬豐榮樂義氣學園館營業開關橋戶歷圖書師兒婦親禱講傳導舊進選達遠無歸續實應願憐獨啟創權顯處務備據號聲臺灣與為來這裡們並從於後發現幫帶領際組織網頁資訊錄點線雲"
SIMPLIFIED = "会东门国广体圣灵经复爱礼节团华联协总区县乡镇岛泽滨边龙长万丰荣乐义气学园馆营业开关桥户历图书师儿妇亲祷讲传导旧进选达远无归续实应愿怜独启创权显处务备据号声台湾与为来这里们并从于后发现帮带领际组织网页资讯录点线云"
SHINJITAI, SHINJITAI_SIMPLE = "恵沢浜辺広竜", "惠泽滨边广龙"


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, outer ones go."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def trim_all(c: Column) -> Column:
    """Without outer white space of any width."""
    return F.regexp_replace(c, "^[\\s\u3000\u00A0]+|[\\s\u3000\u00A0]+$", "")


def exact_key(c: Column) -> Column:
    """Key of exact-name search: trimmed, lower case, blanks collapsed; without blanks where kana or Han occur."""
    plain = F.regexp_replace(F.lower(trim_all(c)), r"\s+", " ")
    return F.when(plain.rlike(KANA_OR_HAN), F.regexp_replace(plain, r"\s+", "")).otherwise(plain)


def query_fold(c: Column) -> Column:
    """Fold of query text: ideographic blanks and full-width ASCII to ASCII, lower case, blanks collapsed."""
    return F.regexp_replace(F.lower(F.translate(trim_all(c), "　" + WIDE, " " + NARROW)), r"\s+", " ")


def to_hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def to_simplified(c: Column) -> Column:
    return F.translate(c, TRADITIONAL + SHINJITAI, SIMPLIFIED + SHINJITAI_SIMPLE)


def to_traditional(c: Column) -> Column:
    """Display fallback only; what was given in traditional script goes before it."""
    return F.translate(c, SIMPLIFIED + SHINJITAI, TRADITIONAL + "惠澤濱邊廣龍")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def snippet(text: Column, term: Column, width: int = 180) -> Column:
    """About ``width`` characters around the first place of the term, with ellipses where cut."""
    compact = collapse(text)
    n = F.length(compact)
    at = F.greatest(F.instr(F.lower(compact), F.lower(term)) - 1, F.lit(0))
    start = F.least(F.greatest(at - width // 3, F.lit(0)), n - width)
    cut = F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.substring(compact, start + 1, F.lit(width)), F.when(start + width < n, F.lit("…")).otherwise(F.lit("")))
    return F.when(n <= width, compact).otherwise(cut)


def chunks(text: Column, size: int = 6000, overlap: int = 500, most: int = 32) -> Column:
    """Overlapping pieces of a text; blank text gives one empty piece."""
    n = F.length(text)
    step = size - overlap
    count = F.least(F.lit(most), F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1))
    return F.when(F.trim(text) == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size))))


def hash_id(namespace: str, c: Column) -> Column:
    return F.concat(F.lit(namespace + ":"), F.substring(F.sha2(c, 256), 1, 24))


def salvage_json(c: Column, schema: str) -> Column:
    """The object between the first and the last brace of free text."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema)


def read_as_utf8(c: Column) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1; other text stays as it is."""
    narrow = ~c.rlike("[^\\x00-\\xFF]")
    raw = F.encode(c, "ISO-8859-1")
    return F.when(narrow & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(c)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def entity_form(c: Column) -> Column:
    """Form for comparing names: NFKC, lower case, without blanks and separators."""
    return F.regexp_replace(F.lower(nfkc(c)), r"[\s　・･,，.。()（）]", "")


def entity_name(c: Column) -> Column:
    return F.regexp_replace(entity_form(c), "(?:キリスト)?教会$", "教会")


def entity_address(c: Column) -> Column:
    plain = F.regexp_replace(entity_form(c), r"〒?\d{3}-?\d{4}", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "(丁目|番地?|号)", "-"), "-+", "-"), "^-+|-+$", "")


@F.pandas_udf(T.StringType())
def slug(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        plain = re.sub(r"['’‘`\"]", "", plain.lower()).replace("&", " and ")
        return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")

    return s.map(one)


def check_digit(code: Column) -> Column:
    """Last digit of a five-figure area code: 11 less the weighted sum modulo 11, ten and eleven give 0."""
    weighted = F.aggregate(F.sequence(F.lit(0), F.lit(4)), F.lit(0), lambda acc, i: acc + F.substring(code, i + 1, F.lit(1)).cast("int") * (6 - i))
    left = 11 - weighted % 11
    return F.when(left >= 10, 0).otherwise(left)
