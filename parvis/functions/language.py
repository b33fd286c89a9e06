"""Languages: codes, script and lexicon rules, and n-gram profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words that decide the language of a short query (fixed values).
PORTUGUESE = ("assembleia", "brasil", "cristo", "deus", "distrito", "evangelica", "evangélica", "igreja", "missao", "missão")
INDONESIAN = ("allah", "distrik", "gereja", "indonesia", "injil", "jemaat", "kristen", "misi", "yesus")
ENGLISH = ("assembly", "baptist", "chapel", "christ", "christian", "church", "fellowship", "gospel", "mission")
VIETNAMESE = ("chúa", "cơ", "đấng", "đức", "giáo", "hội", "nhà", "nhật", "phúc", "thánh", "tin")


def detect_query(c: Column, preferred: str = "ja") -> Column:
    """Language of a short text by script, then by letters and words that only one language has."""
    low = F.lower(c)
    words = F.array_distinct(F.filter(F.split(low, r"[^\p{L}]+"), lambda w: w != ""))
    any_of = lambda group: F.arrays_overlap(words, F.array(*map(F.lit, group)))
    viet = F.size(F.array_intersect(words, F.array(*map(F.lit, VIETNAMESE))))
    return (
        F.when(c.rlike("[\\u1100-\\u11FF\\u3130-\\u318F\\uAC00-\\uD7AF]"), "ko")
        .when(c.rlike("[\\u3040-\\u30FF]"), "ja")
        .when(c.rlike("[\\u3400-\\u4DBF\\u4E00-\\u9FFF]"), preferred if preferred in ("zh-Hans", "zh-Hant") else "ja")
        .when(low.rlike("[ăđơư]") | (viet >= 2), "vi")
        .when(low.rlike("[ãõáàâéêíóôúç]") | any_of(PORTUGUESE), "pt")
        .when(any_of(INDONESIAN), "id")
        .when(any_of(ENGLISH), "en")
        .otherwise(preferred if preferred in ("en", "pt", "id", "vi") else "en")
    )


def canonical_code(c: Column) -> Column:
    """One code per language; Chinese by script, regions dropped elsewhere. Blank gives null."""
    low = F.lower(F.trim(F.replace(c, F.lit("_"), F.lit("-"))))
    first = F.split_part(low, F.lit("-"), F.lit(1))
    return (
        F.when(low == "", None)
        .when(low.isin("zh", "zh-cn", "zh-sg", "zh-hans", "zh-hans-cn"), "zh-Hans")
        .when(low.isin("zh-tw", "zh-hk", "zh-mo", "zh-hant", "zh-hant-tw"), "zh-Hant")
        .when(first == "jp", "ja")
        .otherwise(first)
    )


def gram_folded(c: Column) -> Column:
    """Text for n-grams: anything but letters is a blank; kana and Hangul stand for their script."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}]+", " ")
    plain = F.regexp_replace(plain, "[\\u3041-\\u3096]", "あ")
    plain = F.regexp_replace(plain, "[\\u30A1-\\u30FA]", "ア")
    return F.regexp_replace(plain, "[\\uAC00-\\uD7A3]", "가")


def gram_rows(texts: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, gram) for all grams of one to three characters inside words."""
    words = texts.select(key, F.explode(F.split(gram_folded(F.col(text)), " ")).alias("w")).where("w != ''").select(key, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    each = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1))), lambda i: F.substring(F.col("w"), i, n))))
    return words.select(key, F.explode(each).alias("gram")).where("trim(gram) != ''")


def profiles(texts: DataFrame, *, language: str, text: str, least: int = 2) -> DataFrame:
    """(language, gram, freq, share): gram counts per language, rare ones dropped, shares within grams of one length."""
    counted = gram_rows(texts, key=language, text=text).groupBy(F.col(language).alias("language"), "gram").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
    totals = counted.groupBy("language", F.length("gram").alias("n")).agg(F.sum("freq").alias("total"))
    return counted.withColumn("n", F.length("gram")).join(totals, ["language", "n"]).select("language", "gram", "freq", (F.col("freq") / F.col("total")).alias("share"))


def classify(texts: DataFrame, profile: DataFrame, *, key: str, text: str, alpha: float = 0.5) -> DataFrame:
    """(key, language, score): the language with the highest log-likelihood over all grams; ties by name.

    Unseen grams count alpha / 10000. Each text's grams are counted before they meet the profiles.
    """
    floor = alpha / 10000
    grams = gram_rows(texts, key=key, text=text).groupBy(key, "gram").agg(F.count("*").alias("n"))
    sizes = grams.groupBy(key).agg(F.sum("n").alias("all"))
    met = grams.join(profile, "gram").groupBy(key, "language").agg(F.sum(F.col("n") * (F.log(F.lit(floor) + F.col("share")) - F.log(F.lit(floor)))).alias("gain"))
    scored = met.join(sizes, key).withColumn("score", F.col("gain") + F.col("all") * F.log(F.lit(floor)))
    return scored.groupBy(key).agg(F.max_by(F.struct("language", "score"), F.struct("score", F.translate("language", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("b")).select(key, "b.language", "b.score")
