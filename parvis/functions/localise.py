"""Names in other languages: parts of a title, word order, protected names, longest matches with offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from parvis.functions.naming import Trie

# How a congregation is called, and whether the word stands before the name (fixed values).
CONGREGATION = {"en": ("Church", False), "ko": ("교회", False), "pt": ("Igreja", True), "id": ("Gereja", True), "vi": ("Hội Thánh", True), "zh-Hans": ("教会", False), "zh-Hant": ("教會", False)}

_PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("japanese", "latin", "korean", "pattern")])


@F.pandas_udf(_PARTS)
def decompose_title(s: pd.Series) -> pd.DataFrame:
    """Japanese, Latin and Korean parts of a title and the pattern they form; null titles give nulls."""

    def one(x):
        if x is None or not x.strip():
            return None, None, None, None
        pieces = {"japanese": [], "latin": [], "korean": []}
        for run in re.findall(r"[가-힣ᄀ-ᇿ][가-힣ᄀ-ᇿ\s]*|[぀-ヿ㐀-鿿々〆ー・]+|[A-Za-zÀ-ỹ][A-Za-zÀ-ỹ'’.\-\s]*", x):
            kind = "korean" if re.match(r"[가-힣ᄀ-ᇿ]", run) else "japanese" if re.match(r"[぀-ヿ㐀-鿿々〆ー・]", run) else "latin"
            if run.strip():
                pieces[kind].append(run.strip())
        got = {k: " ".join(v) or None for k, v in pieces.items()}
        names = [k.upper() for k, v in got.items() if v]
        return got["japanese"], got["latin"], got["korean"], "_AND_".join(names) + ("_NAME" if len(names) == 1 else "_NAMES") if names else "OTHER"

    return pd.DataFrame([one(x) for x in s], columns=["japanese", "latin", "korean", "pattern"])


def matches(entries: dict[str, str]) -> Column:
    """A pandas UDF: longest matches of dictionary keys with their offsets, left to right, without overlaps."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())])))
    def run(s: pd.Series) -> pd.Series:
        trie = Trie(entries)

        def one(x):
            out, at = [], 0
            for piece, said in trie.parts(x or ""):
                if said is not None:
                    out.append({"start": at, "end": at + len(piece), "value": said})
                at += len(piece)
            return out

        return s.map(one)

    return run


def localise(rows: DataFrame, entries: DataFrame, *, key: str, text: str, language: str, most: int = 500_000) -> DataFrame:
    """(key, name, complete): a native name rendered in a language from typed parts (source, target, kind).

    Kinds are place, denomination, word and congregation; the congregation's word stands where the language puts it. A name
    with parts that no entry covers is kept as it is and marked.
    """
    known = entries.limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} dictionary entries")
    sent = rows.sparkSession.sparkContext.broadcast({r["source"]: (r["target"], r["kind"]) for r in known if r["source"]})
    word, before = CONGREGATION[language]

    def run(batches):
        trie = Trie({k: k for k in sent.value})
        for b in batches:
            out = []
            for k, t in zip(b["key"], b["text"]):
                parts = list(trie.parts(re.sub(r"[\s　・]", "", t))) if t else []
                loose = [p for p, said in parts if said is None and p not in "のノ之"]
                if not parts or loose:
                    out.append((k, t, False))
                    continue
                said = [sent.value[p] for p, s in parts if s is not None]
                plain = [x for x, kind in said if kind != "congregation"]
                church = any(kind == "congregation" for _, kind in said)
                joint = "" if language.startswith("zh") else " "
                name = joint.join(plain)
                out.append((k, (joint.join([word, name] if before else [name, word]) if church else name).strip(), True))
            yield pd.DataFrame(out, columns=["key", "name", "complete"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, name string, complete boolean")


def migrate(current: Column, protected: Column, fresh: Column) -> tuple[Column, Column]:
    """(value, outcome) of replacing generated names: protected ones stay, equal ones are unchanged, missing ones are filled.

    Applied twice it changes nothing more.
    """
    outcome = F.when(F.coalesce(protected, F.lit(False)), "protected").when(fresh.isNull(), "no translation").when(current.eqNullSafe(fresh), "unchanged").when(current.isNull(), "added").otherwise("replaced")
    return F.when(outcome.isin("added", "replaced"), fresh).otherwise(current), outcome


# Rewriting of one organisation's names without its country (fixed values).
CATHOLIC = {"en": ("Catholic Church in Japan", "Catholic Church", False), "ko": ("일본 가톨릭", "가톨릭교회", False), "pt": ("Católica no Japão", "Igreja Católica", True), "id": ("Katolik di Jepang", "Gereja Katolik", True)}


def without_country(c: Column, language: str) -> Column:
    """The organisation's country taken out of a congregation's name; other names stay."""
    said, word, before = CATHOLIC[language]
    rest = F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, "^(Igreja|Gereja) ", "") if before else c, F.lit(said), F.lit(" ")), r"\s+", " "))
    rest = F.regexp_replace(rest, " (Church|교회)$", "")
    joined = F.concat_ws(" ", *([F.lit(word), F.nullif(rest, F.lit(""))] if before else [F.nullif(rest, F.lit("")), F.lit(word)]))
    return F.when(F.contains(c, F.lit(said)), joined).otherwise(c)


def english_name(official: Column, listed: Column, latin_part: Column, dictionary: Column, romanised: Column) -> tuple[Column, Column]:
    """(name, evidence) by order of trust: the congregation's own, a directory's, the Latin part of the title, the dictionary, romanisation."""
    from parvis.operators.resolve import cascade

    one = F.lit(1.0)
    value, _, source = cascade([("official", official, one), ("directory", listed, one), ("title", latin_part, one), ("dictionary", dictionary, one), ("romanised", romanised, one)])
    return value, source
