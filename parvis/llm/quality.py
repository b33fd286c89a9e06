"""Text statistics per document and posterior text types (prose, list, table, junk).

The statistics are computed from whole texts, batch-wise with numpy over code points, without a shuffle. Thresholds on them
are noisy labelling functions. Their class-conditional outcome rates are learned by expectation-maximization from how they
agree over all documents: the outcomes are counted per pattern (a map-side combined group-by with at most
``prod(bins)`` groups whatever the corpus size), EM runs on that small table, and the posterior of each pattern is joined
back to the documents.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parvis.session import cut

TYPES = ("prose", "list", "table", "junk")

# Character classes.
SPACE, BREAK, DIGIT, LATIN, HIRA, KATA, HAN, HANGUL, END, COMMA, CELL, OTHER, LETTER = range(13)

# Frequent function words and characters per language (fixed values).
WORDS = """
a an and are as at be but by did do for from had has have he her him his how i if in is it its me my no nor not now of off
on or our out she so than that the then they this to too up us was we were what when who whom why with you your which into
o os um uma uns de do da dos das em no na nos nas por para com que se não é e ou ao aos à às sua seu mais foi são como este esta
yang dan di ke dari ini itu para akan oleh pada kami kita ada juga atau saat hari bagi dia saya para lalu orang
và của các cho một đã là có với này đó khi để trong ra vào ở như không được những tôi sẽ lúc từ về thì mà vì sao lại tới sự
"""
HAN_WORDS = "的了在是和我不一人有這这們们為为與与著着都也很說说對对上下來来到個个已經经就讓让從从把被他她你是所以於于中小大裡里年次成主天行直"
HANGUL_WORDS = "은는이가을를에의로고다서도와과며한지"
BULLETS = "・*●-○■□◆◇▪•‣–—>§①②③④⑤⑥⑦⑧⑨⑩"


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, function-character mark and bullet mark of each code point of the first plane; the rest is OTHER."""
    table = np.full(0x10000, OTHER, np.uint8)
    for cp in range(0x10000):
        if not 0xD800 <= cp <= 0xDFFF and (chr(cp).isalpha() or 0x900 <= cp < 0xFE00 and unicodedata.category(chr(cp))[0] == "M"):
            table[cp] = LETTER  # with the vowel signs of scripts that write them as marks
    for low, high, kind in ((0x41, 0x5A, LATIN), (0x61, 0x7A, LATIN), (0xC0, 0x24F, LATIN), (0x1E00, 0x1EFF, LATIN), (0xFF21, 0xFF3A, LATIN), (0xFF41, 0xFF5A, LATIN), (0x30, 0x39, DIGIT), (0xFF10, 0xFF19, DIGIT), (0x3041, 0x309F, HIRA), (0x30A1, 0x30FA, KATA), (0x30FC, 0x30FF, KATA), (0xFF66, 0xFF9F, KATA), (0x3400, 0x4DBF, HAN), (0x4E00, 0x9FFF, HAN), (0xF900, 0xFAFF, HAN), (0xAC00, 0xD7AF, HANGUL), (0x1100, 0x11FF, HANGUL), (0x3130, 0x318F, HANGUL)):
        table[low : high + 1] = kind
    table[0xD7], table[0xF7] = OTHER, OTHER
    for kind, chars in ((SPACE, "  　​‌‍﻿­    "), (BREAK, "\n\r  \x0b\x0c\x85"), (END, ".。．!！?？…｡"), (COMMA, ",、，;；:："), (CELL, "|\t│{}[]\"=")):
        for ch in chars:
            table[ord(ch)] = kind
    mark, bullet = np.zeros(0x10000, bool), np.zeros(0x10000, bool)
    mark[[ord(x) for x in HAN_WORDS + HANGUL_WORDS]] = True
    bullet[[ord(x) for x in BULLETS]] = True
    return table, mark, bullet


@lru_cache(maxsize=1)
def _word_codes() -> np.ndarray:
    """Rolling hashes of the common words, of any length."""
    return np.unique(np.array([_code(w) for w in WORDS.split()], np.int64))


_BASE = 1_000_003


def _code(word: str) -> int:
    """Polynomial hash modulo 2^64 of the letters, as a signed number; the length is part of it by the leading one."""
    h = 1
    for ch in word:
        h = (h * _BASE + ord(ch)) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >= 1 << 63 else h


@lru_cache(maxsize=1)
def _longest_word() -> int:
    return max(map(len, WORDS.split()))


FIELDS = ("n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "n_lines", "end_ratio", "common_ratio", "prose_ratio", "bullet_ratio", "cell_ratio", "short_ratio", "repeat_ratio", "squeeze_ratio", "letter_ratio", "number_ratio", "wild_ratio")


def statistics(texts: list[str | None], at_once: int = 400_000) -> dict[str, np.ndarray]:
    """The statistics of FIELDS, one value per text, worked out in runs of texts of about ``at_once`` characters."""
    runs, size = [[]], 0
    for x in texts:
        if size > at_once:
            runs.append([])
            size = 0
        runs[-1].append(x)
        size += len(x or "") + 1
    done = [_statistics(x) for x in runs]
    return {k: np.concatenate([x[k] for x in done]) for k in FIELDS}


def _statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    n = len(texts)
    texts = [x or "" for x in texts]
    sizes = np.fromiter((len(x) for x in texts), np.int64, n)
    cp = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    table, mark, bullet = _classes()
    low = np.where(cp < 0x10000, cp, 0xFFFF).astype(np.int64)
    kind = table[low]
    start = np.concatenate([[0], np.cumsum(sizes + 1)])  # of each text; each ends with a break of ours
    # lines
    stop = np.flatnonzero(kind == BREAK)
    first = np.concatenate([[0], stop[:-1] + 1])
    owner = np.searchsorted(start, first, side="right") - 1
    at = np.minimum(first, len(cp) - 1)

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[stop] - total[first]

    ink = (kind != SPACE) & (kind != BREAK) & (low != 9)
    count = {k: per_line(kind == k) for k in (DIGIT, LATIN, HIRA, KATA, HAN, HANGUL, LETTER, END, CELL, OTHER, COMMA)}
    chars, marks = per_line(ink), per_line(mark[low])
    # words: runs of letters of scripts that are written with spaces
    alpha = (kind == LATIN) | (kind == LETTER) | (kind == HANGUL)
    edge = np.diff(np.concatenate([[0], alpha.view(np.int8), [0]]))
    w0, w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = w1 - w0
    short = np.flatnonzero(length <= _longest_word())
    code = np.ones(len(short), np.int64)
    lower = _lower()[low]
    with np.errstate(over="ignore"):
        for i in range(_longest_word()):
            use = np.flatnonzero(length[short] > i)
            code[use] = code[use] * _BASE + lower[w0[short[use]] + i]
    common = np.zeros(len(cp), bool)
    common[w0[short[np.isin(code, _word_codes())]]] = True
    begins = np.zeros(len(cp), bool)
    begins[w0] = True
    digit = kind == DIGIT
    runs = digit & ~np.concatenate([[False], digit[:-1]])
    words, commons, numbers = per_line(begins), per_line(common), per_line(runs)
    # a vowel-less or switching word is no word of a language: random letters, base64
    vowel = np.isin(lower, [ord(x) for x in "aeiouyàáâãäåæèéêëìíîïòóôõöùúûüýăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"])
    long_word = length >= 4
    total_vowel = np.concatenate([[0], np.cumsum(vowel, dtype=np.int64)])
    share = (total_vowel[w1] - total_vowel[w0]) / np.maximum(1, length)
    wild = np.zeros(len(cp), bool)
    latin_word = kind[np.minimum(w0, len(cp) - 1)] == LATIN
    wild[w0[latin_word & ((long_word & ((share < 0.2) | (share > 0.8))) | (length > 16))]] = True
    lengthy = np.zeros(len(cp), bool)
    lengthy[w0[latin_word & long_word]] = True
    wilds, lengthies = per_line(wild), per_line(lengthy)
    # the last and first ink of a line
    position = np.where(ink, np.arange(len(cp)), -1)
    last = np.maximum.accumulate(position)[np.maximum(stop - 1, 0)]
    last_kind = np.where(last >= first, kind[np.maximum(last, 0)], SPACE)
    closing = np.isin(cp[np.maximum(last, 0)], [ord(x) for x in "」』”\"’)）»"])
    ends = (last_kind == END) | (closing & (last >= first))
    following = np.where(ink, np.arange(len(cp)), len(cp))
    head = np.minimum.accumulate(following[::-1])[::-1][at]
    head = np.minimum(head, len(cp) - 1)
    starts_bullet = (bullet[low[head]] | ((kind[head] == DIGIT))) & (head < stop)
    # prose evidence
    letters = count[LATIN] + count[HIRA] + count[KATA] + count[HAN] + count[HANGUL] + count[LETTER]
    safe = np.maximum(1, chars)
    kana = count[HIRA] + count[KATA]
    cjk = kana + count[HAN]
    few_digits = count[DIGIT] / safe < 0.12
    tabular = (count[CELL] / safe > 0.05) | (count[CELL] + (count[COMMA] > 0) * count[COMMA] >= np.maximum(2, 0.12 * safe))
    ja = (count[HIRA] / np.maximum(1, cjk) >= 0.30) & (cjk >= 8) & (cjk >= 0.5 * letters)
    zh = (kana == 0) & (count[HAN] >= 6) & (marks / np.maximum(1, count[HAN]) >= 0.06) & (count[HAN] >= 0.5 * letters)
    ko = (count[HANGUL] >= 6) & (marks / np.maximum(1, count[HANGUL]) >= 0.10) & (count[HANGUL] >= 0.5 * letters)
    length_mean = letters / np.maximum(1, words)
    rate, counted = commons / np.maximum(1, words), numbers / np.maximum(1, words)
    plain = (words >= 4) & (numbers == 0) & ~starts_bullet & (length_mean >= 2) & (length_mean <= 9)
    latin = (((words >= 3) & (rate >= 0.12) & (counted <= 0.2)) | ((words >= 8) & (rate >= 0.04) & (counted <= 0.13)) | plain) & (wilds < 0.25 * np.maximum(1, lengthies)) & (count[LATIN] >= 0.5 * letters)
    # other scripts: no word list speaks for them, so running lines of words without figures do
    spoken = (count[LETTER] >= 0.5 * letters) & (((words >= 3) & (length_mean >= 2) & (length_mean <= 12) & (counted <= 0.2)) | ((words < 3) & (count[LETTER] >= 12))) & ~starts_bullet
    tail_number = (last_kind == DIGIT) & (chars < 80)
    prose = (ja | zh | ko | latin | spoken) & few_digits & ~tabular & ~tail_number & (letters / safe >= 0.6)
    # repeated lines, by two sums over their characters
    line_of = np.repeat(np.arange(len(stop)), stop - first + 1)
    place = np.arange(len(cp)) - first[line_of]
    key = np.stack([owner, per_line(np.where(ink, low * (low % 8191 + 1), 0)), per_line(np.where(ink, low * (place % 8191 + 1), 0)), chars], 1)
    order = np.lexsort(key.T)
    same = np.concatenate([[False], (key[order][1:] == key[order][:-1]).all(1)])
    again = np.zeros(len(stop), bool)
    again[order] = same
    again &= chars > 0

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, minlength=n)[:n]

    size = per_text(chars)
    inked, lines = np.maximum(1, size), np.maximum(1, per_text(chars > 0))
    n_words = per_text(words) + (per_text(count[HAN] + count[HIRA] + count[KATA])) // 2
    packed = np.fromiter((_squeeze(x) for x in texts), float, n)
    return {
        "n_chars": sizes, "n_words": n_words.astype(np.int64), "mean_word_length": per_text(letters) / np.maximum(1, n_words), "symbol_ratio": per_text(count[OTHER] + count[CELL]) / inked,
        "digit_ratio": per_text(count[DIGIT]) / inked, "n_lines": per_text(chars > 0).astype(np.int64), "end_ratio": per_text(ends & (chars > 0)) / lines, "common_ratio": (per_text(commons) + per_text(marks)) / np.maximum(1, n_words),
        "prose_ratio": per_text(chars * prose) / inked, "bullet_ratio": per_text(chars * starts_bullet) / inked, "cell_ratio": per_text(chars * tabular) / inked, "short_ratio": per_text(chars * (chars < 24)) / inked,
        "repeat_ratio": per_text(chars * again) / inked, "squeeze_ratio": packed, "letter_ratio": per_text(letters) / inked, "number_ratio": per_text(numbers) / np.maximum(1, n_words), "wild_ratio": per_text(wilds) / np.maximum(1, per_text(lengthies)),
    }


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    out = np.arange(0x10000, dtype=np.int64)
    for cp in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        if len(x := chr(cp).lower()) == 1:
            out[cp] = ord(x)
    for cp in range(0xFF01, 0xFF5F):  # full width
        out[cp] = out[cp - 0xFEE0]
    return out


def _squeeze(text: str) -> float:
    raw = text.encode("utf-8", "surrogatepass")
    return len(zlib.compress(raw, 1)) / len(raw) if len(raw) > 200 else 1.0


_KINDS = {k: "bigint" if k in ("n_chars", "n_words", "n_lines") else "double" for k in FIELDS}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = statistics(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[k]) for k in FIELDS)], ["doc_id", *FIELDS])


def text_statistics(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and the statistics of FIELDS. Null and blank texts have n_chars as they are and zeros elsewhere; repeated rows stay."""
    kind = documents.schema[doc_id].dataType.simpleString()
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_scan, f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in _KINDS.items()))


def _net() -> Column:
    """Prose without what is said over and over."""
    return F.col("prose_ratio") * (1 - F.col("repeat_ratio")) * F.when(F.col("squeeze_ratio") < SQUEEZED, 0.0).otherwise(1.0)


SQUEEZED = 0.085

def labelling_functions() -> list[tuple[str, list[Column], list[tuple[float, float, float, float]]]]:
    """(name, conditions tried in order with the rest as last outcome, how much each outcome speaks for each of TYPES at the start)."""
    net = _net()
    c = F.col
    return [
        ("prose", [net >= 0.5, net >= 0.3], [(97, 1, 1, 1), (5, 45, 45, 45), (1, 95, 95, 95)]),
        ("repeat", [(c("squeeze_ratio") < SQUEEZED) | (c("repeat_ratio") > 0.5)], [(0.2, 1, 1, 40), (99, 99, 99, 60)]),
        ("cells", [c("cell_ratio") >= 0.5], [(1, 5, 85, 30), (99, 95, 15, 70)]),
        ("bullets", [(c("bullet_ratio") >= 0.5) & (c("cell_ratio") < 0.5)], [(2, 45, 10, 10), (98, 55, 90, 90)]),
        ("short", [(c("short_ratio") >= 0.6) & (c("n_lines") >= 4)], [(3, 70, 30, 15), (97, 30, 70, 85)]),
        ("digits", [c("digit_ratio") >= 0.1], [(2, 60, 80, 20), (98, 40, 20, 80)]),
        ("letters", [c("letter_ratio") < 0.5], [(1, 5, 50, 60), (99, 95, 50, 40)]),
        ("wild", [c("wild_ratio") >= 0.3], [(1, 3, 3, 50), (99, 97, 97, 50)]),
        ("blank", [(c("letter_ratio") == 0)], [(0.01, 0.1, 0.5, 10), (99.9, 99, 99, 90)]),
    ]


def votes(stats: DataFrame) -> DataFrame:
    """Adds ``pattern``: the outcome of every labelling function as one number, mixed radix."""
    number = F.lit(0)
    for _, conditions, _ in labelling_functions():
        outcome = F.lit(len(conditions))
        for i in range(len(conditions) - 1, -1, -1):
            outcome = F.when(conditions[i], i).otherwise(outcome)
        number = number * (len(conditions) + 1) + outcome
    return stats.withColumn("pattern", number)


def fit(counts: dict[int, int], rounds: int = 60, trust: float = 0.3) -> dict[int, np.ndarray]:
    """Posterior over TYPES of each pattern, by expectation-maximization.

    Each function has an outcome rate per type, learned from the documents; the starting rates stay in with the weight of a
    share ``trust`` of the documents, so the result doesn't depend on how many there are.
    """
    functions = labelling_functions()
    sizes = [len(f[1]) + 1 for f in functions]
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[int(p)] for p in patterns], float)
    outcomes, rest = [], patterns.copy()
    for k in reversed(sizes):
        outcomes.insert(0, rest % k)
        rest //= k
    prior = [np.array(f[2], float).T for f in functions]
    prior = [x / x.sum(1, keepdims=True) for x in prior]
    rates, share = prior, np.array([0.7, 0.1, 0.1, 0.1])
    total = max(1.0, weight.sum())
    for _ in range(rounds):
        log = np.log(share) + sum(np.log(r[:, o].T + 1e-9) for r, o in zip(rates, outcomes))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * weight[:, None]
        rates = []
        for p, o, k in zip(prior, outcomes, sizes):
            seen = np.stack([np.bincount(o, mass[:, t], minlength=k) for t in range(len(TYPES))])
            belief = trust * np.maximum(seen.sum(1, keepdims=True), 0.01 * total)
            r = seen + belief * p
            rates.append(r / r.sum(1, keepdims=True))
        share = (mass.sum(0) + 0.01 * total) / (total * 1.04)
    return {int(p): x for p, x in zip(patterns, post)}


def text_types(stats: DataFrame, keep: tuple[str, ...] = FIELDS) -> DataFrame:
    """Adds text_type and the posterior of each of TYPES (p_prose, ...) to doc_id and the statistics in ``keep``.

    The texts are read once: the outcomes are checkpointed before they are counted.

    Only the counts per pattern reach the driver; there are at most prod(outcomes) = 768 patterns. An empty table gives an
    empty result.
    """
    spark = stats.sparkSession
    voted = cut(votes(stats).drop(*[f for f in FIELDS if f not in keep]))
    counts = {r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    post = fit(counts)
    rows = [(p, TYPES[int(x.argmax())], *(float(v) for v in x)) for p, x in post.items()]
    table = spark.createDataFrame(rows, "pattern int, text_type string, " + ", ".join(f"p_{t} double" for t in TYPES))
    return voted.join(F.broadcast(table), "pattern").drop("pattern")
