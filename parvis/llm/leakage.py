"""Evaluation passages inside a corpus: pigeonhole pieces, exact hits by an automaton, Myers distance.

An item counts as leaked into a document when a running passage of more than half of the item stands in it with at most
``rate`` character slips. Texts are compared as their letters and digits after NFKC and case folding.

The budget of e slips holds for the passage, of which only its least length h is known, not where in the item it lies; hence the
pieces are cut for twice the slips and hits are counted, rather than e + 1 pieces of the whole item with one hit. A passage of
h = half + 1 characters that carries at most e slips keeps at least (whole pieces - e) of its pieces intact, so
the piece length is set to make that number positive; only documents that reach it are aligned. The alignment is extended
from an intact piece along furthest-reaching diagonals to find how much of the item the passage spans, and the passage is
accepted by its Myers bit-parallel distance. Where that finds nothing, every passage of the least length is measured, so the
short cuts of the alignment lose no passage.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

_OTHER = re.compile(r"[\W_]+")
RATE = 0.08
BLOCK_CHARS = 4_000_000


def fold(text: str | None) -> str:
    """Letters and digits only, NFKC, case folded. Null gives ''."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).casefold()) if text else ""


def pieces(length: int, rate: float = RATE) -> tuple[int, int, int, int]:
    """(half, slips, piece length, hits needed) of an item of that many folded characters."""
    half = length // 2 + 1
    slips = max(1, int(rate * half))
    size = max(3, half // (2 * slips + 1))
    return half, slips, size, max(1, (half - size + 1) // size - slips)


def myers(pattern: str, text: str) -> int:
    """Smallest edit distance of the pattern to any substring of the text (bit-parallel, any pattern length)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = m
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return best


def _common(a: str, i: int, b: str, j: int) -> int:
    """Length of the common prefix of a[i:] and b[j:]."""
    start, n = i, min(len(a) - i, len(b) - j)
    end, step = i + max(0, n), 8
    while i < end:
        k = min(step, end - i)
        if a[i : i + k] == b[j : j + k]:
            i, j, step = i + k, j + k, step * 2
        elif k == 1:
            break
        else:
            end, step = i + k - 1, max(1, k // 2)
    return i - start


def extend(item: str, doc: str, rate: float, price: int = 4, grace: int = 3) -> tuple[int, int]:
    """(item characters, document characters) that match from the front.

    Furthest-reaching diagonals, one slip more each round, while slips stay within grace + rate * reach; of the reaches the
    one with most characters less ``price`` per slip is kept, so that a passage doesn't grow into unlike text.
    """
    front = {0: _common(item, 0, doc, 0)}
    best, e = (front[0], front[0], front[0]), 0
    while True:
        e += 1
        new: dict[int, int] = {}
        for d in range(min(front) - 1, max(front) + 2):  # d = document position - item position
            reach = max(front.get(d, -2), front.get(d + 1, -2)) + 1
            reach = max(reach, front.get(d - 1, -1))
            if 0 <= reach <= len(item) and 0 <= reach + d <= len(doc):
                new[d] = reach + _common(item, reach, doc, reach + d)
        if not new:
            return best[1:]
        d, reach = max(new.items(), key=lambda x: (x[1], -abs(x[0])))
        if e > grace + rate * reach:
            return best[1:]
        if reach - price * e > best[0]:
            best = (reach - price * e, reach, reach + d)
        if reach >= len(item):
            return best[1:]
        front = {k: v for k, v in new.items() if v > reach - 24}


class Index:
    """Automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.rate, self.items, self.rule = rate, {}, {}
        at = defaultdict(list)
        for item_id, text in items:
            folded = fold(text)
            if not folded:
                continue
            half, slips, size, need = rule = pieces(len(folded), rate)
            self.items[item_id], self.rule[item_id] = folded, rule
            for s in range(0, max(1, len(folded) - size + 1), size):
                at[folded[s : s + size]].append((item_id, s))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, passage length, item length, distance) of each leaked item."""
        if not self.items:
            return
        doc = fold(text)
        hits = defaultdict(list)
        for end, (size, where) in self.automaton.iter(doc):
            for item_id, s in where:
                hits[item_id].append((end - size + 1 - s, s))
        for item_id, found in hits.items():
            if len(found) >= self.rule[item_id][3] and (row := self.align(item_id, found, doc)):
                yield (item_id, *row)

    def align(self, item_id: int, found: list[tuple[int, int]], doc: str) -> tuple[int, int, int] | None:
        item, (half, slips, size, need) = self.items[item_id], self.rule[item_id]
        found.sort()
        diagonals = [d for d, _ in found]
        tried, best = -1, None
        for j in range(len(found)):
            k = bisect_right(diagonals, diagonals[j] + 2 * slips)
            if k <= tried or k - j < need or len({s for _, s in found[j:k]}) < need:
                continue
            tried = k
            for d, s in _anchors(found[j:k]):
                right = extend(item[s:], doc[d + s :], self.rate)
                left = extend(item[:s][::-1], doc[max(0, d + s - 2 * len(item)) : d + s][::-1], self.rate)
                span = left[0] + right[0]
                if span <= len(item) // 2 or (best and span <= best[0]):
                    continue
                passage = item[s - left[0] : s + right[0]]
                distance = myers(passage, doc[max(0, d + s - left[1] - slips) : d + s + right[1] + slips])
                if distance <= self.rate * span + 1:
                    best = (span, len(item), distance)
            if best is None:  # the alignment lost its way: every passage of the least length, exactly
                low, high = max(0, diagonals[j] - slips), diagonals[k - 1] + len(item) + slips
                best = shortest_passage(item, doc[low:high], half, int(self.rate * half))
            if best and best[0] == len(item):
                break
        return best


def shortest_passage(item: str, region: str, half: int, slips: int, edge: int = 12) -> tuple[int, int, int] | None:
    """(half, item length, distance) of a passage of ``half`` characters that stands in the region with at most so many slips,
    its first and last ``edge`` characters among them with at most two each; None where there is none.

    All passages are tried: moving one by a character changes its distance by two at most, so those between are skipped
    that can't come down to the slips.
    """
    at = 0
    while at + half <= len(item):
        passage = item[at : at + half]
        distance = myers(passage, region)
        if distance <= slips:
            if myers(passage[:edge], region) <= 2 and myers(passage[-edge:], region) <= 2:
                return half, len(item), distance
            at += 1
        else:
            at += max(1, (distance - slips + 1) // 2)
    return None


def _anchors(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First, middle and last piece of the cluster by place in the item, on the diagonal most of the pieces share."""
    by_place = sorted(found, key=lambda x: x[1])
    return list(dict.fromkeys([by_place[len(by_place) // 2], by_place[0], by_place[-1]]))


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every (document, item) where more than half of the item stands in the document.

    The items are the stated query set. They are set against all documents in blocks of about ``block_chars`` characters, so
    that what is broadcast stays bounded whatever their number. The corpus is scanned once per block, without a shuffle of
    its texts; only the found pairs are grouped. Null or blank texts and null keys give no row; repeated rows give one.

    Columns: doc_id, item_id, passage_chars, item_chars, distance.
    """
    spark = documents.sparkSession
    own = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and length(trim(t)) > 0")
    chars = own.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    corpus = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = None
    for b in range(blocks):
        rows = [(r.i, r.t) for r in own.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toLocalIterator()]
        part = corpus.mapInArrow(_Scan(spark.sparkContext.broadcast(rows), rate, to_arrow_type(items.schema[item_id].dataType)), f"doc_id {kind[0]}, item_id {kind[1]}, passage_chars int, item_chars int, distance int")
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("passage_chars", -F.col("distance"), "item_chars")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.passage_chars", "m.item_chars", (-F.col("m.col2")).alias("distance"))


class _Scan:
    def __init__(self, rows, rate: float, kind: pa.DataType) -> None:
        self.rows, self.rate, self.kind = rows, rate, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Index(self.rows.value, self.rate)
            ids, rows = batch.column(0), []
            for n, text in enumerate(batch.column(1)):
                rows += [(ids[n].as_py(), *row) for row in index.search(text.as_py())]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids.type), pa.array(columns[1], self.kind), *(pa.array(c, pa.int32()) for c in columns[2:])], ["doc_id", "item_id", "passage_chars", "item_chars", "distance"])
