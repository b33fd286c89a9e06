"""Main text of web pages: flat text blocks, word counts and link densities of a block and its neighbours, a decision tree.

The text has no markup left, so what sites link with is learned from the corpus itself: phrases (lines, or the pieces between
separators, with figures folded) that stand on many sites, and lines that stand on a good part of one site's pages. The link
density of a line is the share of its characters in such phrases. Each non-blank line is a block; its features are word count,
link density, recurrence and shape of the line and of its neighbours and its place on the page, and none of them knows a word.
The tree is fitted on a small labelled table: pages that ``labelled_sites`` composes from random syllables, a bounded number
given as a parameter.

Two combinable aggregations gather the recurrence. Phrases on at least LEAST_SHARE of the sites are at most mean distinct
phrases of a site / LEAST_SHARE, whatever the size of the corpus, and are sent to all tasks; the lines a site repeats on
LEAST_REPEAT of its pages are at most its mean lines a page / LEAST_REPEAT and are joined to its pages.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from parvis.llm.tree import Tree
from parvis.session import cut

LEAST_SHARE, LEAST_REPEAT = 0.002, 0.3
#: A phrase that prose follows this often is a heading rather than a link.
OPENS = 0.4
#: ... unless it stands on more than this share of the further pages of its sites.
STEADY = 0.6

_SPLIT = re.compile(r"\s*[|｜/／>＞»›·•]\s*|　+|\s{2,}")
_LEAD = re.compile(r"^[\s・\-*■□●○>＞◆▶►•–—]+")
_DIGITS = re.compile(r"\d+")
_TIME = re.compile(r"\d{1,2}[:：]\d{2}")
_OWNER = re.compile(r"©|\(c\)|copyright|\b(tel|fax)\b", re.I)  # marks of the publisher that hold in any language
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")

FEATURES = (
    "words", "density", "common", "opens", "steady", "repeats", "final", "cut", "sentences", "time", "digits", "pieces", "owner", "titled", "bullet", "comma",
    "words_before", "density_before", "repeats_before", "final_before", "cut_before", "words_after", "density_after", "repeats_after", "final_after", "cut_after",
    "place", "prose_before", "prose_after", "since_prose", "shut_before", "shut_after", "side_before", "headed",
)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


_MARKS = frozenset("・-*■□●○>＞◆▶►•–— \t")
_ENDS = frozenset("。．.!?！？」』”\")）〜~")


def _fold(text: str) -> int:
    return _hash(_DIGITS.sub("0", text).casefold().strip(" ☰"))


@lru_cache(maxsize=1 << 17)
def _own(line: str) -> tuple:
    """What a stripped line is by itself: (key, keys of its pieces and their lengths, words, shape features, is it prose, bare)."""
    bare = (_LEAD.sub("", line) or line) if line[0] in _MARKS else line
    size, spaces = len(line), line.count(" ")
    wide = not line.isascii() and spaces * 14 < size + 10 and bool(_CJK.search(line))  # a script without spaces between words
    words = size / 2 if wide else spaces + 1
    sentences = line.count("。") + line.count("！") + line.count("？") if wide else 0
    if not wide or not sentences:
        sentences += line.count(". ") + line.count("? ") + line.count("! ") + line.endswith((".", "?", "!", '."', '?"', '!"'))
    final = line[-1] in _ENDS
    timed = ":" in line or "：" in line
    if final and sentences and words >= 20:  # running prose has no pieces
        pieces = [bare]
    else:
        pieces = [p for p in _SPLIT.split(bare) if p]
        if len(pieces) == 1 and wide and " " in bare and not sentences and not timed:
            pieces = bare.split()
    digits = sum(map(line.count, "0123456789")) if size < 160 else 0
    key = _fold(bare)
    keys = ((key, len(bare)),) if len(pieces) == 1 else tuple((_fold(p), len(p)) for p in pieces)
    shape = (final, line.endswith(("…", "...", "‥")), min(sentences, 4), timed and bool(_TIME.search(line)), digits / size, min(len(pieces), 6), size < 160 and bool(_OWNER.search(line)), bare is not line, "、" in line or "," in line)
    return key, keys, min(words, 40), shape, final and sentences > 0 and words >= 6, bare


def lines_of(content: str | None) -> list[tuple[int, str]]:
    """The non-blank lines with their numbers from 0. Null and blank content have none."""
    return [(n, s) for n, x in enumerate((content or "").split("\n")) if (s := x.strip(" \t\r　\xa0﻿"))]


def phrases(content: str | None) -> dict[int, bool]:
    """Keys of the page's lines and their pieces, and whether prose follows the line; 0 stands for the page itself."""
    own = [_own(s) for _, s in lines_of(content)]
    out: dict[int, bool] = {0: False}
    for i, (whole, pieces, words, _, prose, _) in enumerate(own):
        if prose and len(pieces) == 1 and words >= 20:
            out[whole] = False
            continue
        follows = len(pieces) == 1 and i + 1 < len(own) and own[i + 1][4]
        if follows or whole not in out:
            out[whole] = follows
        if len(pieces) > 1:
            for k, _ in pieces:
                out.setdefault(k, False)
    return out


class Known:
    """Phrases of many sites: how often prose follows them, and the share of the pages of their sites they stand on."""

    def __init__(self, rows: list[tuple[int, float, float]]) -> None:
        self.of = {k: (opens, steady) for k, opens, steady in rows}


def _plain(text: str) -> str:
    return text.rstrip("0123456789 　").strip()


def features(contents: list[str | None], titles: list[str | None], known: Known, repeated: list) -> tuple[list[list[int]], np.ndarray]:
    """Line numbers of each page and one row of FEATURES per non-blank line of all pages, in their order."""
    numbers, rows, sizes, prose = [], [], [], []
    of = known.of
    for content, title, again in zip(contents, titles, repeated):
        blocks = lines_of(content)
        numbers.append([n for n, _ in blocks])
        sizes.append(len(blocks))
        again = frozenset(again or ())
        name = _plain(title or "")
        for _, s in blocks:
            whole, pieces, words, shape, is_prose, bare = _own(s)
            hit, repeats = of.get(whole), whole in again
            opens, steady = hit or (0.0, 0.0)
            if len(pieces) == 1:
                density = float(repeats or hit is not None and (opens < OPENS or steady > STEADY))
            else:
                linked = total = 0
                for k, size in pieces:
                    total += size
                    found = of.get(k)
                    if k in again or found and (found[0] < OPENS or found[1] > STEADY):
                        linked += size
                density = linked / total if total else 0.0
            titled = bool(name) and name in bare and len(bare) < 200 and _plain(_SPLIT.split(bare)[-1]) == name
            rows.append((words, density, hit is not None, opens >= OPENS and steady <= STEADY, round(steady, 1), repeats, *shape[:7], titled, *shape[7:]))
            prose.append(is_prose and density < 0.5 and not repeats)
    if not rows:
        return numbers, np.zeros((0, len(FEATURES)))
    base, prose, sizes = np.array(rows, float), np.array(prose), np.array(sizes)
    n = len(base)
    at = np.arange(n)
    page = np.repeat(np.arange(len(sizes)), sizes)
    start = np.concatenate([[0], np.cumsum(sizes)])
    first, end = start[page], start[page + 1]
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[at == first], after[at == end - 1] = 0, 0

    def so_far(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many flags the page has before and after each line."""
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[at] - total[first], total[end] - total[at + 1]

    def latest(flags: np.ndarray) -> np.ndarray:
        """The last flagged line of the page up to each line, or -1."""
        found = np.maximum.accumulate(np.where(flags, at, -1))
        return np.where(found >= first, found, -1)

    seen, left = so_far(prose)
    last = latest(prose)
    since = np.where(last >= 0, np.minimum(at - last, 50), 50)
    dense = (base[:, 1] >= 0.5) | (base[:, 5] > 0)  # links or lines the site repeats
    shut, rest = so_far(dense)
    # a list of teasers: below a short line of links or a cut line, without prose of several sentences since
    opened = latest((dense & (base[:, 0] < 12)) | (base[:, 7] > 0))
    in_side = np.where(opened > latest(prose & (base[:, 8] >= 2)), np.minimum(at - opened, 9), 0)
    side = [0, 1, 5, 6, 7]
    place = np.round((at - first) / sizes[page], 1)
    return numbers, np.column_stack([base, before[:, side], after[:, side], place, np.minimum(seen, 5), np.minimum(left, 5), since, np.minimum(shut, 20), np.minimum(rest, 20), in_side, before[:, 13]])


def _gather(count: dict, site, content: str) -> None:
    """Adds a page to (site, phrase): rows, rows where prose follows, bit set of the different contents."""
    bit = 1 << (_hash(content or "") & 63)
    for k, follows in phrases(content).items():
        c = count.setdefault((site, k), [0, 0, 0])
        c[0] += 1
        c[1] += follows
        c[2] |= bit


#: Sites of at most so many rows count their different contents by a bit set, so that a page fetched again isn't two.
FEW = 32


def _pages(c: list[int], site: list[int]) -> int:
    return c[2].bit_count() if site[0] <= FEW else c[0]


def _recurring(pages: list[tuple[str, str]]) -> tuple[Known, dict[str, set[int]]]:
    """The recurrence tables of a small corpus of (site, content), as ``recurrence`` works them out for a large one."""
    count: dict[tuple[str, int], list[int]] = {}
    for site, content in pages:
        _gather(count, site, content)
    total = {s: _pages(c, c) for (s, k), c in count.items() if k == 0}
    sites, n, opens, more, held = Counter(), Counter(), Counter(), Counter(), Counter()
    repeated: dict[str, set[int]] = {}
    for (s, k), c in count.items():
        if k:
            own = _pages(c, count[s, 0])
            sites[k] += 1
            n[k] += c[0]
            opens[k] += c[1]
            more[k] += own - 1
            held[k] += total[s] - 1
            if own >= 2 and own >= LEAST_REPEAT * total[s]:
                repeated.setdefault(s, set()).add(k)
    least = max(3, LEAST_SHARE * len(total))
    return Known([(k, opens[k] / n[k], more[k] / max(1, held[k])) for k, h in sites.items() if h >= least]), repeated


def recurrence(pages: DataFrame) -> tuple[list[tuple[int, float, float]], DataFrame]:
    """(phrases of many sites, (site, repeated: what the site repeats)) of pages with page_id, site, content."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[tuple[int, int], list[int]] = {}
            for site, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _gather(met, site, content)
            if met:
                keys, values = np.array(list(met), np.int64), np.array(list(met.values()), np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys.T, *values.T)], ["site", "k", "n", "opens", "bits"])

    met = pages.select("site", "content").mapInArrow(scan, "site bigint, k bigint, n bigint, opens bigint, bits bigint")
    met = cut(met.groupBy("site", "k").agg(F.sum("n").alias("n"), F.sum("opens").alias("opens"), F.bit_or("bits").alias("bits")))
    totals = cut(met.where("k = 0").select("site", F.col("n").alias("rows"), F.when(F.col("n") <= FEW, F.bit_count("bits")).otherwise(F.col("n")).alias("pages")))
    sites = totals.count()
    least = max(3, LEAST_SHARE * sites)
    held = met.where("k != 0").join(totals, "site").withColumn("own", F.when(F.col("rows") <= FEW, F.bit_count("bits")).otherwise(F.col("n")))
    wide = held.groupBy("k").agg(F.count("*").alias("sites"), (F.sum("opens") / F.sum("n")).alias("opens"), (F.sum(F.col("own") - 1) / F.greatest(F.sum(F.col("pages") - 1), F.lit(1))).alias("steady")).where(F.col("sites") >= least)
    known = [(r.k, r.opens, r.steady) for r in wide.collect()]  # at most mean phrases of a site / LEAST_SHARE rows
    repeated = held.where("own >= 2").where(F.col("own") >= LEAST_REPEAT * F.col("pages")).groupBy("site").agg(F.collect_set("k").alias("repeated"))
    return known, repeated


def _word(pick: random.Random, cjk: bool) -> str:
    if cjk:
        return "".join(chr(pick.choice([pick.randint(0x4E00, 0x6FFF), pick.randint(0x3042, 0x3093)])) for _ in range(pick.randint(1, 3)))
    return "".join(pick.choice("bdfgklmnprstvz") + pick.choice("aeiou") for _ in range(pick.randint(1, 3))) + pick.choice(["", "n", "s", "r"])


class _Pool:
    """Random phrases of one language that the sites of a composed corpus share."""

    def __init__(self, pick: random.Random, cjk: bool) -> None:
        self.pick, self.cjk, self.joint = pick, cjk, "" if cjk else " "
        some = lambda few, many, low, high: [self.phrase(low, high) for _ in range(pick.randint(few, many))]
        self.menu, self.foot, self.sides, self.heads, self.meetings, self.errors, self.buttons = some(14, 30, 1, 3), some(7, 15, 1, 3), some(3, 9, 1, 3), some(4, 14, 1, 3), some(4, 9, 1, 3), some(1, 3, 2, 4), some(1, 4, 1, 2)
        self.closings = [self.phrase(1, 2), f"（{self.phrase(1, 1)}）", self.phrase(1, 3)]
        self.notices = [self.sentence(8, 14) + self.joint + self.sentence(4, 8) for _ in range(5)]
        self.openings, self.invitations = [self.phrase(4, 7) for _ in range(3)], [self.sentence(4, 7) for _ in range(3)]
        self.stock = [self.sentence(7, 16) for _ in range(60)]  # sentences that several writers use

    def phrase(self, low: int, high: int) -> str:
        words = [_word(self.pick, self.cjk) for _ in range(self.pick.randint(low, high))]
        return self.joint.join(words) if self.cjk else self.joint.join(words).capitalize()

    def sentence(self, low: int = 7, high: int = 18) -> str:
        words = [_word(self.pick, self.cjk) for _ in range(self.pick.randint(low, high))]
        if self.pick.random() < 0.5:
            words[len(words) // 2] += "、" if self.cjk else ","
        quoted = self.pick.random() < 0.08
        text = self.joint.join(words)
        text = text if self.cjk else text.capitalize()
        end = self.pick.choice("。。。？" if self.cjk else "...?")
        return f"「{text}」{_word(self.pick, True)}{end}" if quoted and self.cjk else f'"{text}," {_word(self.pick, False)}.' if quoted else text + end


def labelled_sites(pages: int = 6000, seed: int = 7) -> list[tuple[str, str, str, list[bool]]]:
    """The small labelled table: (site, title, content, is the line body), of about ``pages`` pages on a sixth as many sites."""
    pick = random.Random(seed)
    pools = [_Pool(pick, k % 3 < 2) for k in range(9)]
    out: list[tuple[str, str, str, list[bool]]] = []
    while len(out) < pages:
        p = pick.choice(pools)
        name, site = p.phrase(2, 4), f"s{len(out)}"
        menu, style, mark = pick.sample(p.menu, pick.randint(2, 12)), pick.random(), pick.random()
        if pick.random() < 0.6:  # most sites keep one order, and many end with the same entry
            menu = [m for m in p.menu[:-1] if m in menu] + [p.menu[-1]] * (pick.random() < 0.6)
        menu = menu or [p.menu[0]]
        notice, button, notice_first = pick.choice(p.notices), pick.choice(p.buttons), pick.random() < 0.5
        standing = pick.choice([name + pick.choice(p.openings) + ("。" if p.cjk else ". "), ""]) + p.joint + p.sentence() + p.joint + pick.choice(p.invitations)
        owner = pick.choice([f"© {pick.randint(2005, 2025)} {name}", f"Copyright(C) {name}. {p.foot[0]}.", f"{name} TEL 0{pick.randint(10, 99)}-555-{pick.randint(1000, 9999)}", f"(c){pick.randint(2005, 2025)} {_word(pick, False)}.example", name])
        has = {k: pick.random() < s for k, s in (("name", 0.75), ("notice", 0.55), ("crumb", 0.5), ("standing", 0.35), ("owner", 0.75), ("shuffle", 0.2), ("first", 0.45), ("side", 0.75), ("button", 0.5))}
        fresh = [p.sentence() for _ in range(60)]
        for _ in range(pick.choice([1, 2, 3, 5, 8, 12])):
            out.append(_page(pick, p, site, name, menu, style, mark, notice, button, notice_first, standing, owner, has, fresh))
    return out


def _page(pick, p, site, name, menu, style, mark, notice, button, notice_first, standing, owner, has, fresh) -> tuple[str, str, str, list[bool]]:
    title = pick.choice(p.heads) + (f" {pick.randint(2, 400)}" if pick.random() < 0.4 else "")
    lines: list[tuple[str, bool]] = []
    told = ([notice] if has["notice"] and pick.random() < 0.9 else []) + ([button] if has["button"] else [])
    shown = menu if pick.random() < 0.6 else [m for m in menu if pick.random() < 0.7] or menu[-1:]
    if style < 0.45:
        top = [(pick.choice(["- ", "・ ", "■ ", "> ", "* "]) if mark < 0.5 else "") + m for m in shown]
    elif style < 0.85:
        top = [pick.choice([" | ", " / ", "　", "｜", " » "]).join(shown)]
    else:
        half = max(1, len(shown) // 2)
        top = [x for x in (" ".join(shown[:half]), " ".join(shown[half:])) if x]
    crumb = pick.choice([" > ", " / ", " » "]).join([pick.choice(p.menu), pick.choice(p.menu), title])
    front = [told * notice_first, [name] * has["name"], top, [crumb] * has["crumb"]]
    if has["shuffle"]:
        pick.shuffle(front)
    lines += [(x, False) for part in front for x in part if x]
    side: list[tuple[str, bool]] = []
    if has["side"]:
        side.append((pick.choice(p.sides), False))
        for _ in range(pick.randint(1, 7)):
            s = pick.choice(p.stock if pick.random() < 0.3 else fresh)
            at, kind = max(5, int(len(s) * pick.uniform(0.3, 0.95))), pick.random()
            archive = f"{pick.randint(2015, 2026)}年{pick.randint(1, 12)}月 ({pick.randint(1, 30)})" if p.cjk else f"{pick.randint(1, 12):02d}/{pick.randint(2015, 2026)} ({pick.randint(1, 30)})"
            side.append((archive if kind < 0.5 else s[:at] + "…" if kind < 0.72 else s + "…" if kind < 0.75 else s if kind < 0.79 else s[:at], False))
    start, empty = len(lines), pick.random()
    if empty < 0.06:
        lines += [(pick.choice(p.errors), False)]
    elif empty < 0.95:
        if pick.random() < 0.6:
            lines.append((title, True))
        for _ in range(pick.randint(1, 9)):
            kind = pick.random()
            if kind < 0.6:
                lines.append((p.joint.join(pick.choice(p.stock if pick.random() < 0.12 else fresh) for _ in range(pick.choice([1, 1, 2, 3, 4, 6]))), True))
            elif kind < 0.78:
                lines += [(f"{pick.choice(['', '・', '○', '- '])}{pick.choice(p.meetings)} {pick.randint(6, 20)}:{pick.choice(['00', '15', '30', '45'])}{'〜' if p.cjk else ''}", True) for _ in range(pick.randint(1, 5))]
            else:
                lines.append((pick.choice(p.heads), True))
        if pick.random() < 0.3:
            lines.append((pick.choice(p.closings), True))
    at = start if has["first"] and pick.random() < 0.6 else pick.randint(start, len(lines)) if has["first"] else len(lines)
    lines[at:at] = side
    back = [[x] for x in pick.sample(p.foot, pick.randint(0, min(7, len(p.foot))))]
    if pick.random() < 0.3:
        back.append([pick.choice(["　", "  ", " | "]).join(pick.sample(p.foot, 3))])
    back += [[owner] * has["owner"], [standing] * has["standing"], told * (not notice_first)]
    if has["shuffle"] or pick.random() < 0.3:
        pick.shuffle(back)
    lines += [(x, False) for part in back for x in part]
    if pick.random() < 0.3:  # blank lines between blocks
        lines = [y for x in lines for y in (x, *([("", False)] if pick.random() < 0.15 else []))]
    return site, title, "\n".join(s for s, _ in lines), [b for _, b in lines]


def table_of(pages: list[tuple[str, str, str, list[bool]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled pages, with the recurrence of their own corpus."""
    known, repeated = _recurring([(s, c) for s, _, c, _ in pages])
    numbers, x = features([c for _, _, c, _ in pages], [t if n % 2 else None for n, (_, t, _, _) in enumerate(pages)], known, [repeated.get(site) for site, *_ in pages])
    return x, np.array([body[k] for (_, _, _, body), lines in zip(pages, numbers) for k in lines], float)


@lru_cache(maxsize=1)
def fitted(count: int = 6000, depth: int = 13, least: int = 8) -> Tree:
    """The tree, fitted on about ``count`` labelled pages."""
    return Tree(depth, least).fit(*table_of(labelled_sites(count)))


class _Scan:
    def __init__(self, tree: Tree, known, text: bool) -> None:
        self.tree, self.known, self.text = tree, known, text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(self.known.value)
        for batch in batches:
            titles, contents, repeated = (batch.column(i).to_pylist() for i in (1, 2, 3))
            numbers, x = features(contents, titles, known, repeated)
            good, kept, at = self.tree.score(x) >= 0.5, [], 0
            for lines in numbers:
                kept.append([n for n, g in zip(lines, good[at : at + len(lines)]) if g])
                at += len(lines)
            if self.text:
                bodies = []
                for c, k in zip(contents, kept):
                    split = (c or "").split("\n")
                    bodies.append(None if c is None else "\n".join(split[n] for n in k))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array([len(k) for k in kept], pa.int32())], ["page_id", "body", "body_lines"])
            else:
                where = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), pa.array([n for k in kept for n in k], pa.int32())], ["page_id", "line_no"])


def _prepared(pages: DataFrame, page_id: str, title: str | None, content: str, url: str | None) -> tuple[DataFrame, list]:
    """page_id, title, content and what the page's site repeats; and the phrases of many sites."""
    name = F.col(title).cast("string") if title and title in pages.columns else F.lit(None).cast("string")
    host: Column = F.regexp_extract(F.lower(F.col(url)), r"^[a-z]+://([^/?#]+)", 1) if url and url in pages.columns else F.lit("")
    site = F.xxhash64(F.coalesce(F.nullif(host, F.lit("")), F.concat(F.lit("page:"), F.col(page_id).cast("string"))))
    own = pages.select(F.col(page_id).alias("page_id"), name.alias("title"), F.col(content).cast("string").alias("content"), site.alias("site"))
    known, repeated = recurrence(own.where("content is not null"))
    return own.join(repeated, "site", "left").select("page_id", "title", "content", "repeated"), known


def find_body_lines(pages: DataFrame, *, page_id: str = "page_id", title: str | None = "title", content: str = "content", url: str | None = "url") -> DataFrame:
    """(page_id, line_no) of the non-blank lines of the page's own body; lines are split at \\n and counted from 0.

    Null, empty and blank content give no row; every input row counts, repeated ones too. Pages without a readable url are
    sites of their own.
    """
    kind = pages.schema[page_id].dataType.simpleString()
    full, known = _prepared(pages.where(F.col(content).isNotNull()), page_id, title, content, url)
    return full.mapInArrow(_Scan(fitted(), pages.sparkSession.sparkContext.broadcast(known), False), f"page_id {kind}, line_no int")


def extract_body(pages: DataFrame, *, page_id: str = "page_id", title: str | None = "title", content: str = "content", url: str | None = "url") -> DataFrame:
    """One row per page: page_id, body (its own lines joined by \\n; null for null content) and their number."""
    kind = pages.schema[page_id].dataType.simpleString()
    full, known = _prepared(pages, page_id, title, content, url)
    return full.mapInArrow(_Scan(fitted(), pages.sparkSession.sparkContext.broadcast(known), True), f"page_id {kind}, body string, body_lines int")
