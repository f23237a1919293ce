"""Alignment of page transcripts to a canonical verse grid, its repair and its audit.

A version of a complete transcript is one sequence whose place in the canon depends on all before, so it is walked in one
task per version (`align`); everything before and after is relational, as are fragmentary transcripts (`scaffold`). The audit works by chapter, one bounded group each (`chapter_reports`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels
from .matching import Matcher


@dataclass(frozen=True)
class Walk:
    """How far the walk looks and what it takes for each verse; the values are those for a complete transcript."""

    window_slack: float = 1.5
    window_min: int = 20
    consume_slack: float = 1.1
    consume_min: int = 3
    high_match: float = 1.0
    tail_gap: float = 0.0
    tail_most_match: float = 0.7
    skip_below: float = 0.0
    ratio: float | None = None
    anchor_words: int = 0
    anchor_ahead: int = 3


def earliest(window: list[str], verse: list[str], match: Matcher) -> list[int]:
    """Window positions matched by a longest common subsequence, each verse word at its earliest place."""
    m, n = len(window), len(verse)
    if not m or not n:
        return []
    same = match.table(window, verse)
    left = np.zeros((m + 1, n + 1), np.int32)
    for i in range(m - 1, -1, -1):
        row = np.where(same[i], left[i + 1, 1:] + 1, left[i + 1, :-1])
        left[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]  # a match is never worse than its neighbours
    out, i, j = [], 0, 0
    while i < m and j < n:
        if same[i, j] and left[i, j] == left[i + 1, j + 1] + 1:
            out.append(i)
            i, j = i + 1, j + 1
        elif left[i + 1, j] >= left[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


class Grid:
    """The canon as the walk reads it: verses (book, words), and for each word of a transcript where it matches in a verse.

    What a transcript word stands for is found once, for the whole vocabulary; a verse's words are bits of a whole number.
    """

    MOST = 200_000

    def __init__(self, verses: list[tuple[str, list[str]]], match: Matcher | None = None):
        self.verses, self.match = verses, match or Matcher()
        self.canon = {w for _, v in verses for w in v}
        self.vocabulary = sorted(self.canon)
        self.total = sum(len(v) for _, v in verses)
        self.begin: dict[str, int] = {}
        for k, (book, _) in enumerate(verses):
            self.begin.setdefault(book, k)
        self.known: dict[str, list[str]] = {}
        self.places: dict[int, dict[str, int]] = {}

    def learn(self, words: list[str]) -> None:
        """Makes the words known, which bits() needs."""
        if len(self.known) > self.MOST:
            self.known.clear()
        new = sorted({w for w in words if w not in self.known})
        if new:
            self.known |= self.match.rows(new, self.vocabulary) if self.vocabulary else dict.fromkeys(new, [])

    def bits(self, word: str, verse: int) -> int:
        """The words of a verse that a word stands for, the first one as the lowest bit."""
        places = self.places.get(verse)
        if places is None:
            places = self.places[verse] = {}
            for j, w in enumerate(self.verses[verse][1]):
                places[w] = places.get(w, 0) | 1 << j
        out = 0
        for w in self.known[word]:
            if w in places:
                out |= places[w]
        return out

    def earliest(self, window: list[str], verse: int) -> list[int]:
        """As earliest(); a row of the table is one whole number, made from the row after it by one addition."""
        n = len(self.verses[verse][1])
        every = (1 << n) - 1
        same = [self.bits(w, verse) for w in window]
        # read from the ends, so the first word of a verse is the highest bit; a zero: one more in common with this word than without it
        free, rows = every, [every]
        for bits in reversed(same):
            hit = free & int(format(bits, f"0{n}b")[::-1], 2) if bits else 0
            if hit:
                free = (free + hit | free - hit) & every
            rows.append(free)
        rows.reverse()
        out, i, j, m = [], 0, 0, len(window)
        while i < m and j < n:
            low = (1 << n - j) - 1  # the words from j on
            rest = rows[i] & low
            if rest == low:
                break  # nothing in common
            if same[i] >> j & 1:
                out.append(i)
                i, j = i + 1, j + 1
            elif rest.bit_count() == (rows[i + 1] & low).bit_count() or not rest >> (n - j - 1) & 1:
                i += 1
            else:
                j += 1
        return out


def without_sparse_tail(matched: list[int], gap: float) -> list[int]:
    """Matches up to the first wide gap of their second half."""
    if len(matched) < 3:
        return matched
    for k in range(len(matched) // 2, len(matched)):
        if matched[k] - matched[k - 1] > gap:
            return matched[:k]
    return matched


def merged_breaks(words: list[str], lines: list[int], canon: set[str]) -> list[list[int]]:
    """Indices of words, two together where a line break cut a canonical word (L3)."""
    out, i = [], 0
    while i < len(words):
        pair = words[i : i + 2]
        cut = len(pair) == 2 and lines[i] != lines[i + 1] and "".join(pair) in canon and not canon.issuperset(pair)
        out.append([i, i + 1] if cut else [i])
        i += 1 + cut
    return out


def best_start(window: list[str], verses: list[tuple[str, list[str]]], low: int, high: int, match: Matcher, ahead: int) -> int:
    """Of the verses low..high-1 the first whose words, with those of the verses after it, have most in common with a window.

    `ahead` verses are taken together. Lengths of common subsequences come from one addition of whole numbers a word, a bit
    for each canonical word; which words match is one table for all verses.
    """
    if not window or low >= high:
        return low
    vocabulary = sorted({w for _, v in verses[low:high] for w in v})
    if not vocabulary:
        return low
    place = {w: i for i, w in enumerate(vocabulary)}
    distinct = sorted(set(window))
    same = match.table(distinct, vocabulary)[[distinct.index(w) for w in window]]
    same = same[:, [place[w] for _, v in verses[low:high] for w in v]]
    begin = np.concatenate([[0], np.cumsum([len(v) for _, v in verses[low:high]])])
    best, most = low, -1
    for j in range(high - low):
        a, b = begin[j], begin[min(j + max(1, ahead), high - low)]
        every = (1 << int(b - a)) - 1
        free = every
        for row in np.packbits(same[:, a:b], axis=1, bitorder="little"):
            hit = free & int.from_bytes(row.tobytes(), "little")
            free = (free + hit | free - hit) & every
        score = int(b - a) - free.bit_count()
        if score > most:
            best, most = low + j, score
    return best


def walk(words: list[str], lines: list[int], starts: dict[int, str | None], verses: list[tuple[str, list[str]]], config: Walk = Walk(), match: Matcher | None = None, grid: Grid | None = None) -> list[int]:
    """Verse index of each transcript word.

    lines: a number for each word's line. starts: word index -> book (or None) of each heading. verses: (book, words) in canonical order.
    A heading starts a segment; one that names a book moves the walk forward to it, and ends the reach of those before.
    grid: of these verses, where several versions are walked.
    """
    if not words or not verses:
        return []
    grid = grid or Grid(verses, match)
    match = grid.match
    units = merged_breaks(words, lines, grid.canon)
    text = ["".join(words[i] for i in u) for u in units]
    grid.learn(text)
    total, begin = grid.total, grid.begin
    ratio = config.ratio if config.ratio is not None else len(words) / total if total else 1.1
    unit_of = {i: k for k, u in enumerate(units) for i in u}
    cuts = sorted({0, *(unit_of[i] for i in starts if 0 < i < len(words))})
    books = {unit_of[i]: b for i, b in starts.items() if 0 < i < len(words)}
    jumps = [begin.get(books.get(c)) for c in cuts]
    out: list[int | None] = [None] * len(units)
    at = 0
    half_up = lambda x: int(np.floor(x + 0.5))
    for s, (first, end) in enumerate(zip(cuts, [*cuts[1:], len(units)])):
        if jumps[s] is not None:
            at = max(at, jumps[s])
        limit = next((j for j in jumps[s + 1 :] if j is not None), len(verses))
        if config.anchor_words > 0 and at < limit:
            at = best_start(text[first : min(end, first + config.anchor_words)], verses, at, limit, match, config.anchor_ahead)
        here = first
        while here < end and at < limit:
            verse = verses[at][1]
            if not verse:
                at += 1
                continue
            expected = len(verse) * ratio
            window = text[here : min(end, here + max(half_up(expected * config.window_slack), config.window_min))]
            matched = grid.earliest(window, at)
            share = len(matched) / len(verse)
            if config.tail_gap > 0 and len(matched) >= 3 and share < config.tail_most_match:
                matched = without_sparse_tail(matched, ratio * config.tail_gap)
            most = max(half_up(expected * config.consume_slack), config.consume_min)
            if not matched and end - here <= most / 2:
                break  # the verse probably begins in the next segment
            if config.skip_below > 0 and share < config.skip_below:
                at += 1
                continue
            taken = min(most, len(window)) if not matched else matched[-1] + 1 if share >= config.high_match else min(matched[-1] + 1, most)
            out[here : here + taken] = [at] * taken
            here += taken
            at += 1
    last = len(verses) - 1
    result = [0] * len(words)
    for unit, v in zip(units, out):
        last = last if v is None else v
        for i in unit:
            result[i] = last
    return result


def align(words: DataFrame, canon: DataFrame, config: Walk = Walk(), dictionary: dict[str, str] | None = None) -> DataFrame:
    """(version, pos, verse_ord) of transcript words by the walk.

    words: version, pos, norm, line_no, heading (null, or the heading of a line at its first word), book (that the heading
    names, or null). canon: ord, book, norms. A walk depends on all that it has passed, so a version is walked by one task,
    which holds it and the canon; versions are dealt to as many lots as there are shuffle partitions, and each lot gets the
    canon by the shuffle, ahead of its versions.
    """
    spark = words.sparkSession
    lots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = words.select(
        F.pmod(F.xxhash64("version"), F.lit(lots)).cast("int").alias("lot"), F.lit(1).alias("kind"), "version", F.col("pos").cast("long").alias("pos"),
        "norm", F.col("line_no").cast("long").alias("line_no"), "heading", "book", F.lit(None).cast("array<string>").alias("norms"),
    )
    none = F.lit(None).cast("string")
    grid = canon.select(
        F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), F.lit(0), none, F.col("ord").cast("long"), none, F.lit(None).cast("long"), none, "book", F.col("norms"),
    )
    rows = own.unionAll(grid).repartition("lot").sortWithinPartitions("lot", "kind", "version", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(dictionary)
        lot, verses, ords, version, held, grid = None, [], [], None, [], None

        def walked() -> Iterator[pa.RecordBatch]:
            nonlocal grid
            if held:
                if grid is None or grid.verses is not verses:
                    grid = Grid(verses, match)
                heads = {i: book for i, (_, _, _, heading, book) in enumerate(held) if heading is not None}
                found = walk([x[1] for x in held], [x[2] for x in held], heads, verses, config, match, grid)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([version] * len(held), pa.string()), pa.array([x[0] for x in held], pa.int64()), pa.array([ords[v] for v in found], pa.int64())], ["version", "pos", "verse_ord"])

        for batch in batches:
            for at, kind, name, pos, norm, line, heading, book, norms in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (at != lot or name != version or not kind):
                    yield from walked()
                    held = []
                if at != lot:
                    lot, verses, ords = at, [], []
                if kind:
                    version = name
                    held.append((pos, norm, line, heading, book))
                else:
                    verses.append((book, norms))
                    ords.append(pos)
        yield from walked()

    return rows.mapInArrow(run, "version string, pos long, verse_ord long")


def lines_of_verses(words: DataFrame) -> DataFrame:
    """Words joined to lines of verses: version, verse_ord, line_no, text, id; lines over several verses lettered.

    words: version, pos, raw, page, line, line_no, verse_ord.
    """
    lines = words.groupBy("version", "verse_ord", "page", "line", "line_no").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("w"), F.min("pos").alias("first"))
    text = F.array_join(F.transform("w", lambda x: x["raw"]), " ")
    own = Window.partitionBy("version", "line_no")
    suffix = F.when(F.count("*").over(own) > 1, F.char(96 + F.row_number().over(own.orderBy("first")))).otherwise("")
    name = F.concat(F.col("page").cast("string"), F.lit(":"), F.col("line").cast("string"), suffix)
    return lines.select("version", "verse_ord", "line_no", "first", text.alias("text"), name.alias("id"))


def _overridden(words: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every (version, pos) with an override that takes it."""
    at = (F.col("o.page") == F.col("w.page")) & (F.col("o.line") == F.col("w.line"))
    inside = F.col("o.low").isNull() | F.col("w.word").between(F.col("o.low"), F.col("o.high"))
    if "words" in overrides.columns:  # single words win over a range
        inside = F.coalesce(F.array_contains("o.words", F.col("w.word")), inside)
    return words.alias("w").join(overrides.alias("o"), at & inside).select("w.version", "w.pos", "o.idx", "o.target")


def with_overrides(words: DataFrame, overrides: DataFrame) -> DataFrame:
    """verse_ord replaced by overrides, the last one winning (J7): by single words, a word range or the whole line.

    overrides: idx, page, line, low, high, target and maybe words, an array of places in the line.
    """
    best = _overridden(words, overrides).groupBy("version", "pos").agg(F.max_by("target", "idx").alias("_target"))
    return words.join(best, ["version", "pos"], "left").withColumn("verse_ord", F.coalesce("_target", "verse_ord")).drop("_target")


def unmatched_overrides(words: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides that take no word."""
    return overrides.join(_overridden(words, overrides).select("idx").distinct(), "idx", "left_anti")


# --- audit ------------------------------------------------------------------------------------------------------------


def edge_run(places: list[tuple[int, int] | None], words: list[str], chapter: int, verse: int) -> tuple[str, int, list[str]] | None:
    """From one edge of a verse: (side, verse, words) of the run of words that belong before or after it."""
    found: list[str] = []
    side, into = "", 0
    for place, word in zip(places, words):
        if place is None:
            continue
        if place[0] != chapter or place[1] == verse:
            break
        now = "before" if place[1] < verse else "after"
        if side and now != side:
            break
        side, into = side or now, into if side else place[1]
        found.append(word)
    return (side, into, found) if found else None


def verse_findings(places: list[tuple[int, int] | None], words: list[str], chapter: int, verse: int) -> tuple[dict[str, int], list[tuple[str, int | None, list[str]]]]:
    """Histogram of matched places and findings (type, into, words) of one verse (Q3)."""
    met = [p for p in places if p is not None]
    histogram = Counter(str(v) if c == chapter else f"{c}:{v}" for c, v in met)
    out: list[tuple[str, int | None, list[str]]] = []
    head, tail = edge_run(places, words, chapter, verse), edge_run(places[::-1], words[::-1], chapter, verse)
    if head and head[0] == "before":
        out.append(("leading-bleed", head[1], head[2]))
    if tail and tail[0] == "after":
        out.append(("trailing-bleed", tail[1], tail[2][::-1]))
    edges = bool(out)
    other: dict[int, list[str]] = {}
    for p, w in zip(places, words):
        if p is not None and p[0] != chapter:
            other.setdefault(p[0], []).append(w)
    out += [("chapter-bleed", c, w) for c, w in other.items()]
    own = histogram.get(str(verse), 0)
    if met and own / len(met) < 0.5 and (not edges or not own):
        out.append(("major-misalignment", None, [w for p, w in zip(places, words) if p is not None and p != (chapter, verse)]))
    return dict(histogram), out


def split_word(tail_line: str, head_line: str, canon: set[str]) -> str | None:
    """A canonical word cut between two lines, if not both parts are words."""
    a, b = re.search(r"[A-Za-z0-9]+$", tail_line), re.match(r"[A-Za-z0-9]+", head_line)
    if not a or not b:
        return None
    x, y = a[0].lower(), b[0].lower()
    return x + y if x + y in canon and not (x in canon and y in canon) else None


FINDINGS = "array<struct<type:string,into:int,tokens:array<string>>>"
REPORT = f"version string, book string, chapter int, verse int, total_tokens int, matched int, unmatched int, histogram map<string,int>, findings {FINDINGS}, internal_splits array<string>"


def chapter_report(aligned: list[tuple[int, list[str]]], canonical: list[tuple[int, int, str]], chapter: int) -> list[tuple]:
    """Rows of one chapter (Q1-Q5). aligned: (verse, lines); canonical: (chapter, verse, text), neighbours included."""
    split = lambda t: re.findall("[a-z0-9]+", t.lower().replace("&", " and "))
    mine = [(v, w) for v, lines in aligned for w in split(" ".join(lines))]
    grid = [((c, v), w) for c, v, t in canonical for w in split(t)]
    places: list[tuple[int, int] | None] = [None] * len(mine)
    for i, j in kernels.lcs_latest([w for _, w in mine], [w for _, w in grid]):
        places[i] = grid[j][0]
    known = {w for _, w in grid}
    rows = []
    for verse in sorted({v for v, _ in mine}):
        at = [i for i, (v, _) in enumerate(mine) if v == verse]
        own = [places[i] for i in at]
        histogram, found = verse_findings(own, [mine[i][1] for i in at], chapter, verse)
        k = next(i for i, (v, _) in enumerate(aligned) if v == verse)
        lines = aligned[k][1]
        if k + 1 < len(aligned) and lines and aligned[k + 1][1] and (word := split_word(lines[-1], aligned[k + 1][1][0], known)):
            found.append(("split-word-bleed", aligned[k + 1][0], [word]))
        inner = [w for a, b in zip(lines, lines[1:]) if (w := split_word(a, b, known))]
        rows.append((verse, len(at), sum(p == (chapter, verse) for p in own), sum(p is None for p in own), histogram, found, inner))
    return rows


def chapter_reports(aligned: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per aligned verse with its findings.

    aligned: version, book, chapter, verse, pos, lines (array of texts). canonical: book, chapter, verse, pos, text.
    """
    grid = canonical.groupBy("book", "chapter").agg(F.array_sort(F.collect_list(F.struct("pos", "chapter", "verse", "text"))).alias("g"))
    before = grid.select("book", (F.col("chapter") + 1).alias("chapter"), F.slice("g", -1, 1).alias("prev"))
    after = grid.select("book", (F.col("chapter") - 1).alias("chapter"), F.slice("g", 1, 1).alias("next"))
    none = F.slice("g", 1, 0)
    whole = grid.join(before, ["book", "chapter"], "left").join(after, ["book", "chapter"], "left")
    whole = whole.select("book", "chapter", F.concat(F.coalesce("prev", none), "g", F.coalesce("next", none)).alias("grid"))
    mine = aligned.groupBy("version", "book", "chapter").agg(F.array_sort(F.collect_list(F.struct("pos", "verse", "lines"))).alias("verses"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = chapter_report([(v["verse"], v["lines"] or []) for v in r["verses"]], [(g["chapter"], g["verse"], g["text"]) for g in r["grid"]], r["chapter"])
                out += [(r["version"], r["book"], r["chapter"], *x) for x in rows]
            if out:
                c = list(zip(*out))
                finding = pa.list_(pa.struct([("type", pa.string()), ("into", pa.int32()), ("tokens", pa.list_(pa.string()))]))
                found = pa.array([[{"type": t, "into": i, "tokens": w} for t, i, w in f] for f in c[8]], finding)
                columns = [pa.array(c[0]), pa.array(c[1]), *(pa.array(x, pa.int32()) for x in c[2:7]), pa.array([list(h.items()) for h in c[7]], pa.map_(pa.string(), pa.int32())), found, pa.array(c[9], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["version", "book", "chapter", "verse", "total_tokens", "matched", "unmatched", "histogram", "findings", "internal_splits"])

    return mine.join(whole, ["book", "chapter"]).select("version", "book", "chapter", "verses", "grid").mapInArrow(run, REPORT)


def report_summary(reports: DataFrame) -> DataFrame:
    """Verses, verses with findings, findings of each type (0 where none) and inner splits by chapter."""
    types = ["leading-bleed", "trailing-bleed", "major-misalignment", "chapter-bleed", "split-word-bleed"]
    count = lambda t: F.sum(F.size(F.filter("findings", lambda f: f["type"] == t))).alias(t.replace("-", "_"))
    found = F.count_if(F.size("findings") > 0).alias("verses_with_findings")
    return reports.groupBy("version", "book", "chapter").agg(F.count("*").alias("total_verses"), found, *map(count, types), F.sum(F.size("internal_splits")).alias("internal_splits"))


# --- editors' markup --------------------------------------------------------------------------------------------------

KINDS = ("deleted", "unclear", "inserted")
_MARKER = re.compile(r"~~|\{\{|\}\}|[\[\]<>​]")


def markup(text: str) -> list[dict]:
    """Display tokens of a marked-up text with their kinds and, where these change within a token, its segments (F16)."""
    depth = dict.fromkeys(KINDS, 0)
    plain, kinds, at = "", [], 0
    for m in [*_MARKER.finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        plain += part
        kinds += [tuple(k for k in KINDS if depth[k])] * len(part)
        if m:
            at, mark = m.end(), m[0]
            if mark == "~~":
                depth["deleted"] ^= 1
            elif mark in ("{{", "}}"):
                depth["unclear"] = max(0, depth["unclear"] + (1 if mark == "{{" else -1))
            elif mark != "​":
                depth["inserted"] = max(0, depth["inserted"] + (1 if mark in "[<" else -1))
    out = []
    for m in kernels.DISPLAY.finditer(plain):
        own = kinds[m.start() : m.end()]
        cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
        parts = [{"text": m[0][a:b], "kinds": list(own[a]) or ["normal"]} for a, b in zip(cuts, cuts[1:])]
        all_ = [k for k in KINDS if any(k in x for x in own)] or ["normal"]
        out.append({"text": m[0], "kind": all_[0], "kinds": all_, "segments": parts if len(parts) > 1 else None})
    return out


MARKUP = "array<struct<text:string,kind:string,kinds:array<string>,segments:array<struct<text:string,kinds:array<string>>>>>"


def with_markup(df: DataFrame, text: str, out: str = "markup") -> DataFrame:
    """Adds the tokens of marked-up texts."""

    @F.pandas_udf(MARKUP)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: markup(t or ""))

    return df.withColumn(out, parse(F.col(text)))
