"""Comparison of two versions of a chapter: whole-chapter diffs, their sides, and the comparison as one call (D-3, R1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from . import diffing, kernels

TOKENS = "array<struct<value:string,op:string,kind:string,left_verse:int,right_verse:int,match:int>>"


FIELDS = ("value", "op", "kind", "left_verse", "right_verse", "match")


def _cut(left: list[str], right: list[str], kinds: bool) -> list[tuple]:
    """FIELDS of each token of the diff of all verses at once."""
    sides = [[kernels.display(v) for v in verses] for verses in (left, right)]
    place = [[i for i, tokens in enumerate(side, 1) for _ in tokens] for side in sides]
    found = kernels.diff(*([t for tokens in side for t in tokens] for side in sides))
    out, x, y, match = [], 0, 0, 0
    for value, op, kind in kernels.classified(found) if kinds else ((v, o, None) for v, o in found):
        a = b = m = None
        if op != "ins":
            a, x = place[0][x], x + 1
        if op != "del":
            b, y = place[1][y], y + 1
        if op == "eq":
            m = match = match + 1
        out.append((value, op, kind, a, b, m))
    return out


def chapter_tokens(left: list[str], right: list[str]) -> list[dict]:
    """The classified diff of all verses at once, each token with the verse of either side that it falls to (from 1).

    match numbers the tokens that both sides have (J13); a side's verse is null for a token that it lacks.
    """
    return [dict(zip(FIELDS, t)) for t in _cut(left, right, True)]


def _mapped(chapters: DataFrame, left: str, right: str, out: str, type_: str, made: Callable[[list[list[str]], list[list[str]]], pa.Array]) -> DataFrame:
    """Adds what is made of both sides' verses, null ones empty."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chapters.schema) + f", {out} {type_}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (left, right))
            yield pa.RecordBatch.from_arrays([*batch.columns, made(*([[t or "" for t in verses or []] for verses in side] for side in sides))], [*batch.schema.names, out])

    return chapters.mapInArrow(run, schema)


def chapter_diff(chapters: DataFrame, left: str = "left", right: str = "right", out: str = "tokens") -> DataFrame:
    """Adds the tokens of a whole-chapter diff; left and right are arrays of verse texts, null ones empty."""
    kind = pa.struct([("value", pa.string()), ("op", pa.string()), ("kind", pa.string()), *((x, pa.int32()) for x in ("left_verse", "right_verse", "match"))])
    return _mapped(chapters, left, right, out, TOKENS, lambda a, b: diffing.token_lists([_cut(x, y, True) for x, y in zip(a, b)], kind))


def sides_of(tokens: list[tuple]) -> list[tuple[str, int, list[str]]]:
    """(side, verse, values) of the verses with tokens, read back from a whole-chapter diff."""
    out = []
    for name, at in (("left", 3), ("right", 4)):
        for verse, own in groupby((t for t in tokens if t[at] is not None), key=itemgetter(at)):
            out.append((name, verse, [t[0] for t in own]))
    return out


def chapter_verses(chapters: DataFrame, left: str = "left", right: str = "right", out: str = "sides") -> DataFrame:
    """Adds both sides' verses with their tokens (side, verse, values), read back from a whole-chapter diff (D-3, P6)."""
    kind = pa.struct([("side", pa.string()), ("verse", pa.int32()), ("values", pa.list_(pa.string()))])
    return _mapped(chapters, left, right, out, "array<struct<side:string,verse:int,values:array<string>>>", lambda a, b: diffing.token_lists([sides_of(_cut(x, y, False)) for x, y in zip(a, b)], kind))


def row_spans(ops: list[str], left: list[int], right: list[int], start: int = 0) -> list[tuple[str, int, int, int]]:
    """(side, verse from 1, row, end) of the verses of a chapter's two sides in a grid of rows (D-7).

    ops: of the whole-chapter diff; left, right: tokens of each verse. The rows of both sides advance apart, a verse being
    placed at its last token; where the numbers of verses differ the side that is behind catches up. A right verse that
    ends on a row that the left side has left reaches to the row of the last token that the current left verse shares.
    """
    rows, verse, token = [start + 1, start + 1], [0, 0], [0, 0]
    sizes, apart = (left, right), len(left) != len(right)
    shared: int | None = None
    out: list[tuple[str, int, int, int]] = []
    for op in ops:
        token[0] += op != "ins"
        token[1] += op != "del"
        if op == "eq":
            shared = rows[0]
        for side in (0, 1):
            if verse[side] < len(sizes[side]) and token[side] == sizes[side][verse[side]]:
                row = rows[side]
                end = (shared if shared is not None else row) if side and row < rows[0] else row
                out.append(("right" if side else "left", verse[side] + 1, row, end))
                token[side], verse[side] = 0, verse[side] + 1
                rows[side] += 1
                if apart:
                    rows[side] = max(rows)
                if not side:
                    shared = None
    return out


def chapter_rows(chapters: DataFrame, left: str = "left", right: str = "right", out: str = "rows") -> DataFrame:
    """Adds the rows of both sides' verses, an array of (side, verse, row, end), from a whole-chapter diff (D-3, D-7)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chapters.schema) + f", {out} array<struct<side:string,verse:int,row:int,end:int>>"
    kind = pa.list_(pa.struct([("side", pa.string()), ("verse", pa.int32()), ("row", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for pair in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (left, right))):
                texts = [[kernels.display(t or "") for t in side or []] for side in pair]
                ops = [op for _, op in kernels.diff(*([t for verse in side for t in verse] for side in texts))]
                found.append([dict(zip(("side", "verse", "row", "end"), x)) for x in row_spans(ops, *([len(v) for v in side] for side in texts))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, out])

    return chapters.mapInArrow(run, schema)


def side(tokens: Column, absent: str) -> Column:
    """Tokens of one side: without insertions (absent="ins") the old one, without deletions ("del") the new one."""
    return F.filter(tokens, lambda t: t["op"] != absent)


def extant(left: Column, right: Column) -> Column:
    """both, left only, right only or neither: which sides have verses."""
    a, b = F.coalesce(F.size(left), F.lit(0)) > 0, F.coalesce(F.size(right), F.lit(0)) > 0
    return F.when(a & b, "both").when(a, "left only").when(b, "right only").otherwise("neither")


def side_by_side(verses: DataFrame, v1: str, v2: str) -> DataFrame:
    """(book, chapter, left, right, extant) of two versions; verses: version, book, chapter, pos, text."""
    texts = lambda v, name: verses.where(F.col("version") == v).groupBy("book", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias(name))
    both = texts(v1, "left").join(texts(v2, "right"), ["book", "chapter"], "full_outer")
    return both.withColumn("extant", extant(F.col("left"), F.col("right")))


def compared(verses: DataFrame, v1: str, v2: str, book: str | None = None, chapter: int | None = None, whole: tuple[str, ...] = ("om",)) -> DataFrame:
    """The comparison page (R1): tokens of each verse of the chapters that both versions have.

    Verses are paired by position (J1, D-2), except with a version named in `whole`, whose chapters are diffed at once (D-3).
    Columns: book, chapter, left_verse, right_verse, place, value, op, kind.
    """
    if book is not None:
        verses = verses.where(F.col("book") == book)
    if chapter is not None:
        verses = verses.where(F.col("chapter") == chapter)
    both = side_by_side(verses, v1, v2).where("extant = 'both'")
    if v1 in whole or v2 in whole:
        tokens = chapter_diff(both.select("book", "chapter", "left", "right")).select("book", "chapter", F.posexplode("tokens").alias("place", "t"))
        return tokens.select("book", "chapter", "t.left_verse", "t.right_verse", "place", "t.value", "t.op", "t.kind")
    rows = both.select("book", "chapter", F.posexplode(F.arrays_zip("left", "right")).alias("i", "z"))
    rows = rows.select("book", "chapter", (F.col("i") + 1).alias("rn"), F.coalesce("z.left", F.lit("")).alias("left_text"), F.coalesce("z.right", F.lit("")).alias("right_text"))
    tokens = diffing.with_diff(rows).select("book", "chapter", "rn", F.posexplode("tokens").alias("place", "t"))
    return tokens.select("book", "chapter", F.when(F.col("t.op") != "ins", F.col("rn")).alias("left_verse"), F.when(F.col("t.op") != "del", F.col("rn")).alias("right_verse"), "place", "t.value", "t.op", "t.kind")


def specimen(verses: DataFrame, v1: str, v2: str, book: str, chapter: int, verse: int) -> DataFrame:
    """left, right: tokens (value, op, kind) of both sides of one verse, without editors' marks; no row where either lacks it."""
    at = (F.col("book") == book) & (F.col("chapter") == chapter) & (F.col("verse") == verse)
    one = lambda v, name: verses.where((F.col("version") == v) & at).orderBy("pos").limit(1).select(F.lit(1).alias("k"), T.without_markup(F.coalesce("markdown", "text")).alias(name))
    tokens = diffing.with_diff(one(v1, "left_text").join(one(v2, "right_text"), "k"))
    return tokens.select(side(F.col("tokens"), "ins").alias("left"), side(F.col("tokens"), "del").alias("right"))


def overlaid(tokens: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th token of a side with the k-th token of its marked-up text (D-6).

    tokens: keys, place, value; marked: keys, markup (array, see alignment.with_markup). Adds markup, null where there is none.
    """
    flat = marked.select(*keys, F.posexplode("markup").alias("_k", "markup"))
    kth = F.row_number().over(Window.partitionBy(*keys).orderBy("place")) - 1
    return tokens.withColumn("_k", kth).join(flat, [*keys, "_k"], "left").drop("_k")
