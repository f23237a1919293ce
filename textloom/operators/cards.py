"""Cards of a comparison as SVG text: what differs is coloured, lines are wrapped, verse numbers are set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import diffing

WIDTH, NUMBER_WIDTH, LINES, PREVIEW, LINE_HEIGHT, SIZE = 43, 3, 8, 450, 44, 27
#: Colours and fonts of a card.
COLOUR, TEXT, LIGHT, ACCENT, FONT = "#E8A030", "#E8E0D0", "#F4F0E8", "#C48A4A", "Cormorant Garamond, serif"
SEGMENT = "struct<text:string,space:string,highlighted:boolean,marker:boolean>"


def preview(verses: Column, marked: Column, most: int = PREVIEW) -> Column:
    """Texts of the marked verses, from the second on with their number, cut at `most` characters.

    verses: array of (verse, text), of equal numbers the first counts; marked: sorted numbers. Once the limit is reached
    later verses change nothing, so all may be joined and cut.
    """
    found = F.filter(F.transform(marked, lambda n: F.struct(n.alias("n"), F.get(F.filter(verses, lambda v: v["verse"] == n), 0).alias("v"))), lambda x: x["v"].isNotNull())
    # a number goes before a verse only where something precedes it: empty texts at the beginning leave no trace
    joined = F.aggregate(found, F.lit(""), lambda acc, x: F.when(acc == "", x["v"]["text"]).when(F.length(acc) >= most, acc).otherwise(F.concat_ws(" ", acc, x["n"].cast("string"), x["v"]["text"])))
    return F.when(F.length(joined) >= most, F.concat(F.substring(joined, 1, most), F.lit("…"))).otherwise(joined)


def segments(tokens: Column, absent: str, numbers: Column | None = None) -> Column:
    """Segments of one side of a diff: text, the space before it, whether it differs, whether it is a verse number.

    tokens: array of (value, op). absent: `ins` for the old side, `del` for the new one. numbers: verse numbers within the
    text, of each of which the first token that is equal counts.
    """
    own = F.filter(tokens, lambda t: t["op"] != absent)
    values = F.transform(own, lambda t: t["value"])
    none = F.array().cast("array<int>")
    marks = none if numbers is None else F.filter(F.transform(numbers, lambda n: F.array_position(values, n.cast("string")).cast("int")), lambda p: p > 0)

    def all_of(x: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            marker = F.array_contains(x["marks"], i + 1)
            before = F.get(x["own"], i - 1)["value"]
            space = F.when(i == 0, "").when(marker, " ").otherwise(T.space_between(before, t["value"]))
            return F.struct(t["value"].alias("text"), space.alias("space"), (~marker & (t["op"] != "eq")).alias("highlighted"), marker.alias("marker"))

        return F.transform(x["own"], one)

    known = F.array(F.struct(own.alias("own"), F.coalesce(marks, none).alias("marks")))
    return F.get(F.transform(known, all_of), 0).cast(f"array<{SEGMENT}>")


def wrapped(segments: Column, numbered: Column, width: int = WIDTH, most: int = LINES) -> Column:
    """Lines of segments, at most `most`; the first is shorter where it has a number. A line's first segment has no space."""
    lines, line = f"array<array<{SEGMENT}>>", f"array<{SEGMENT}>"
    start = F.struct(F.array().cast(lines).alias("done"), F.array().cast(line).alias("now"), F.lit(0).alias("size"))
    first = F.when(numbered, width - NUMBER_WIDTH).otherwise(width)

    def step(acc: Column, s: Column) -> Column:
        long = F.length(s["space"]) + F.length(s["text"])
        fits = (acc["size"] == 0) | (acc["size"] + long <= F.when(F.size(acc["done"]) == 0, first).otherwise(width))
        bare = F.struct(s["text"].alias("text"), F.lit("").alias("space"), s["highlighted"].alias("highlighted"), s["marker"].alias("marker")).cast(SEGMENT)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"),
            F.when(fits, F.concat(acc["now"], F.array(s))).otherwise(F.array(bare)).cast(line).alias("now"),
            F.when(fits, acc["size"] + long).otherwise(F.length(s["text"])).alias("size"),
        )

    return F.slice(F.aggregate(segments, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])), 1, most)


def runs(line: Column) -> Column:
    """Segments of one style next to each other as one: (text, highlighted, marker)."""
    run = "array<struct<text:string,highlighted:boolean,marker:boolean>>"

    def step(acc: Column, s: Column) -> Column:
        last, text = F.get(acc, F.size(acc) - 1), F.concat(s["space"], s["text"])
        same = F.coalesce((last["highlighted"] == s["highlighted"]) & (last["marker"] == s["marker"]), F.lit(False))
        new = lambda t: F.array(F.struct(t.alias("text"), s["highlighted"].alias("highlighted"), s["marker"].alias("marker")))
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), new(F.concat(last["text"], text)))).otherwise(F.concat(acc, new(text))).cast(run)

    return F.aggregate(line, F.array().cast(run), step)


def svg_block(lines: Column, number: Column, x: int, y: int) -> Column:
    """The lines as one SVG text element, the verse's number before them."""

    def span(run: Column, i: Column, j: Column) -> Column:
        style = F.when(run["marker"], f' font-size="{SIZE}" fill="{LIGHT}"').when(run["highlighted"], f' fill="{COLOUR}"').otherwise("")
        said = F.when(run["marker"], F.concat(F.lit("["), T.escaped_xml(F.trim(run["text"]), "&#39;"), F.lit("]"))).otherwise(T.escaped_xml(run["text"], "&#39;"))
        head = F.concat(F.lit(f'<tspan x="{x}" y="{y - 8}" font-size="{SIZE}" fill="{LIGHT}">['), number.cast("string"), F.lit(f']</tspan><tspan y="{y}" dx="6"'), style)
        begins = F.when((i == 0) & (j == 0), head).when(j == 0, F.concat(F.lit(f'<tspan x="{x}" dy="{LINE_HEIGHT}"'), style)).otherwise(F.concat(F.lit("<tspan"), style, F.when(run["marker"], ' dx="5"').otherwise("")))
        return F.concat(begins, F.lit(">"), said, F.lit("</tspan>"))

    spans = F.transform(lines, lambda line, i: F.array_join(F.transform(runs(line), lambda run, j: span(run, i, j)), ""))
    return F.concat(F.lit(f'<text font-family="{FONT}" font-size="{SIZE}" fill="{TEXT}">'), F.array_join(spans, ""), F.lit("</text>"))


def verse_cards(pairs: DataFrame) -> DataFrame:
    """Adds left_block and right_block, the two sides of a card (R5). pairs: left_text, right_text, number, numbers (within the texts)."""
    rows = diffing.with_diff(pairs)
    for side, absent, x in (("left", "ins", 52), ("right", "del", 624)):
        lines = wrapped(segments(F.col("tokens"), absent, F.col("numbers")), F.col("number") > 0)
        rows = rows.withColumn(f"{side}_block", svg_block(lines, F.col("number"), x, 240))
    return rows.drop("tokens")


def sanitised(params: DataFrame, books: list[str], versions: list[str]) -> DataFrame:
    """book, chapter, v1, v2 of a card's address, empty where unknown, and marks: null unless all four are known."""
    known = lambda c, names: F.when(F.col(c).isin(names), F.col(c)).otherwise("")
    number = F.regexp_extract(F.trim("chapter"), r"^\+?\d+", 0).try_cast("bigint")
    rows = params.withColumns({"book": known("book", books), "v1": known("v1", versions), "v2": known("v2", versions), "chapter": F.when(number > 0, number.cast("string")).otherwise("")})
    whole = (F.col("book") != "") & (F.col("v1") != "") & (F.col("v2") != "") & (F.col("chapter") != "")
    return rows.withColumn("marks", F.when(whole, T.parsed_marks(F.col("mark")))).drop("mark")
