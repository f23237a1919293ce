"""Segments of a transcript: where a heading line begins a new one (L4), by the starts of lines.

Lines are (version, line_no, text), in order by line_no, each with at least one word; a line without words never starts
anything. All steps are windows within a version and one group for each run of capital lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

CHAPTER, FIRST = r"^chapter\b", r"^chapter\s+(i|1)$"


def line_starts(words: DataFrame) -> DataFrame:
    """The words with starts: whether a word is on another line than the one before it (W8). words: version, pos, page, line."""
    w = Window.partitionBy("version").orderBy("pos")
    here = F.struct("page", "line")
    return words.withColumn("starts", ~F.lag(here).over(w).eqNullSafe(here))


def heading_lines(lines: DataFrame, is_heading: Callable[[Column], Column], capital_titles: bool = False) -> DataFrame:
    """Adds heading: the heading text of a line that begins a segment, else null; the first line begins none.

    is_heading: tells a heading line by its text. With capital_titles, titles of books are lines in capitals only: another
    line that reads like one is prose, and the capital lines after a title belong to it, up to a chapter line. A first
    chapter's line right after a capital line is part of the title before it.
    """
    w = Window.partitionBy("version").orderBy("line_no")
    plain = T.heading_text(F.col("text"))
    lines = lines.withColumns({"_plain": plain, "_caps": T.is_all_caps(F.col("text"))})
    lines = lines.withColumns({"_chapter": F.rlike("_plain", F.lit(CHAPTER)), "_first": F.row_number().over(w) == 1, "_after_caps": F.coalesce(F.lag("_caps").over(w), F.lit(False))})
    starts = is_heading(F.col("text")) & ~F.col("_first")
    heading = F.col("_plain")
    if capital_titles:
        starts = starts & (F.col("_chapter") | F.col("_caps"))
        lines = _joined(lines, w)
        heading = F.when(F.col("_chapter"), heading).otherwise(F.concat_ws(" ", heading, F.col("_more")))
    lines = lines.withColumn("heading", F.when(starts, heading))
    of_title = F.rlike("heading", F.lit(FIRST)) & F.col("_after_caps")
    out = lines.withColumn("heading", F.when(~of_title, F.col("heading")))
    return out.drop("_plain", "_caps", "_chapter", "_first", "_after_caps", "_more")


def _joined(lines: DataFrame, w: Window) -> DataFrame:
    """Adds _more: the capital lines that follow each line, up to a chapter line, joined."""
    own = F.col("_caps") & ~F.col("_chapter")
    ends = F.sum((~own).cast("int")).over(w)  # constant over a run of capital lines and the line before it
    lines = lines.withColumns({"_own": own, "_run": ends})
    runs = lines.where("_own").groupBy("version", "_run").agg(F.array_sort(F.collect_list(F.struct("line_no", "_plain"))).alias("_lines"))
    lines = lines.join(runs, ["version", "_run"], "left")
    after = F.filter("_lines", lambda x: x["line_no"] > F.col("line_no"))
    return lines.withColumn("_more", F.array_join(F.transform(after, lambda x: x["_plain"]), " ")).withColumn("_more", F.when(F.col("_more") != "", F.col("_more"))).drop("_own", "_run", "_lines")


def segments(lines: DataFrame) -> DataFrame:
    """Adds segment: the number of headings up to a line, from 0. lines: as heading_lines() gives them."""
    w = Window.partitionBy("version").orderBy("line_no")
    return lines.withColumn("segment", F.count("heading").over(w).cast("int"))
