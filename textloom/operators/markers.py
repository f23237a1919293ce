"""Chapter marker lines moved to where they belong.

Words are (version, pos, page, line, marker, ord): pos is the place in the transcript, marker whether the whole line is a
chapter marker, ord the canonical verse given to the word. The canon is (ord, book, chapter, verse), ord in reading order.
All lines are decided on the given assignment; a version is one window, ordered by pos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LINE = ["version", "page", "line"]


def _marker_lines(words: DataFrame, canon: DataFrame) -> DataFrame:
    """One row for each marker line: ords at its ends, chapters and the neighbours' places."""
    w = Window.partitionBy("version").orderBy("pos")
    named = words.join(canon.select("ord", "book", "chapter", "verse"), "ord", "left")
    here = F.struct("ord", "book", "chapter", "verse")
    rows = named.withColumns({"_here": here, "_before": F.lag(here).over(w), "_after": F.lead(here).over(w)}).where("marker")
    return rows.groupBy(*LINE).agg(
        F.min_by("_before", "pos").alias("before"), F.min_by("_here", "pos").alias("first"), F.max_by("_after", "pos").alias("after"),
        F.min("_here").alias("low"), F.max("_here").alias("high"),
    )


def _moved(words: DataFrame, lines: DataFrame) -> DataFrame:
    """The words, those of marker lines at the line's target where it has one."""
    return words.join(lines.select(*LINE, "target"), LINE, "left").withColumn("ord", F.when(F.col("marker"), F.coalesce("target", "ord")).otherwise(F.col("ord"))).drop("target")


def push_forward(words: DataFrame, canon: DataFrame) -> DataFrame:
    """Marker lines go to the first verse of the later chapter that they touch.

    A line within one chapter moves only where the next word is in another one: then to the chapter that follows in the
    same book, if there is one.
    """
    chapters = canon.groupBy("book", "chapter").agg(F.min("ord").alias("begin"))
    chapters = chapters.withColumn("next_begin", F.lead("begin").over(Window.partitionBy("book").orderBy("begin")))
    lines = _marker_lines(words, canon).withColumns({"book": F.col("high.book"), "chapter": F.col("high.chapter")}).join(chapters, ["book", "chapter"], "left")
    straddles = (F.col("low.book") == F.col("high.book")) & (F.col("low.chapter") < F.col("high.chapter"))
    leaves = F.col("after").isNotNull() & ~(F.col("after.book").eqNullSafe(F.col("book")) & F.col("after.chapter").eqNullSafe(F.col("chapter")))
    return _moved(words, lines.withColumn("target", F.when(straddles, F.col("begin")).when(leaves, F.col("next_begin"))))


def attach_orphans(words: DataFrame, canon: DataFrame, title: int = 0) -> DataFrame:
    """A marker line right after a chapter's title verse goes to that verse."""
    lines = _marker_lines(words, canon)
    same: Column = (F.col("before.book") == F.col("first.book")) & (F.col("before.chapter") == F.col("first.chapter"))
    after_title = same & (F.col("before.verse") == title) & (F.col("first.verse") > title)
    return _moved(words, lines.withColumn("target", F.when(after_title, F.col("before.ord"))))
