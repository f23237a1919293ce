"""An alignment in one call: raw pages of a source against the canon, to verses as they are written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..sources import corpus
from ..storage import stored
from . import alignment, markers, output, scaffold, segments

LINE_WORDS = 1 << 24


@dataclass(frozen=True)
class Edition:
    """How a source is aligned: complete transcripts are walked, fragmentary ones put on a scaffold.

    is_heading tells a heading line by its text; book_rules are (pattern, book) over heading texts, the first that fits.
    """

    is_heading: Callable[[Column], Column] = lambda c: F.lit(False)
    book_rules: tuple[tuple[str, str], ...] = ()
    capital_titles: bool = False
    fragmentary: bool = False
    walk: alignment.Walk = field(default_factory=alignment.Walk)
    dictionary: dict[str, str] | None = None
    least: int = 3


def transcript(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (version, pos, word, raw, norm, page, line, line_no) and lines (version, line_no, page, line, text, markdown, source, spoken) (L1).

    raw: version, page, pos, line, text, markdown, source. Words without letters and digits are left out, but count as places
    in the line; spoken: whether a line has any other.
    """
    at = F.row_number().over(Window.partitionBy("version").orderBy("page", "pos")).cast("long")
    words = F.transform(T.white_words(F.coalesce("text", F.lit(""))), lambda w: F.struct(w.alias("raw"), T.transcript_word(w).alias("norm")))
    rows = raw.select("version", at.alias("line_no"), "page", "line", "text", "markdown", "source", words.alias("w"))
    lines = rows.withColumn("spoken", F.exists("w", lambda x: x["norm"] != "")).drop("w")
    each = rows.select("version", "line_no", "page", "line", F.posexplode("w").alias("word", "x")).where("x.norm <> ''")
    return each.select("version", (F.col("line_no") * LINE_WORDS + F.col("word")).alias("pos"), "word", "x.raw", "x.norm", "page", "line", "line_no"), lines


def canon_of(verses: DataFrame, order: list[str]) -> DataFrame:
    """ord, book, chapter, verse, text, norms of the verses with words, books in the order given, others left out.

    verses: book, chapter, pos, verse, text.
    """
    norms = F.filter(F.transform(T.white_words(F.coalesce("text", F.lit(""))), T.canon_word), lambda w: w != "")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("book"))
    rows = verses.select("book", "chapter", "pos", "verse", "text", norms.alias("norms"), rank.alias("_rank")).where("_rank > 0 AND size(norms) > 0")
    own = F.row_number().over(Window.partitionBy("book").orderBy("chapter", "pos"))
    books = rows.groupBy("book").agg(F.count("*").alias("_n"), F.min("_rank").alias("_rank"))  # as many rows as books
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = books.select("book", before.alias("_base"))
    return rows.withColumn("_own", own).join(bases, "book").select((F.col("_base") + F.col("_own") - 1).alias("ord"), "book", "chapter", "verse", "text", "norms")


def assigned(words: DataFrame, lines: DataFrame, canon: DataFrame, edition: Edition) -> DataFrame:
    """The words with verse_ord, chapter markers moved to where they belong."""
    if edition.fragmentary:
        found = scaffold.scaffolded(words.select("version", "pos", "norm", "line_no"), canon, least=edition.least)
    else:
        heads = segments.heading_lines(lines.where("spoken").select("version", "line_no", "text"), edition.is_heading, edition.capital_titles).where("heading IS NOT NULL")
        heads = heads.select("version", "line_no", "heading", T.book_of_heading(F.col("heading"), edition.book_rules).alias("book"))
        first = words.join(heads, ["version", "line_no"]).groupBy("version", "line_no").agg(F.min("pos").alias("pos"), F.first("heading").alias("heading"), F.first("book").alias("book"))
        found = alignment.align(words.join(first.drop("line_no"), ["version", "pos"], "left"), canon, edition.walk, edition.dictionary)
    marker = lines.select("version", "line_no", T.is_chapter_marker(F.coalesce("text", F.lit(""))).alias("marker"))
    rows = stored(words.join(found, ["version", "pos"]).join(marker, ["version", "line_no"]).withColumnRenamed("verse_ord", "ord"))
    rows = markers.attach_orphans(markers.push_forward(rows, canon), canon)
    return rows.drop("marker").withColumnRenamed("ord", "verse_ord")


def aligned(raw: DataFrame, verses: DataFrame, order: list[str], edition: Edition = Edition(), overrides: DataFrame | None = None, insertions: DataFrame | None = None) -> DataFrame:
    """version, ord, book, chapter, verse, lines, warnings: the verses of the canon that the source has, in their parts.

    overrides and insertions name verses by book, chapter and verse in place of target and ord.
    """
    words, lines = transcript(raw)
    canon = stored(canon_of(verses, order))
    keys = canon.select("ord", "book", "chapter", "verse")
    rows = assigned(words, lines, canon, edition)
    if overrides is not None:
        rows = alignment.with_overrides(rows, overrides.join(keys, ["book", "chapter", "verse"]).withColumnRenamed("ord", "target"))
    info = lines.groupBy("version", "page", "line").agg(F.min_by(F.struct("text", "markdown", "source"), "line_no").alias("i")).select("version", "page", "line", "i.*")
    parts = stored(output.verse_lines(rows.withColumnRenamed("verse_ord", "ord"), info))
    out = output.verses(output.joined_lines(parts, canon), canon)
    if insertions is None:
        return out.withColumn("warnings", F.array().cast("array<string>"))
    return output.inserted(out, insertions.join(keys, ["book", "chapter", "verse"]).drop("book", "chapter", "verse"))


def align_corpus(spark: SparkSession, raw_root: str, canon_root: str, out: str, order: list[str], canon_version: str, editions: dict[str, Edition], dry: bool = False) -> DataFrame:
    """Aligns the sources named under <raw_root>/<version>/ and writes their verses under `out`, unless dry."""
    canon = corpus.verses(spark, canon_root).where(F.col("version") == canon_version)
    raw = corpus.raw_lines(spark, raw_root)
    parts = [aligned(raw.where(F.col("version") == name), canon, order, edition) for name, edition in editions.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if not dry:
        corpus.write_verses(found.drop("warnings").withColumnRenamed("ord", "pos"), out)
    return found
