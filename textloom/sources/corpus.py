"""Corpora of JSON files, <root>/<version>/<book>/<chapter>.json and <root>/<version>/<page>.json, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

LINE = "struct<id:string,page:int,line:int,text:string,markdown:string,source:string>"
VERSES = f"book string, chapter int, verse int, text string, source string, lines array<{LINE}>"
RAW = "text string, markdown string, chapter int, verse int, source string"


def _part(n: int) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.input_file_name(), r"\.json$", ""), "/"), -n)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each file is an array of records; `pos` keeps their order, in which nothing else is sorted."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumns({"_file": F.input_file_name(), "_order": F.monotonically_increasing_id()})


def verses(spark: SparkSession, root: str) -> DataFrame:
    """version, book, chapter, pos, verse, text, markdown, source, lines (S1-S3, F20): flat and line-wise records alike."""
    df = _read(spark, root, VERSES)
    df = df.withColumns({"version": _part(3), "book": _part(2), "chapter": _part(1).cast("int")})
    pos = F.row_number().over(Window.partitionBy("_file").orderBy("_order"))
    own = F.filter("lines", lambda x: x["text"] != "")
    text = F.when(F.col("lines").isNotNull(), F.array_join(F.transform(own, lambda x: x["text"]), "")).otherwise(F.col("text"))
    marked = F.exists(own, lambda x: x["markdown"].isNotNull())
    markdown = F.when(marked, F.array_join(F.transform(own, lambda x: F.coalesce(x["markdown"], x["text"])), ""))
    source = F.coalesce("source", F.try_element_at("lines", F.lit(1))["source"])
    return df.withColumn("pos", pos).select("version", "book", "chapter", "pos", "verse", text.alias("text"), markdown.alias("markdown"), source.alias("source"), "lines")


def raw_lines(spark: SparkSession, root: str) -> DataFrame:
    """version, page, pos, line, text, markdown, source of page transcripts (S4); pages in numeric order by `page`."""
    df = _read(spark, root, RAW).withColumns({"version": _part(2), "page": _part(1).cast("int")})
    pos = F.row_number().over(Window.partitionBy("_file").orderBy("_order"))
    return df.withColumn("pos", pos).select("version", "page", "pos", F.col("verse").alias("line"), "text", "markdown", "source")


def raw_pages(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (version, page and any other columns) with the entries of that page in order; none where it is missing."""
    entry = F.struct("pos", "line", "text", "markdown", "source")
    pages = raw.join(wanted.select("version", "page").distinct(), ["version", "page"], "left_semi").groupBy("version", "page").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    out = wanted.join(pages, ["version", "page"], "left")
    return out.withColumn("entries", F.coalesce("entries", F.slice(F.array(F.lit(None).cast(dict(pages.dtypes)["entries"][6:-1])), 1, 0)))


def versions(verses: DataFrame, known: list[str]) -> DataFrame:
    """Versions, the known ones in their order, then the others by name."""
    rank = F.array_position(F.array(*map(F.lit, known)), F.col("version")) if known else F.lit(0)
    return verses.select("version").distinct().orderBy(F.when(rank > 0, rank).otherwise(len(known) + 1), "version")


def chapters(verses: DataFrame) -> DataFrame:
    """(version, book, chapter), chapters in numeric order."""
    return verses.select("version", "book", "chapter").distinct().orderBy("version", "book", "chapter")


def write_verses(verses: DataFrame, path: str) -> None:
    """One folder for each version, book and chapter (K1)."""
    rows = verses.repartition("version", "book", "chapter").sortWithinPartitions("version", "book", "chapter", "pos")
    rows.write.mode("overwrite").partitionBy("version", "book", "chapter").json(path)
