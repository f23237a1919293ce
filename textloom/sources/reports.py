"""Files of statistics, chapter reports, suggestions, logs and sitemaps, and the registry of source adapters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import escaped_xml

CHAPTER = "struct<book:string,chapter:int,variantCount:bigint,changedVerseCount:bigint,totalVerseCount:bigint>"
STATS = f"pair struct<v1:string,v2:string>, generatedAt string, chapters array<{CHAPTER}>"


@dataclass(frozen=True)
class Adapter:
    """A source of transcripts and how it is aligned."""

    slug: str
    options: dict = field(default_factory=dict, hash=False)


def registry(adapters: Iterable[Adapter]) -> dict[str, Adapter]:
    """Adapters by slug; a slug that comes twice is an error."""
    out: dict[str, Adapter] = {}
    for a in adapters:
        if a.slug in out:
            raise ValueError(f"two adapters are called {a.slug}")
        out[a.slug] = a
    return out


def stats_record(stats: DataFrame, v1: str, v2: str, generated: str) -> DataFrame:
    """One row of JSON: pair, generatedAt and chapters in reading order (K3). stats: ord, book, chapter and the three counts.

    A row for each chapter of one pair of versions is gathered: thousands, whatever the size of the texts.
    """
    named = F.struct("ord", "book", F.col("chapter").cast("int").alias("chapter"), F.col("variant_count").alias("variantCount"), F.col("changed_verse_count").alias("changedVerseCount"), F.col("total_verse_count").alias("totalVerseCount"))
    chapters = stats.agg(F.array_sort(F.collect_list(named)).alias("c"))
    plain = F.transform("c", lambda x: F.struct(*(x[k].alias(k) for k in ("book", "chapter", "variantCount", "changedVerseCount", "totalVerseCount"))))
    record = F.struct(F.struct(F.lit(v1).alias("v1"), F.lit(v2).alias("v2")).alias("pair"), F.lit(generated).alias("generatedAt"), plain.alias("chapters"))
    return chapters.select(F.to_json(record).alias("value"))


def write_stats(stats: DataFrame, path: str, v1: str, v2: str, generated: str) -> None:
    stats_record(stats, v1, v2, generated).coalesce(1).write.mode("overwrite").text(path)


def read_stats(spark: SparkSession, path: str, v1: str, v2: str) -> DataFrame:
    """(book, chapter, variantCount, changedVerseCount, totalVerseCount); empty where the file is missing, broken or of another pair."""
    try:
        rows = spark.read.schema(STATS).json(path)
    except AnalysisException:
        rows = spark.createDataFrame([], STATS)
    rows = rows.where((F.col("pair.v1") == v1) & (F.col("pair.v2") == v2))
    return rows.select(F.inline("chapters"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder of JSON for each version, book and chapter (K4)."""
    reports.repartition("version", "book", "chapter").write.mode("overwrite").partitionBy("version", "book", "chapter").json(path)


def read_reports(spark: SparkSession, path: str, schema: str, version: str | None = None) -> DataFrame:
    """All chapter reports below a folder (S10); schema: of the columns beside version, book and chapter."""
    rows = spark.read.schema(f"{schema}, version string, book string, chapter int").json(path)
    return rows if version is None else rows.where(F.col("version") == version)


def report_index(summaries: DataFrame) -> DataFrame:
    """The index of reports: most findings first, then by book and chapter."""
    return summaries.orderBy(F.desc("verses_with_findings"), "book", "chapter")


def suggestion_lines(findings: DataFrame, order: list[str]) -> DataFrame:
    """(book, at, line): Markdown of the findings, grouped by book in the order given, by chapter and verse within.

    findings: book, chapter, verse, type, note. A title line comes before those of each book.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("book"))
    place = F.struct(F.when(rank > 0, rank).otherwise(len(order) + 1).alias("rank"), F.col("book"), F.col("chapter").cast("int").alias("chapter"), F.col("verse").cast("int").alias("verse"), F.col("type"), F.col("note"))
    text = F.format_string("- **%s** %d:%d %s", "type", F.col("chapter").cast("int"), F.col("verse").cast("int"), F.coalesce("note", F.lit("")))
    rows = findings.select("book", place.alias("at"), text.alias("line"))
    title = F.struct(F.col("at.rank").alias("rank"), F.col("book"), F.lit(-1).alias("chapter"), F.lit(-1).alias("verse"), F.lit("").alias("type"), F.lit("").alias("note"))
    titles = rows.select("book", title.alias("at")).distinct().withColumn("line", F.concat(F.lit("## "), "book"))
    return rows.unionByName(titles)


def write_suggestions(findings: DataFrame, path: str, order: list[str]) -> None:
    suggestion_lines(findings, order).orderBy("at").select("line").write.mode("overwrite").text(path)


def log_lines(events: DataFrame, level: str = "level") -> DataFrame:
    """(stream, value): each event as JSON, errors for stderr."""
    stream = F.when(F.col(level) == "error", "stderr").otherwise("stdout")
    return events.select(stream.alias("stream"), F.to_json(F.struct(*events.columns)).alias("value"))


def request_log(requests: DataFrame) -> DataFrame:
    """path, status and the duration, rounded half up to milliseconds."""
    return requests.select("path", "status", F.floor(F.col("duration_ms") + 0.5).alias("ms"))


def sitemap_entry(url: Column, date: Column) -> Column:
    """A <url> of a sitemap."""
    return F.concat(F.lit("  <url><loc>"), escaped_xml(url), F.lit("</loc>"), F.when(date.isNotNull(), F.concat(F.lit("<lastmod>"), date, F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))


def write_sitemap(urls: DataFrame, path: str) -> None:
    """The sitemap's XML, addresses in order (K10, R6); urls: ord, url, date. A sitemap has 50,000 addresses at most, so one file holds it."""
    head = urls.sparkSession.sql("SELECT -2 AS ord, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' AS value UNION ALL SELECT -1, '<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' UNION ALL SELECT 2147483647, '</urlset>'")
    rows = urls.select(F.col("ord").cast("int").alias("ord"), sitemap_entry(F.col("url"), F.col("date").cast("string")).alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)


def preview(rows: DataFrame, n: int) -> list:
    """The first rows of a dry run, which writes nothing (K2)."""
    return rows.limit(n).collect()
