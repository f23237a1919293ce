"""Wordings within budgets, structured data, and lookups of pages and verses."""

import json

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import titles
from textloom.operators import compare
from textloom.sources import corpus

SITE = titles.Site("Book Compare", "Old Text", "New Text")


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_titles_of_versions(spark):
    long = "x" * 60
    got = one(spark, *(titles.version_title(F.lit(a), F.lit(b), SITE) for a, b in (("First Edition", "1830"), (long, "1830"), (long, long))))
    assert got == ["First Edition — Book Compare", "1830 — Book Compare", long]


def test_counts_and_singulars(spark):
    lit = F.lit
    got = one(spark, titles.things(lit(1), "verse", "verses"), titles.things(lit(12345), "verse", "verses"), titles.chapter_title(lit("Alma"), lit(3), lit(1), SITE), titles.chapter_title(lit("Alma"), lit(3), lit(0), SITE))
    assert got == ["1 verse", "12,345 verses", "Alma 3 — 1 Textual Variant — Book Compare", "Alma 3 — No Textual Variants — Book Compare"]
    books = one(spark, titles.book_description(lit("Alma"), lit(0), lit(1), SITE), titles.book_description(lit("A" * 90), lit(0), lit(2), SITE), titles.book_sentences(lit("Omni"), lit(7), lit(2), lit(1), lit(1), lit(7), SITE), titles.book_sentences(lit("Omni"), lit(0), lit(30), lit(1), lit(1), lit(0), SITE))
    assert books[0] == "Alma has no textual variants between the Old Text and the New Text across its 1 chapter."
    assert books[1] == "A" * 90 + " has no textual variants across its 2 chapters."
    assert books[2][1] == "Its 2 verses carry an average of 4 variants each." and books[3][1].startswith("All 30 of its verses")


def test_structured_data_stands_in_a_script(spark):
    article = titles.structured("Article", site=SITE, site_url="https://x.test", headline=F.lit("a </script><b>"), url=F.lit("https://x.test/1"))
    found = one(spark, titles.graph(article, titles.structured("Organization", site=SITE, site_url="https://x.test")))[0]
    assert "<" not in found
    first, second = json.loads(found)["@graph"]
    assert first["headline"] == "a </script><b>" and first["publisher"] == second and second["logo"] == "https://x.test/logo.svg"


def test_selected_verses(spark):
    rows = [(3, 5), (5, 3), (4, None), (4, 0), (0, 4), (None, 4), (2, 2)]
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a int, f int").orderBy("i").select(T.selected_verses(F.col("a"), F.col("f"))).collect()
    assert [r[0] for r in out] == [[3, 4, 5], [3, 4, 5], [4], [4], [], [], [2]]


def test_raw_pages(spark):
    raw = spark.createDataFrame([("v", 1, 2, 2, "b", None, "s"), ("v", 1, 1, 1, "a", "a~~b~~", "s"), ("v", 2, 1, 1, "c", None, "s")], "version string, page int, pos int, line int, text string, markdown string, source string")
    wanted = spark.createDataFrame([("v", 1, "x"), ("v", 1, "y"), ("v", 9, "z"), ("w", 1, "q")], "version string, page int, tag string")
    got = {r["tag"]: [e["text"] for e in r["entries"]] for r in corpus.raw_pages(raw, wanted).collect()}
    assert got == {"x": ["a", "b"], "y": ["a", "b"], "z": [], "q": []}


def test_specimen(spark):
    rows = [("pm", "alma", 1, 1, 5, "plain", "and ~~it~~ cam[e]"), ("2013", "alma", 1, 1, 5, "and came", None), ("2013", "alma", 1, 2, 6, "x", None)]
    verses = spark.createDataFrame(rows, "version string, book string, chapter int, pos int, verse int, text string, markdown string")
    r = compare.specimen(verses, "pm", "2013", "alma", 1, 5).first()
    assert [t["value"] for t in r["left"]] == ["and", "it", "came"] and [t["op"] for t in r["right"]] == ["eq", "eq"]
    assert compare.specimen(verses, "pm", "2013", "alma", 1, 6).count() == 0


def test_overlay_of_marked_text(spark):
    from textloom.operators import alignment

    tokens = spark.createDataFrame([("k", i, w) for i, w in ((2, "go"), (5, "down"), (9, "end"))], "k string, place int, value string")
    marked = alignment.with_markup(spark.createDataFrame([("k", "go dow[n]")], "k string, text string"), "text")
    out = compare.overlaid(tokens, marked, ["k"]).orderBy("place").collect()
    assert [r["markup"]["kind"] if r["markup"] else None for r in out] == ["normal", "inserted", None]
