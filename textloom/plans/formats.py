"""Formatting, JSON and set operators over small dimensions and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions import titles
from .common import Registry, table

query = Registry()


@query("""
SELECT conv_id, turn, 'Conversation ' || conv_id || ':' || turn AS title, role AS version, length(text)::INTEGER AS n FROM conversations
""")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as Markdown with a fenced JSON block and read back from the last block."""
    c = table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct("conv_id", "turn", F.col("role").alias("version"), F.length("text").alias("n")))
    title = F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    fence = "\n```json\n"
    body = F.concat(F.lit("# "), title, F.lit(fence + '{"conv_id": -1}\n```\n'), F.substring("text", 1, 80), F.lit(fence), record, F.lit("\n```"))
    found = F.try_element_at(F.regexp_extract_all(body, F.lit("(?s)```json\\n(.*?)\\n```"), 1), F.lit(-1))
    back = c.select(F.regexp_extract(body, "^# ([^\\n]*)", 1).alias("title"), F.from_json(found, "conv_id long, turn long, version string, n int").alias("r"))
    return back.select("r.conv_id", "r.turn", "title", "r.version", "r.n")


@query("""
WITH t AS (SELECT p_partkey, p_name || ' by ' || p_brand || ', ' || p_type || ' in size ' || p_size AS a, p_name || ' by ' || p_brand || ', ' || p_type AS b, p_name || ' by ' || p_brand AS c FROM part)
SELECT p_partkey, CASE WHEN length(a) <= 45 THEN a WHEN length(b) <= 40 THEN b ELSE c END AS title FROM t
""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest title that fits its budget."""
    c = F.concat("p_name", F.lit(" by "), "p_brand")
    b = F.concat(c, F.lit(", "), "p_type")
    a = F.concat(b, F.lit(" in size "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.length(a) <= 45, a).when(F.length(b) <= 40, b).otherwise(c).alias("title"))


@query("""
WITH m AS (SELECT o_custkey, list_sort(list(DISTINCT month(o_orderdate)) FILTER (o_orderstatus = 'F')) AS f, list_sort(list(DISTINCT month(o_orderdate)) FILTER (o_orderstatus = 'O')) AS o FROM orders GROUP BY o_custkey),
n AS (SELECT o_custkey, coalesce(f, []) AS f, coalesce(o, []) AS o FROM m)
SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(f, o))), ',') AS marked, array_to_string(list_filter(f, lambda x: NOT list_contains(o, x)), ',') AS removed, array_to_string(list_filter(f, lambda x: list_contains(o, x)), ',') AS shared FROM n
""")
def mark_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, difference and overlap of two mark sets."""
    months = lambda s: F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == s, F.month("o_orderdate"))))
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(months("F").alias("f"), months("O").alias("o"))
    said = lambda c: F.array_join(F.array_sort(c), ",")
    return n.select("o_custkey", said(F.array_union("f", "o")).alias("marked"), said(F.array_except("f", "o")).alias("removed"), said(F.array_intersect("f", "o")).alias("shared"))


@query("""
WITH f AS (SELECT DISTINCT o_custkey, month(o_orderdate) AS v, CASE WHEN o_orderstatus = 'F' THEN 'trailing' ELSE 'leading' END AS side FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT o_custkey, v::INTEGER AS v, side FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.o_custkey = f.o_custkey AND g.side <> f.side AND g.v = CASE WHEN f.side = 'trailing' THEN f.v + 1 ELSE f.v - 1 END)
""")
def one_sided_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary findings without a mirrored one on the other side (U6): an anti join on the boundary."""
    side = F.when(F.col("o_orderstatus") == "F", "trailing").otherwise("leading")
    f = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')").select("o_custkey", F.month("o_orderdate").alias("v"), side.alias("side")).distinct()
    edge = F.when(F.col("side") == "trailing", F.col("v")).otherwise(F.col("v") - 1)
    f = f.withColumn("edge", edge)
    mirror = f.select("o_custkey", "edge", F.when(F.col("side") == "trailing", "leading").otherwise("trailing").alias("side"))
    return f.join(mirror, ["o_custkey", "edge", "side"], "left_anti").select("o_custkey", "v", "side")


@query("""
SELECT n_nationkey, '/' || lower(replace(n_name, ' ', '-')) || '/' || (n_nationkey % 7 + 1) || '?v1=' || url_encode(r_name) || '&v2=' || url_encode(n_name) AS href FROM nation JOIN region ON r_regionkey = n_regionkey
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with encoded versions."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    encoded = lambda c: F.replace(F.url_encode(F.col(c)), F.lit("+"), F.lit("%20"))
    slug = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    return n.select("n_nationkey", F.concat(F.lit("/"), slug, F.lit("/"), (F.col("n_nationkey") % 7 + 1).cast("string"), F.lit("?v1="), encoded("r_name"), F.lit("&v2="), encoded("n_name")).alias("href"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM conversations)
SELECT conv_id, count(*) AS crumbs, string_agg(i || ':' || role, '>' ORDER BY i) AS trail FROM c GROUP BY conv_id
""")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails with positions from 1, through JSON."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    items = F.transform("r", lambda x, i: F.struct((i + 1).alias("position"), x["role"].alias("name")))
    back = F.from_json(F.to_json(F.struct(items.alias("itemListElement"))), "itemListElement array<struct<position:int,name:string>>")["itemListElement"]
    trail = F.array_join(F.transform(back, lambda x: F.concat_ws(":", x["position"].cast("string"), x["name"])), ">")
    return c.select("conv_id", F.size("r").cast("long").alias("crumbs"), trail.alias("trail"))


SITE = titles.Site("Comparison of Old Books", "Draft of the Printer", "Edition of Today")
_STATS = """
WITH c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'First' WHEN 'O' THEN 'Other' ELSE 'The Book of Pending and of Many More Things to Come' END AS book, month(o_orderdate)::INTEGER AS chapter,
  count(*) FILTER (o_totalprice > 200000) * CASE WHEN month(o_orderdate) = 7 THEN 0 ELSE 1 END AS n, count(*) AS v FROM orders GROUP BY o_orderstatus, month(o_orderdate)),
s AS (SELECT *, format('{:,}', n) AS ns, format('{:,}', v) || CASE WHEN v = 1 THEN ' verse' ELSE ' verses' END AS vs, CASE WHEN n = 1 THEN '' ELSE 's' END AS e FROM c)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("o_orderstatus") == "F", "First").when(F.col("o_orderstatus") == "O", "Other").otherwise("The Book of Pending and of Many More Things to Come")
    c = table(spark, sf_dir, "orders").groupBy(names.alias("book"), F.month("o_orderdate").alias("chapter")).agg(F.count_if(F.col("o_totalprice") > 200000).alias("n"), F.count("*").alias("v"))
    return c.withColumn("n", F.when(F.col("chapter") == 7, 0).otherwise(F.col("n")).cast("long"))


@query(
    _STATS
    + """, t AS (SELECT *, CASE WHEN n = 0 THEN book || ' ' || chapter || ' — No Textual Variants' ELSE book || ' ' || chapter || ' — ' || ns || ' Textual Variant' || e END AS core,
  CASE WHEN n = 0 THEN book || ' ' || chapter || ' has no textual variants between the Draft of the Printer and the Edition of Today across its ' || vs ELSE book || ' ' || chapter || ' has ' || ns || ' textual variant' || e || ' across its ' || vs || ' between the Draft of the Printer and the Edition of Today' END AS body FROM s)
SELECT book, chapter, CASE WHEN length(core || ' — Comparison of Old Books') <= 60 THEN core || ' — Comparison of Old Books' ELSE core END AS title,
  CASE WHEN length(body || ', including spelling and punctuation.') <= 155 THEN body || ', including spelling and punctuation.' ELSE body || '.' END AS description,
  CASE WHEN n = 0 THEN 'No textual variants between the Draft of the Printer and the Edition of Today in this chapter.' ELSE ns || ' textual variant' || e || ' across ' || vs || ' between the Draft of the Printer and the Edition of Today, including spelling, capitalization, and punctuation.' END AS sentence FROM t"""
)
def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, descriptions and sentences of chapters, the longest wording that fits."""
    book, chapter, n, v = (F.col(c) for c in ("book", "chapter", "n", "v"))
    return _stats(spark, sf_dir).select("book", "chapter", titles.chapter_title(book, chapter, n, SITE).alias("title"), titles.chapter_description(book, chapter, n, v, SITE).alias("description"), titles.chapter_sentence(n, v, SITE).alias("sentence"))


@query(
    _STATS
    + """, b AS (SELECT book, sum(n)::BIGINT AS n, sum(v)::BIGINT AS v, count(*) AS k, max(n) AS m, arg_max(chapter, n * 100 - chapter) AS busy FROM c GROUP BY book),
f AS (SELECT *, book || ' has ' || format('{:,}', n) || ' textual variant' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' across ' || k || CASE WHEN k = 1 THEN ' chapter' ELSE ' chapters' END AS head FROM b),
g AS (SELECT *, head || ', compared verse by verse between the Draft of the Printer and the Edition of Today.' AS whole, book || ' — Textual Variants by Chapter' AS core FROM f),
h AS (SELECT *, CASE WHEN length(whole) <= 155 THEN whole ELSE head || '.' END AS description, CASE WHEN length(core || ' — Comparison of Old Books') <= 60 THEN core || ' — Comparison of Old Books' ELSE core END AS title FROM g)
SELECT book, title, description, book || ' carries ' || format('{:,}', n) || ' textual variants across ' || k || ' chapters when the Draft of the Printer is set against the Edition of Today, including spelling, capitalization, and punctuation. Chapter ' || busy || ' varies most, with ' || format('{:,}', m)
  || '; across the book that is an average of ' || format('{:,}', floor(n / k + 0.5)::BIGINT) || ' variants per chapter.' AS sentences,
  '{"@context":"https://schema.org","@graph":[{"@type":"CollectionPage","name":"' || title || '","description":"' || description || '","url":"https://example.org/\\u003c' || book || '"}]}' AS json_ld FROM h"""
)
def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, descriptions, sentences and structured data of books."""
    best = F.max_by(F.col("chapter"), F.struct("n", -F.col("chapter")))
    b = _stats(spark, sf_dir).groupBy("book").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.count("*").alias("k"), F.max("n").alias("m"), best.alias("busy"))
    book, n, v, k, m, busy = (F.col(c) for c in ("book", "n", "v", "k", "m", "busy"))
    b = b.withColumns({"title": titles.book_title(book, SITE), "description": titles.book_description(book, n, k, SITE), "sentences": F.array_join(titles.book_sentences(book, n, v, k, busy, m, SITE), " ")})
    page = titles.structured("CollectionPage", site=SITE, site_url="https://example.org", name=F.col("title"), description=F.col("description"), url=F.concat(F.lit("https://example.org/<"), book))
    return b.select("book", "title", "description", "sentences", titles.graph(page).alias("json_ld"))


@query("""
WITH e AS (SELECT event_id, (user_id % 9)::INTEGER AS a, CASE WHEN event_type = 'view' THEN NULL ELSE (event_id % 7)::INTEGER END AS f FROM events)
SELECT event_id, CASE WHEN a = 0 THEN '' WHEN coalesce(f, 0) = 0 THEN a::STRING ELSE array_to_string(range(least(a, f), greatest(a, f) + 1), ',') END AS verses FROM e
""")
def verse_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses between the two ends of a selection."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 9).cast("int").alias("a"), F.when(F.col("event_type") != "view", F.col("event_id") % 7).cast("int").alias("f"))
    return e.select("event_id", F.array_join(T.selected_verses(F.col("a"), F.col("f")).cast("array<string>"), ",").alias("verses"))


QUERIES, ORACLES = query.queries, query.oracles
