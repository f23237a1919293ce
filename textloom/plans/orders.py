"""Ordered, keyed and set operators over the star schema: orders stand for chapters, lines for verses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import sequences
from .common import Registry, table

query = Registry()


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS c FROM lineitem),
p AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, c), false) AS b FROM l)
SELECT l_orderkey, sum((c AND NOT b)::INTEGER)::BIGINT AS runs FROM p GROUP BY l_orderkey
""")
def changed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of changed rows."""
    lines = table(spark, sf_dir, "lineitem").withColumn("c", F.col("l_returnflag") == "R")
    return sequences.runs(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "c"], F.col("c"))


@query("""
WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN event_id END AS v FROM events)
SELECT event_id, user_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS assigned FROM e
""")
def assignment_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unassigned rows take the last assignment, leading ones the first."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("v"))
    return sequences.filled(e, ["user_id"], ["event_id"], "v", "assigned").select("event_id", "user_id", "assigned")


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type = 'purchase' AS kept FROM events),
n AS (SELECT *, max(CASE WHEN kept THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS b,
  min(CASE WHEN kept THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT user_id, event_id, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN a - pos < pos - b THEN a ELSE b END AS near FROM n
""")
def nearest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's nearer kept neighbour, the earlier on ties."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).cast("long").alias("pos"))
    return sequences.nearest_kept(e, ["user_id"], ["pos"], "pos", F.col("event_type") == "purchase", "near").select("user_id", "event_id", "near")


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, CASE WHEN event_type = 'signup' THEN 3 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 5 * (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) % 4) END AS t FROM events),
k AS (SELECT user_id, pos, t, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY user_id) AS n,
  lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS np, lead(t) OVER (PARTITION BY user_id ORDER BY pos) AS nt, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS pp, lag(t) OVER (PARTITION BY user_id ORDER BY pos) AS pt FROM e WHERE t IS NOT NULL),
s AS (SELECT *, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE (nt - t)::DOUBLE / (np - pos) END AS ahead, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE (t - pt)::DOUBLE / (pos - pp) END AS behind FROM k),
f AS (SELECT user_id, pos, t, ahead FROM s WHERE i = 1), g AS (SELECT user_id, pos, t, behind FROM s WHERE i = n),
j AS (SELECT e.user_id, e.event_id, e.pos, e.t AS own, (SELECT max(s.pos) FROM s WHERE s.user_id = e.user_id AND s.pos <= e.pos) AS at FROM e)
SELECT j.user_id, j.event_id, floor(0.5 + CASE WHEN own IS NOT NULL THEN own WHEN j.at IS NULL THEN f.t - (f.pos - j.pos) * f.ahead
  WHEN s.np IS NULL THEN g.t + (j.pos - g.pos) * g.behind ELSE s.t + (j.pos - s.pos) * (s.nt - s.t)::DOUBLE / (s.np - s.pos) END)::BIGINT AS target
FROM j LEFT JOIN s ON s.user_id = j.user_id AND s.pos = j.at LEFT JOIN f ON f.user_id = j.user_id LEFT JOIN g ON g.user_id = j.user_id
""")
def interpolated_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions between anchors, as-of joined by windows."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    own = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("pos"), F.row_number().over(own).alias("k"))
    e = e.withColumn("t", F.when(F.col("event_type") == "signup", 3 * F.col("pos") + 5 * (F.col("k") % 4)))
    return sequences.interpolated(e, ["user_id"], "pos", "t", "target").select("user_id", "event_id", F.col("target").cast("long").alias("target"))


@query("""
WITH g AS (SELECT o_orderstatus AS book, o_orderpriority AS chapter, count(*) AS variants, count(*) FILTER (o_totalprice > 150000) AS changed FROM orders GROUP BY ALL)
SELECT book, chapter, sum(variants)::BIGINT AS variants, sum(changed)::BIGINT AS changed, floor(sum(variants)::DOUBLE / count(*) + 0.5)::BIGINT AS average FROM g GROUP BY ROLLUP (book, chapter)
""")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter, book and corpus totals with half-up averages in one rollup (A1, A2, A4)."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("book"), F.col("o_orderpriority").alias("chapter"))
    g = g.agg(F.count("*").alias("variants"), F.count_if(F.col("o_totalprice") > 150000).alias("changed"))
    average = T.rounded(F.sum("variants") / F.count("*")).cast("long")
    return g.rollup("book", "chapter").agg(F.sum("variants").alias("variants"), F.sum("changed").alias("changed"), average.alias("average"))


@query("""
WITH g AS (SELECT o_orderstatus AS book, month(o_orderdate) AS chapter, count(*) AS variants FROM orders GROUP BY ALL)
SELECT book, chapter::INTEGER AS chapter, variants, printf('%d', variants) || CASE WHEN variants = 1 THEN ' variant' ELSE ' variants' END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY book ORDER BY variants DESC, chapter) AS rn FROM g) WHERE rn = 1
""")
def busiest_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter with most variants, the first on ties, with a label."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("book"), F.month("o_orderdate").alias("chapter")).agg(F.count("*").alias("variants"))
    best = sequences.top(g, ["book"], [F.desc("variants"), F.asc("chapter")], 1)
    return best.withColumn("label", F.replace(T.counted(F.col("variants"), "variant", "variants"), F.lit(","), F.lit("")))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, greatest(2.5 / (l_quantity / 20), (l_quantity / 20) / 0.4) AS score FROM lineitem WHERE l_quantity > 0)
SELECT l_orderkey, l_linenumber, l_suppkey, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_suppkey) AS rn FROM s) WHERE rn <= 2
""")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two strongest findings of each chapter."""
    r = F.col("l_quantity") / 20
    s = table(spark, sf_dir, "lineitem").where("l_quantity > 0").withColumn("score", F.greatest(F.lit(2.5) / r, r / 0.4))
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_linenumber", "l_suppkey")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("l_orderkey", "l_linenumber", "l_suppkey", "rank")


@query("""
WITH o AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation),
e AS (SELECT n_regionkey, max(rn) AS last FROM o GROUP BY n_regionkey)
SELECT o.n_nationkey, coalesce(p.n_name, pb.n_name) AS previous, coalesce(n.n_name, nb.n_name) AS following FROM o
  LEFT JOIN o p ON p.n_regionkey = o.n_regionkey AND p.rn = o.rn - 1 LEFT JOIN o n ON n.n_regionkey = o.n_regionkey AND n.rn = o.rn + 1
  LEFT JOIN e ON e.n_regionkey = o.n_regionkey - 1 LEFT JOIN o pb ON pb.n_regionkey = o.n_regionkey - 1 AND pb.rn = e.last AND o.rn = 1
  LEFT JOIN e me ON me.n_regionkey = o.n_regionkey LEFT JOIN o nb ON nb.n_regionkey = o.n_regionkey + 1 AND nb.rn = 1 AND o.rn = me.last
""")
def adjacent_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours within a book, else the last or first of the book right beside it."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = n.withColumns({"_p": F.lag("n_name").over(w), "_n": F.lead("n_name").over(w)})
    ends = n.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("_first"), F.max_by("n_name", "n_nationkey").alias("_last"))
    before = ends.select((F.col("n_regionkey") + 1).alias("n_regionkey"), "_last")
    after = ends.select((F.col("n_regionkey") - 1).alias("n_regionkey"), "_first")
    out = n.join(before, "n_regionkey", "left").join(after, "n_regionkey", "left")
    return out.select("n_nationkey", F.coalesce("_p", "_last").alias("previous"), F.coalesce("_n", "_first").alias("following"))


@query("""
WITH g AS (SELECT n_regionkey AS book, unnest(range(1, 13)) AS chapter FROM (SELECT DISTINCT n_regionkey FROM nation)),
s AS (SELECT n_regionkey AS book, month(o_orderdate) AS chapter, count(*) AS variants FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT g.book, g.chapter::INTEGER AS chapter, s.variants FROM g LEFT JOIN s ON s.book = g.book AND s.chapter = g.chapter
""")
def chapter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter of every book, with its statistics where there are some."""
    nation = table(spark, sf_dir, "nation")
    grid = nation.select(F.col("n_regionkey").alias("book")).distinct().withColumn("chapter", F.explode(F.sequence(F.lit(1), F.lit(12))))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("book"), F.month("o_orderdate").alias("chapter")).agg(F.count("*").alias("variants"))
    return grid.join(s, ["book", "chapter"], "left")


@query("""
WITH u AS (SELECT 1 AS part, '/' AS url UNION ALL SELECT 2, '/versions/' || lower(r_name) FROM region UNION ALL SELECT 3, '/' || lower(replace(n_name, ' ', '-')) FROM nation
  UNION ALL SELECT 4, '/' || lower(replace(n_name, ' ', '-')) || '/' || c FROM nation, (SELECT unnest(range(1, 1 + 5)) AS c))
SELECT part, url, '<url><loc>https://example.org' || url || '</loc></url>' AS xml FROM u
""")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static, version, book and chapter addresses in one list."""
    slug = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    parts = [spark.range(1).select(F.lit("/").alias("url")), region.select(F.concat(F.lit("/versions/"), F.lower("r_name")).alias("url")), nation.select(F.concat(F.lit("/"), slug).alias("url"))]
    chapters = nation.select(slug.alias("s"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("c"))
    parts.append(chapters.select(F.concat(F.lit("/"), "s", F.lit("/"), F.col("c").cast("string")).alias("url")))
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i + 1))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("xml", F.concat(F.lit("<url><loc>https://example.org"), "url", F.lit("</loc></url>")))


@query("""
WITH v AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders),
r AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS marks FROM v WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT v.o_orderkey, v.o_custkey FROM v JOIN r USING (o_custkey) WHERE v.o_orderstatus = 'O' AND list_contains(r.marks, v.o_orderpriority)
""")
def duplicate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open reports whose marks overlap those of an earlier one of the same chapter (J14, P5): a semi join."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    known = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority").distinct()
    return o.where("o_orderstatus = 'O'").join(known, ["o_custkey", "o_orderpriority"], "left_semi").select("o_orderkey", "o_custkey")


@query("""
WITH ov AS (SELECT row_number() OVER (ORDER BY c_custkey) AS idx, c_nationkey AS page, c_custkey % 4 + 1 AS line, c_custkey AS target FROM customer),
w AS (SELECT l_orderkey, l_linenumber, l_suppkey % 25 AS page, l_linenumber AS line, l_partkey FROM lineitem),
b AS (SELECT page, line, arg_max(target, idx) AS target FROM ov GROUP BY page, line)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(b.target, -1)::BIGINT AS assigned FROM w LEFT JOIN b ON b.page = w.page AND b.line = w.line
""")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments replaced by overrides of (page, line), the last one winning.

    Overrides are reduced to one for each place first; a hint would only repeat what the planner sees from sizes.
    """
    ov = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").cast("long").alias("page"), (F.col("c_custkey") % 4 + 1).cast("long").alias("line"))
    best = ov.groupBy("page", "line").agg(F.max("idx").alias("target"))
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 25).alias("page"), F.col("l_linenumber").cast("long").alias("line"))
    return w.join(best, ["page", "line"], "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("target", F.lit(-1)).cast("long").alias("assigned"))


@query("""
WITH n AS (SELECT n_regionkey AS k, lower(n_name) AS w FROM nation), p AS (SELECT DISTINCT a.w AS a, b.w AS b FROM n a JOIN n b ON a.w < b.w AND length(a.w) >= 4 AND length(b.w) >= 4 AND abs(length(a.w) - length(b.w)) <= 2)
SELECT a, b, levenshtein(a, b)::INTEGER AS edits FROM p WHERE levenshtein(a, b) <= 3
""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words within a few edits of each other (J12): an equi-join on the length band, then the bounded distance."""
    w = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("a")).distinct().withColumn("n", F.length("a")).where("n >= 4")
    near = w.select(F.col("a").alias("b"), F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("n"))
    return w.join(near, "n").where("a < b").select("a", "b", F.levenshtein("a", "b", 3).alias("edits")).where("edits >= 0")


@query("""
WITH v AS (SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'both' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'left only'
  WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'right only' ELSE 'neither' END AS extant FROM orders GROUP BY o_custkey)
SELECT extant, count(*) AS chapters FROM v GROUP BY extant
""")
def extant_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two versions has a chapter."""
    has = lambda s: F.max((F.col("o_orderstatus") == s).cast("int")) == 1
    extant = F.when(has("F") & has("O"), "both").when(has("F"), "left only").when(has("O"), "right only").otherwise("neither")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(extant.alias("extant")).groupBy("extant").agg(F.count("*").alias("chapters"))


QUERIES, ORACLES = query.queries, query.oracles
