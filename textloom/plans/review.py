"""Boundary findings, whole-chapter diffs and chapter markers over the driver's tables.

A chapter is a pair of versions (a, b) and its verses are lines; for markers a version is a supplier and a line an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import compare, diffing, markers, review
from .common import Registry, table
from .corpus import PAIRS, _words, pairs

query = Registry()
KEYS = ["a", "b"]
_STOP = "[" + ", ".join(f"'{w}'" for w in review.STOP_WORDS) + "]"


def _verses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = pairs(spark, sf_dir)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    aligned = rows.select(*KEYS, F.col("rn").alias("verse"), words("left_text").alias("words"), F.array("left_text").alias("lines"))
    return aligned, rows.select(*KEYS, F.col("rn").alias("verse"), words("right_text").alias("words"))


@query(
    PAIRS
    + f""", w AS (SELECT a, b, rn AS verse, {_words('left_text')} AS x, {_words('right_text')} AS c FROM z),
vo AS (SELECT a, b, list(DISTINCT t) AS vocab FROM (SELECT a, b, unnest(c) AS t FROM w) GROUP BY a, b),
r AS (SELECT w.a, w.b, w.verse, w.x, w.c, n.c AS after, p.c AS before, n.x AS next_x, coalesce(vocab, []) AS vocab FROM w
  LEFT JOIN w n ON n.a = w.a AND n.b = w.b AND n.verse = w.verse + 1 LEFT JOIN w p ON p.a = w.a AND p.b = w.b AND p.verse = w.verse - 1 LEFT JOIN vo ON vo.a = w.a AND vo.b = w.b),
t AS (SELECT *, list_filter(x[-5:], lambda u: list_contains(after[:5], u) AND list_contains(vocab, u)) AS tr,
  CASE WHEN verse > 1 THEN list_filter(x[:5], lambda u: list_contains(before[-5:], u) AND list_contains(vocab, u)) END AS le,
  CASE WHEN verse > 1 AND before IS NOT NULL AND len(x) >= 2 AND len(c) >= 2 AND x[1] <> c[1] AND list_contains(vocab, x[1]) AND NOT list_contains({_STOP}, x[1])
    THEN len(list_filter([1, 2, 3, 4], lambda i: i < len(x[:5]) AND i <= len(c[:5]) AND x[i + 1] = c[i])) END AS sa FROM r),
u AS (SELECT *, CASE WHEN after IS NOT NULL AND len(list_filter(tr, lambda q: NOT list_contains({_STOP}, q))) > 0 THEN tr END AS trail FROM t),
m AS (SELECT *, lag(trail) OVER (PARTITION BY a, b ORDER BY verse) AS prior FROM u),
f AS (SELECT a, b, verse, verse + 1 AS into_verse, 'trailing-bleed' AS type, trail AS tokens, len(trail) AS score, 0 AS place FROM m
    WHERE trail IS NOT NULL AND len(list_filter(coalesce(next_x, [])[:5], lambda q: list_contains(c[-5:], q) AND list_contains(trail, q))) = 0
  UNION ALL SELECT a, b, verse, verse - 1, 'leading-bleed', le, len(le), 1 FROM m WHERE before IS NOT NULL AND len(list_filter(le, lambda q: NOT list_contains({_STOP}, q))) > 0 AND NOT coalesce(list_has_any(le, prior), false)
  UNION ALL SELECT a, b, verse, verse - 1, 'leading-bleed', x[:1], sa, 2 FROM m WHERE sa >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY a, b, verse, into_verse ORDER BY score DESC, verse, place) AS k FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, verse, place) AS k2 FROM o WHERE k = 1)
SELECT a, b, verse, into_verse, type, array_to_string(tokens, ' ') AS tokens, score::INTEGER AS score FROM g WHERE k2 <= 2"""
)
def boundary_bleeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that belong to the neighbouring line, the two best findings of a pair of versions."""
    found = review.top_bleeds(review.bleeds(*_verses(spark, sf_dir), KEYS), KEYS)
    return found.select(*KEYS, "verse", F.col("into").alias("into_verse"), "type", F.array_join("tokens", " ").alias("tokens"), F.col("score").cast("int").alias("score"))


@query(
    PAIRS
    + f""", w AS (SELECT a, b, rn AS verse, {_words('left_text')} AS x, {_words('right_text')} AS c FROM z),
n AS (SELECT a, b, verse, x[-1] AS last, lead(verse) OVER q AS next_verse, lead(x[1]) OVER q AS first FROM w WINDOW q AS (PARTITION BY a, b ORDER BY verse)),
v AS (SELECT DISTINCT a, b, unnest(c) AS t FROM w)
SELECT n.a, n.b, verse, next_verse, last || first AS joined FROM n JOIN v ON v.a = n.a AND v.b = n.b AND v.t = last || first"""
)
def split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words divided between two lines (Q11)."""
    return review.split_words(*_verses(spark, sf_dir), KEYS)


@query(
    PAIRS
    + f""", w AS (SELECT a, b, rn AS verse, left_text, {_words('right_text')} AS c,
  regexp_replace(regexp_replace(replace(lower(regexp_extract(trim(left_text), '^\\S+')), '&', 'and'), '~~.*?~~', '', 'g'), '[^a-z0-9]', '', 'g') AS fragment FROM z),
v AS (SELECT DISTINCT a, b, unnest(c) AS t FROM w)
SELECT a, b, verse, 'trailing-ampersand' AS type, NULL AS fragment FROM w WHERE regexp_matches(left_text, '(?:^|\\s)&\\s*$')
UNION ALL SELECT w.a, w.b, verse, 'leading-fragment', fragment FROM w WHERE fragment <> '' AND length(fragment) < 3 AND NOT EXISTS (SELECT 1 FROM v WHERE v.a = w.a AND v.b = w.b AND v.t = fragment)"""
)
def boundary_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end with a lone & or begin with a piece of a word (Q12)."""
    return review.boundary_artefacts(*_verses(spark, sf_dir), KEYS, T.transcript_word)


_SIDES = PAIRS + f""", s AS (SELECT a, b, rn, 'left' AS side, regexp_extract_all(left_text, '{T.TOKEN}') AS x FROM z UNION ALL SELECT a, b, rn, 'right', regexp_extract_all(right_text, '{T.TOKEN}') FROM z)
SELECT a, b, rn, side, len(x)::BIGINT AS tokens, md5(array_to_string(x, ' ')) AS words_md5 FROM s WHERE len(x) > 0"""


@query(_SIDES)
def verse_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each line, read back from its diff (D-1, D-2, P6)."""
    rows = diffing.with_diff(pairs(spark, sf_dir), kinds=False)
    sides = F.array(*(F.struct(F.lit(n).alias("side"), F.transform(compare.side(F.col("tokens"), absent), lambda t: t["value"]).alias("x")) for n, absent in (("left", "ins"), ("right", "del"))))
    out = rows.select("a", "b", "rn", F.inline(sides)).where(F.size("x") > 0)
    return out.select("a", "b", "rn", "side", F.size("x").cast("long").alias("tokens"), F.md5(F.array_join("x", " ")).alias("words_md5"))


@query(_SIDES)
def chapter_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each line, read back from one diff of whole texts that is cut into lines again (D-3, P6)."""
    docs = table(spark, sf_dir, "documents")
    verses = lambda c, n: docs.select(F.col("doc_id").alias(c), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias(n))
    both = diffing.near_pairs(docs).join(verses("a", "left"), "a").join(verses("b", "right"), "b").select("a", "b", "left", "right")
    rows = compare.chapter_verses(both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b")).select("a", "b", F.inline("sides"))
    return rows.select("a", "b", F.col("verse").alias("rn"), "side", F.size("values").cast("long").alias("tokens"), F.md5(F.array_join("values", " ")).alias("words_md5"))


_MARKED = """
WITH c AS (SELECT c_custkey AS ord, c_nationkey AS book, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 4 AS chapter,
  (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4 AS verse FROM customer),
w AS (SELECT l_suppkey AS version, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS pos, l_orderkey AS line, o_orderpriority = '1-URGENT' AS marker, o_custkey AS ord
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
n AS (SELECT w.*, c.book, c.chapter, c.verse, lag(w.ord) OVER q AS before, lead(w.ord) OVER q AS after FROM w LEFT JOIN c USING (ord) WINDOW q AS (PARTITION BY version ORDER BY pos)),
l AS (SELECT version, line, arg_min(before, pos) FILTER (before IS NOT NULL OR pos = 1) AS before, arg_min(ord, pos) AS first, max_by(after, pos) AS after, min(ord) AS low, max(ord) AS high FROM n WHERE marker GROUP BY version, line),
"""


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    canon = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_nationkey").alias("book"), F.floor(nth / 4).alias("chapter"), (nth % 4).alias("verse"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    words = lines.select(F.col("l_suppkey").alias("version"), pos.alias("pos"), F.lit(1).alias("page"), F.col("l_orderkey").alias("line"), (F.col("o_orderpriority") == "1-URGENT").alias("marker"), F.col("o_custkey").alias("ord"))
    return words, canon


@query(
    _MARKED
    + """x AS (SELECT book, chapter, min(ord) AS b0 FROM c GROUP BY book, chapter), y AS (SELECT *, lead(b0) OVER (PARTITION BY book ORDER BY b0) AS b1 FROM x),
t AS (SELECT l.version, l.line, CASE WHEN lo.book = hi.book AND lo.chapter < hi.chapter THEN y.b0 WHEN l.after IS NOT NULL AND NOT (af.book IS NOT DISTINCT FROM hi.book AND af.chapter IS NOT DISTINCT FROM hi.chapter) THEN y.b1 END AS target
  FROM l JOIN c lo ON lo.ord = l.low JOIN c hi ON hi.ord = l.high LEFT JOIN c af ON af.ord = l.after LEFT JOIN y ON y.book = hi.book AND y.chapter = hi.chapter)
SELECT w.version, pos, CASE WHEN marker THEN coalesce(target, ord) ELSE ord END AS ord FROM w LEFT JOIN t ON t.version = w.version AND t.line = w.line"""
)
def pushed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker lines moved to the chapter that they begin."""
    return markers.push_forward(*_marked(spark, sf_dir)).select("version", "pos", "ord")


@query(
    _MARKED
    + """t AS (SELECT l.version, l.line, CASE WHEN be.book = fi.book AND be.chapter = fi.chapter AND be.verse = 0 AND fi.verse > 0 THEN l.before END AS target FROM l JOIN c fi ON fi.ord = l.first LEFT JOIN c be ON be.ord = l.before)
SELECT w.version, pos, CASE WHEN marker THEN coalesce(target, ord) ELSE ord END AS ord FROM w LEFT JOIN t ON t.version = w.version AND t.line = w.line"""
)
def attached_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker lines after a title given back to it."""
    return markers.attach_orphans(*_marked(spark, sf_dir)).select("version", "pos", "ord")


QUERIES, ORACLES = query.queries, query.oracles
