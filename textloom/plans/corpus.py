"""Versions compared: pairs of documents, their lines, diffs, statistics, anchors and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import alignment, diffing, review, sequences
from .common import Registry, table

query = Registry()
PAIRS = r"""
WITH d AS (SELECT doc_id, text, substr(text, 1, 40) AS p, length(text) AS n FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
q AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY p ORDER BY n, doc_id) AS b FROM d),
pr AS (SELECT a, b FROM q WHERE b IS NOT NULL),
x AS (SELECT a, b, l.text AS lt, r.text AS rt FROM pr JOIN documents l ON l.doc_id = a JOIN documents r ON r.doc_id = b),
ll AS (SELECT a, b, unnest(string_split(lt, chr(10))) AS t, generate_subscripts(string_split(lt, chr(10)), 1) AS rn FROM x),
rl AS (SELECT a, b, unnest(string_split(rt, chr(10))) AS t, generate_subscripts(string_split(rt, chr(10)), 1) AS rn FROM x),
z AS (SELECT a, b, rn::INTEGER AS rn, coalesce(ll.t, '') AS left_text, coalesce(rl.t, '') AS right_text FROM ll FULL JOIN rl USING (a, b, rn))
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As PAIRS."""
    docs = table(spark, sf_dir, "documents")
    return diffing.line_pairs(docs, diffing.near_pairs(docs))


@query(PAIRS + "SELECT a, b, rn, md5(left_text) AS left_md5, md5(right_text) AS right_md5 FROM z")
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional full outer zip of two versions' lines."""
    return pairs(spark, sf_dir).select("a", "b", "rn", F.md5("left_text").alias("left_md5"), F.md5("right_text").alias("right_md5"))


@query(
    PAIRS
    + f""", t AS (SELECT a, b, rn, left_text, right_text, regexp_extract_all(left_text, '{T.TOKEN}') AS x, regexp_extract_all(right_text, '{T.TOKEN}') AS y FROM z)
SELECT a, b, count(*) AS total_verse_count, count(*) FILTER (x <> y) AS changed_verse_count, sum(len(x))::BIGINT AS left_tokens, sum(len(y))::BIGINT AS right_tokens,
  count(*) FILTER (left_text = '' OR right_text = '') AS one_sided FROM t GROUP BY a, b"""
)
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed and all lines of each pair, native (A1 without the runs, P3)."""
    x, y = T.display_tokens(F.col("left_text")), T.display_tokens(F.col("right_text"))
    t = pairs(spark, sf_dir).withColumns({"x": x, "y": y})
    sums = [F.sum(F.size(c)).cast("long").alias(n) for c, n in (("x", "left_tokens"), ("y", "right_tokens"))]
    empty = (F.col("left_text") == "") | (F.col("right_text") == "")
    return t.groupBy("a", "b").agg(F.count("*").alias("total_verse_count"), F.count_if(F.col("x") != F.col("y")).alias("changed_verse_count"), *sums, F.count_if(empty).alias("one_sided"))


#: The diff by its definition: common ends set aside, the table of common subsequences row by row, and the way back through it.
#: Reads z (a, b, rn, left_text, right_text).
DIFF_STEPS = f""", t AS (SELECT a, b, rn, left_text, right_text, regexp_extract_all(left_text, '{T.TOKEN}') AS x, regexp_extract_all(right_text, '{T.TOKEN}') AS y FROM z),
h AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i]), TRUE), least(len(x), len(y)) + 1) - 1 AS p FROM t WHERE left_text <> right_text),
g AS (SELECT *, coalesce(list_position(list_transform(range(0, least(len(x), len(y)) - p), lambda i: x[len(x) - i] <> y[len(y) - i]), TRUE), least(len(x), len(y)) - p + 1) - 1 AS s FROM h),
m AS (SELECT row_number() OVER () AS id, a, b, rn, p, s, x[p + 1:len(x) - s] AS x, y[p + 1:len(y) - s] AS y FROM g),
c AS (
  SELECT id, 0 AS i, list_transform(range(0, len(y) + 1), lambda j: 0) AS l, x, y FROM m
  UNION ALL
  SELECT id, i + 1, [0] || list_transform(range(1, len(y) + 1), lambda j: list_max(base[1:j])), x, y
  FROM (SELECT *, list_transform(range(1, len(y) + 1), lambda j: CASE WHEN y[j] = x[i + 1] THEN l[j] + 1 ELSE l[j + 1] END) AS base FROM c WHERE i < len(x))
),
w AS (
  SELECT id, len(x) AS i, len(y) AS j, 0 AS step, NULL::VARCHAR AS op, NULL::VARCHAR AS value, x, y FROM m
  UNION ALL
  SELECT id, CASE WHEN op IN ('eq', 'del') THEN i - 1 ELSE i END, CASE WHEN op IN ('eq', 'ins') THEN j - 1 ELSE j END, step + 1, op, CASE WHEN op = 'ins' THEN y[j] ELSE x[i] END, x, y
  FROM (SELECT w.id, w.i, w.j, w.step, w.x, w.y, CASE WHEN w.i > 0 AND w.j > 0 AND w.x[w.i] = w.y[w.j] THEN 'eq' WHEN w.i > 0 AND (w.j = 0 OR up.l[w.j + 1] > here.l[w.j]) THEN 'del' ELSE 'ins' END AS op
    FROM w JOIN c here ON here.id = w.id AND here.i = w.i LEFT JOIN c up ON up.id = w.id AND up.i = w.i - 1 WHERE w.i > 0 OR w.j > 0)
),
n AS (SELECT id, step, op, value, op <> 'eq' AND coalesce(lag(op) OVER (PARTITION BY id ORDER BY step DESC), 'eq') = 'eq' AS begins FROM w WHERE step > 0)
"""
DIFFS = PAIRS.replace("WITH d AS", "WITH RECURSIVE d AS", 1) + DIFF_STEPS


@query(
    DIFFS
    + """, k AS (SELECT id, count(*) FILTER (begins) AS runs FROM n GROUP BY id)
SELECT z.a, z.b, sum(coalesce(runs, 0))::BIGINT AS variant_count, count(*) FILTER (runs > 0) AS changed_verse_count, count(*) AS total_verse_count
FROM z LEFT JOIN m ON m.a = z.a AND m.b = z.b AND m.rn = z.rn LEFT JOIN k USING (id) GROUP BY z.a, z.b HAVING bool_or(left_text <> '') AND bool_or(right_text <> '')"""
)
def variant_stats_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants (runs of changed tokens), changed lines and lines of each pair of versions (D-2, W1, A1)."""
    return diffing.chapter_stats(pairs(spark, sf_dir), ["a", "b"])


_KNOWN = "[" + ", ".join(f"'{min(x)} {max(x)}'" for x in T.VARIANTS) + "]"


def _variant(a: str, b: str) -> str:
    return f"({a} <> {b} AND list_contains({_KNOWN}, least({a}, {b}) || ' ' || greatest({a}, {b})))"


def _letters(words: str) -> str:
    return f"regexp_replace(lower(array_to_string({words}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_PLAIN = "lambda x: lower(regexp_replace(x, '^[^\\p{L}\\p{N}&]+|[^\\p{L}\\p{N}&]+$', '', 'g'))"
_WORD = "regexp_matches(value, '[a-zA-Z&()<]')"


@query(
    DIFFS
    + f""", q5 AS (SELECT id, op, value, sum(begins::INT) OVER (PARTITION BY id ORDER BY step DESC) AS run, step FROM n),
u5 AS (SELECT id, run, count(*) FILTER (NOT {_WORD}) AS signs, coalesce(list(value ORDER BY step DESC) FILTER (op = 'del' AND {_WORD}), []) AS g, coalesce(list(value ORDER BY step DESC) FILTER (op = 'ins' AND {_WORD}), []) AS c FROM q5 WHERE op <> 'eq' GROUP BY id, run),
v5 AS (SELECT *, list_transform(g, {_PLAIN}) AS pg, list_transform(c, {_PLAIN}) AS pc, len(g) > 0 AND len(c) > 0 AND len(g) <> len(c) AND {_letters("g")} = {_letters("c")} AS divided FROM u5),
s5 AS (
  SELECT id, run, 1 AS k, g, c, pg, pc, range(1, len(c) + 1) AS free, []::BIGINT[] AS rest, []::STRUCT(i BIGINT, j BIGINT)[] AS pairs FROM v5 WHERE NOT divided
  UNION ALL
  SELECT id, run, k + 1, g, c, pg, pc, list_filter(free, lambda f: f IS DISTINCT FROM best), CASE WHEN best IS NULL THEN rest || [k::BIGINT] ELSE rest END, CASE WHEN best IS NULL THEN pairs ELSE pairs || [{{'i': k::BIGINT, 'j': best}}] END
  FROM (SELECT *, coalesce(list_filter(free, lambda f: {_variant("pg[k]", "pc[f]")})[1], list_filter(free, lambda f: lower(g[k]) = lower(c[f]))[1]) AS best FROM s5 WHERE k <= len(g))
),
b5 AS (
  SELECT id, run, g, c, pg, pc, pairs, flatten(list_transform(rest, lambda i: list_transform(free, lambda j: {{'s': levenshtein(pg[i], pc[j]) / greatest(length(pg[i]), length(pc[j]), 1), 'i': i, 'j': j}}))) AS near FROM s5 WHERE k = len(g) + 1
  UNION ALL
  SELECT id, run, g, c, pg, pc, pairs || [{{'i': best.i, 'j': best.j}}], list_filter(near, lambda x: x.i <> best.i AND x.j <> best.j) FROM (SELECT *, list_min(near) AS best FROM b5 WHERE len(near) > 0)
),
e5 AS (SELECT id, run, g, c, pg, pc, pairs, unnest(pairs) AS p FROM b5 WHERE len(near) = 0),
k5 AS (
  SELECT id, 'punctuation' AS kind, signs AS n FROM v5
  UNION ALL SELECT id, 'spelling', len(g) + len(c) FROM v5 WHERE divided
  UNION ALL SELECT id, 'omission', len(g) - len(pairs) FROM b5 WHERE len(near) = 0
  UNION ALL SELECT id, 'addition', len(c) - len(pairs) FROM b5 WHERE len(near) = 0
  UNION ALL SELECT id, CASE WHEN lower(g[p.i]) = lower(c[p.j]) THEN 'capitalization' WHEN {_variant("pg[p.i]", "pc[p.j]")} OR greatest(length(pg[p.i]), length(pc[p.j])) >= 5 AND levenshtein(pg[p.i], pc[p.j]) <= 3 AND levenshtein(pg[p.i], pc[p.j]) / greatest(length(pg[p.i]), length(pc[p.j])) <= 0.34 THEN 'spelling' ELSE 'wordChange' END, 2 FROM e5
)
SELECT a, b, kind, sum(k5.n)::BIGINT AS tokens FROM k5 JOIN m USING (id) WHERE k5.n > 0 GROUP BY a, b, kind"""
)
def diff_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed tokens of each pair by kind (D-5, P7)."""
    kinds = diffing.diff_counts(pairs(spark, sf_dir), ["a", "b"]).select("a", "b", F.explode("kinds").alias("kind", "n"))
    return kinds.groupBy("a", "b", "kind").agg(F.sum("n").alias("tokens"))


def _words(n: str) -> str:
    return f"regexp_extract_all(lower({n}), '[a-z0-9]+')"


@query(f"""
WITH b AS (SELECT item_id, {_words('text')} AS w FROM benchmark), d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
bg AS (SELECT item_id, i - 1 AS t, array_to_string(w[i:i+5], ' ') AS ngram FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM b WHERE len(w) >= 6)),
dg AS (SELECT doc_id, i - 1 AS s, array_to_string(w[i:i+5], ' ') AS ngram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 6)),
bu AS (SELECT ngram, min(item_id) AS item_id, min(t) AS t FROM bg GROUP BY ngram HAVING count(*) = 1),
du AS (SELECT ngram, min(doc_id) AS doc_id, min(s) AS s FROM dg GROUP BY ngram HAVING count(*) = 1)
SELECT doc_id, item_id, s::INTEGER AS s, t::INTEGER AS t, ngram FROM bu JOIN du USING (ngram)
""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 6-grams that occur once in all documents and once in all passages.

    Hash aggregates on both sides: n-grams of passages first cut down those of documents, as most occur in none.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    target = sequences.ngrams(table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")), "item_id", "w", 6)
    source = sequences.ngrams(table(spark, sf_dir, "documents").select("doc_id", words.alias("w")), "doc_id", "w", 6)
    source = source.join(target.select("ngram").distinct(), "ngram", "left_semi")
    return sequences.anchors(source, target, "doc_id", "item_id")


@query(f"""
WITH v AS (SELECT DISTINCT unnest({_words('text')}) AS w FROM benchmark),
t AS (SELECT doc_id, unnest({_words('text')}) AS w FROM documents),
c AS (SELECT doc_id, count(*) AS tokens, count(v.w) AS matched FROM t LEFT JOIN v USING (w) GROUP BY doc_id),
p AS (SELECT source, coalesce(tokens, 0) AS tokens, coalesce(matched, 0) AS matched FROM documents LEFT JOIN c USING (doc_id)),
k AS (SELECT source, tokens, matched, CASE WHEN tokens = 0 THEN NULL ELSE matched / tokens END AS r FROM p)
SELECT source, count(*) AS verses, sum(tokens)::BIGINT AS total_tokens, sum(matched)::BIGINT AS matched_tokens,
  CASE WHEN sum(tokens) = 0 THEN 0 ELSE floor(10000 * sum(matched) / sum(tokens) + 0.5)::BIGINT END AS purity_10000,
  count(*) FILTER (r = 0) AS zero, count(*) FILTER (r > 0 AND r < 0.25) AS below_25, count(*) FILTER (r >= 0.25 AND r < 0.5) AS below_50,
  count(*) FILTER (r >= 0.5 AND r < 0.75) AS below_75, count(*) FILTER (r >= 0.75 AND r < 1) AS below_100, count(*) FILTER (r = 1) AS pure
FROM k GROUP BY source
""")
def purity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's tokens that the passages' vocabulary has, by source, in six buckets."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    vocabulary = table(spark, sf_dir, "benchmark").select(F.explode(words("text")).alias("w")).distinct().withColumn("known", F.lit(1))
    docs = table(spark, sf_dir, "documents").select("source", words("text").alias("w"))
    per = review.known_words(docs, vocabulary)
    r = F.when(F.col("tokens") > 0, F.col("matched") / F.col("tokens"))
    per = per.withColumn("r", r)
    ratio = F.when(F.sum("tokens") == 0, F.lit(0)).otherwise(F.floor(10000 * F.sum("matched") / F.sum("tokens") + 0.5)).cast("long")
    buckets = {"zero": "r = 0", "below_25": "r > 0 AND r < 0.25", "below_50": "r >= 0.25 AND r < 0.5", "below_75": "r >= 0.5 AND r < 0.75", "below_100": "r >= 0.75 AND r < 1", "pure": "r = 1"}
    return per.groupBy("source").agg(
        F.count("*").alias("verses"), F.sum("tokens").cast("long").alias("total_tokens"), F.sum("matched").cast("long").alias("matched_tokens"), ratio.alias("purity_10000"),
        *(F.count_if(F.expr(x)).alias(n) for n, x in buckets.items()),
    )


@query(f"""
WITH t AS (SELECT a, b, rn, {_words('left_text')} AS x, {_words('right_text')} AS y FROM ({PAIRS} SELECT * FROM z))
SELECT a, b, rn, len(x)::BIGINT AS words, len(y)::BIGINT AS canon_words, CASE WHEN len(x) < 0.4 * len(y) THEN 'short' ELSE 'long' END AS finding
FROM t WHERE len(y) >= 3 AND (len(x) < 0.4 * len(y) OR len(x) > 2.5 * len(y))
""")
def ratio_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose word count is out of proportion to the other version's."""
    x, y = (F.size(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)).cast("long") for c in ("left_text", "right_text"))
    t = pairs(spark, sf_dir).select("a", "b", "rn", x.alias("words"), y.alias("canon_words")).where("canon_words >= 3 AND (words < 0.4 * canon_words OR words > 2.5 * canon_words)")
    return t.withColumn("finding", F.when(F.expr("words < 0.4 * canon_words"), "short").otherwise("long"))


@query()
def walked_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each conversation by the passage that the cursor walk gives them."""
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    canon = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.lit("passages").alias("book"), split("text").alias("norms"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("version"), "turn", F.posexplode(split("text")).alias("i", "norm"))
    words = turns.select("version", (F.col("turn") * 1_000_000 + F.col("i")).alias("pos"), "norm", F.col("turn").alias("line_no"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("book"))
    return alignment.align(words, canon).groupBy("version", "verse_ord").agg(F.count("*").alias("words"), F.min("pos").alias("first"))


@query()
def alignment_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers audited against the turns before them, as verses against the canon."""
    turns = table(spark, sf_dir, "conversations").withColumn("verse", (F.col("turn") / 2).cast("int"))
    w = Window.partitionBy("conv_id", "role").orderBy("turn", "text")
    turns = turns.withColumn("pos", F.row_number().over(w)).withColumn("book", F.col("conv_id").cast("string")).withColumn("chapter", F.lit(1))
    aligned = turns.where("role = 'assistant'").select(F.col("role").alias("version"), "book", "chapter", "verse", "pos", F.split("text", "\n", -1).alias("lines"))
    canon = turns.where("role = 'user'").select("book", "chapter", "verse", "pos", "text")
    return alignment.report_summary(alignment.chapter_reports(aligned, canon))


@query(f"""
WITH t AS (SELECT conv_id, unnest(regexp_extract_all(text, '{T.TOKEN}')) AS t FROM conversations),
k AS (SELECT conv_id, CASE WHEN t = 'the' THEN 'deleted' WHEN t = 'de' THEN 'unclear' WHEN regexp_matches(t, '^[A-Za-z0-9_]+ti[A-Za-z0-9_]+$') THEN 'inserted' ELSE 'normal' END AS kind FROM t)
SELECT conv_id, kind, count(*) AS tokens, count(*) FILTER (kind = 'inserted') AS mixed FROM k GROUP BY conv_id, kind
""")
def markup_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of marked-up texts by kind (F16): two words struck out or unclear, a part of others inserted; marks leave the tokens as they were."""
    alone = lambda c, word, mark: F.regexp_replace(c, f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", mark)
    marked = alone(alone(F.regexp_replace("text", r"(\w+)ti(\w+)", "$1[ti]$2"), "the", "~~the~~"), "de", "{{de}}")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", marked.alias("m"))
    tokens = alignment.with_markup(rows, "m").select("conv_id", F.explode("markup").alias("t"))
    return tokens.groupBy("conv_id", F.col("t.kind").alias("kind")).agg(F.count("*").alias("tokens"), F.count_if(F.col("t.segments").isNotNull()).alias("mixed"))


QUERIES, ORACLES = query.queries, query.oracles
