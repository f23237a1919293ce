"""Text functions over documents, benchmark, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import bans
from .common import Registry, table

query = Registry()
TOKEN = T.TOKEN.replace("'", "''")
#: DuckDB: adjacent ASCII words of the benchmark passages, each pair once.
_VARIANTS = "[" + ", ".join(f"'{min(p)} {max(p)}'" for p in T.VARIANTS) + "]"
ADJACENT = """
WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS i FROM benchmark),
p AS (SELECT DISTINCT a.w AS a, b.w AS b FROM w a JOIN w b ON a.item_id = b.item_id AND b.i = a.i + 1)
"""


def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    arr = table(spark, sf_dir, "benchmark").select(words.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return arr.where(F.size("w") > 1).select(F.explode(pairs).alias("p")).select("p.*").distinct()


@query(f"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5,
  len(list_filter(t, lambda x: NOT regexp_matches(x, '[a-zA-Z&()<]')))::BIGINT AS n_punctuation
FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents)
""")
def display_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.display_tokens(F.col("text")).alias("t"))
    signs = F.size(F.filter("t", T.is_punctuation)).cast("long")
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"), signs.alias("n_punctuation"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n\v\f]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id,
  md5(array_to_string(list_transform(w, lambda x: regexp_replace(regexp_replace(replace(lower(x), '&', 'and'), '~~.*?~~', '', 'g'), '[^a-z0-9]', '', 'g')), ' ')) AS transcript_md5,
  md5(array_to_string(list_transform(w, lambda x: regexp_replace(replace(lower(x), '&', 'and'), '[^a-z0-9]', '', 'g')), ' ')) AS canon_md5,
  md5(array_to_string(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), ' ')) AS stitch_md5,
  len(list_filter(w, lambda x: regexp_replace(replace(lower(x), '&', 'and'), '[^a-z0-9]', '', 'g') = ''))::BIGINT AS n_empty
FROM w
""")
def normalised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\r\n\x0B\f]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    joined = lambda f: F.md5(F.array_join(F.transform("w", f), " "))
    empty = F.size(F.filter("w", lambda x: T.canon_word(x) == "")).cast("long")
    return docs.select("doc_id", joined(T.transcript_word).alias("transcript_md5"), joined(T.canon_word).alias("canon_md5"), joined(T.stitch_word).alias("stitch_md5"), empty.alias("n_empty"))


@query(r"""
SELECT doc_id, len(r)::BIGINT AS n_words, md5(array_to_string(r, ' ')) AS report_md5,
  md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS heading_md5,
  md5(regexp_replace(text, '~~|\{\{|\}\}|[\[\]<>]', '', 'g')) AS plain_md5
FROM (SELECT doc_id, text, regexp_extract_all(replace(lower(text), '&', ' and '), '[a-z0-9]+') AS r FROM documents)
""")
def report_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("r", T.report_words(F.col("text")))
    heading, plain = F.md5(T.heading_text(F.col("text"))), F.md5(T.without_markup(F.col("text")))
    return docs.select("doc_id", F.size("r").cast("long").alias("n_words"), F.md5(F.array_join("r", " ")).alias("report_md5"), heading.alias("heading_md5"), plain.alias("plain_md5"))


@query(
    ADJACENT
    + """
, l AS (SELECT a, b, least(length(a), length(b)) AS lo, greatest(length(a), length(b)) AS hi, levenshtein(a, b) AS d FROM (SELECT lower(a) AS a, lower(b) AS b FROM p))
SELECT level, count(*) AS pairs, sum(d)::BIGINT AS edits FROM (SELECT d, CASE WHEN a = b THEN 1
    WHEN lo >= 5 AND a[1] = b[1] AND a[-1] = b[-1] AND hi - lo <= 2 THEN 2
    WHEN lo >= 4 AND d <= CASE WHEN hi <= 5 THEN 1 WHEN hi <= 9 THEN 2 ELSE 3 END THEN 3 ELSE 0 END AS level FROM l) GROUP BY level
"""
)
def match_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = adjacent(spark, sf_dir).select(F.lower("a").alias("a"), F.lower("b").alias("b"))
    level = T.match_level(F.col("a"), F.col("b")).alias("level")
    return pairs.select(level, F.levenshtein("a", "b").alias("d")).groupBy("level").agg(F.count("*").alias("pairs"), F.sum("d").cast("long").alias("edits"))


@query(
    ADJACENT
    + f"""
, k AS (SELECT a, b, lower(a) AS x, lower(b) AS y, greatest(length(a), length(b)) AS hi FROM p)
SELECT kind, count(*) AS pairs, sum(floor(1000 * ratio + 0.5))::BIGINT AS ratio_sum FROM (SELECT levenshtein(x, y) / hi AS ratio, CASE WHEN x = y THEN 'capitalization'
    WHEN x <> y AND list_contains({_VARIANTS}, least(x, y) || ' ' || greatest(x, y)) THEN 'spelling' WHEN hi >= 5 AND levenshtein(x, y) <= 3 AND levenshtein(x, y) / hi <= 0.34 THEN 'spelling' ELSE 'wordChange' END AS kind FROM k) GROUP BY kind
"""
)
def substitution_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    ratio = F.floor(1000 * T.distance_ratio(a, b) + 0.5).cast("long")
    return adjacent(spark, sf_dir).groupBy(T.substitution_kind(a, b).alias("kind")).agg(F.count("*").alias("pairs"), F.sum(ratio).alias("ratio_sum"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_replace(line, '[^A-Za-z]', '', 'g') <> '' AND regexp_replace(line, '[^A-Za-z]', '', 'g') = upper(regexp_replace(line, '[^A-Za-z]', '', 'g'))) AS all_caps,
  count(*) FILTER (regexp_matches(line, '(?i)^\s*chapter\b\s*([ivxlc]+|[0-9]+)?\s*(st|nd|rd|th)?\.?\s*[—\-]*\s*$')) AS chapter_marks,
  max(length(line)) AS longest
FROM l GROUP BY doc_id
""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    caps, marks = T.is_all_caps(F.col("line")), T.is_chapter_marker(F.col("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(caps).alias("all_caps"), F.count_if(marks).alias("chapter_marks"), F.max(F.length("line")).cast("long").alias("longest"))


@query(r"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS verse FROM documents)
SELECT doc_id, verse, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml,
  CASE WHEN length(line) > 450 THEN substr(line, 1, 450) || '…' ELSE line END AS preview FROM d
""")
def card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a text (a verse, by its number), escaped, and its preview of 450 characters."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("verse"), T.escaped_xml(F.col("line")).alias("xml"), T.shortened(F.col("line"), 450).alias("preview"))


@query(r"""
WITH RECURSIVE v AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS verse, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(verse, '\s+'), lambda x: x <> '') AS w FROM v),
r AS (
  SELECT doc_id, line, 1 AS i, w, []::VARCHAR[] AS done, '' AS now FROM w
  UNION ALL
  SELECT doc_id, line, i + 1, w, CASE WHEN fits THEN done ELSE done || [now] END, CASE WHEN NOT fits OR now = '' THEN w[i] ELSE now || ' ' || w[i] END
  FROM (SELECT *, now = '' OR length(now) + 1 + length(w[i]) <= CASE WHEN len(done) = 0 THEN 40 ELSE 43 END AS fits FROM r WHERE i <= len(w))
), f AS (SELECT doc_id, line, CASE WHEN now = '' THEN done ELSE done || [now] END AS lines FROM r WHERE i = len(w) + 1)
SELECT doc_id, line, array_to_string(lines[:8], chr(10)) AS lines, len(lines)::INTEGER AS n_lines FROM f
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL
""")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a text (a verse, by its number) in lines of 43 characters, the first of 40 as it has the number, eight at most."""
    verses = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("i", "verse"))
    rows = verses.withColumn("lines", T.wrapped(F.col("verse"), 43, 40))
    return rows.select("doc_id", (F.col("i") + 1).alias("line"), F.array_join(F.slice("lines", 1, 8), "\n").alias("lines"), F.when(F.col("lines").isNotNull(), F.size("lines")).alias("n_lines"))


@query("""
WITH t AS (SELECT conv_id, turn, text FROM conversations), r AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT DISTINCT conv_id, turn FROM t WHERE length(text) > 60)),
i AS (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM r GROUP BY conv_id, g)
SELECT conv_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS marks FROM i GROUP BY conv_id
""")
def verse_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as marked verses: 0,2-3,5 (W9); the marked ones are those of more than 60 characters."""
    turns = table(spark, sf_dir, "conversations").where("length(text) > 60")
    return turns.groupBy("conv_id").agg(F.collect_set("turn").alias("t")).select("conv_id", T.marks(F.col("t")).alias("marks"))


_MARKS = """CASE n % 8 WHEN 0 THEN a || '-' || b WHEN 1 THEN (a + 1) || '-' || (b + 1) || '-99' WHEN 2 THEN (a + 1) || ' - ' || (b + 1) || ', ' || (b + 7) || ',' || (a + 1) WHEN 3 THEN (b + 1) || ',x'
  WHEN 4 THEN (b + 2) || '-' || (a + 1) WHEN 5 THEN '1234567,' || (b + 1) || '.0' WHEN 6 THEN (a + 1) || ',0' ELSE (a + 1) || '-' || (b + 1) || ',2.5' END"""


@query(f"""
WITH m AS (SELECT conv_id, min(turn) AS a, max(turn) AS b, conv_id + count(*) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT *, {_MARKS} AS marks FROM m)
SELECT conv_id, marks, CASE WHEN n % 8 = 0 AND a >= 1 OR n % 8 = 1 THEN array_to_string(range(CASE WHEN n % 8 = 1 THEN a + 1 ELSE a END, CASE WHEN n % 8 = 1 THEN b + 2 ELSE b + 1 END), ',')
  WHEN n % 8 = 2 THEN array_to_string(range(a + 1, b + 2) || [b + 7], ',') WHEN n % 8 = 5 THEN (b + 1) || ',1234567' END AS verses FROM s
""")
def parsed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks written in several ways and read again: from 0, backwards, with fractions, letters and long numbers."""
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), (F.col("conv_id") + F.count("*")).alias("n"))
    m = m.select("conv_id", F.expr(_MARKS).alias("marks"))
    numbers = T.parsed_marks(F.col("marks"))
    return m.withColumn("verses", F.array_join(F.transform(numbers, lambda x: x.cast("string")), ","))


@query(r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, [path, path || '/.env', '/api' || path, '/%2Egit' || path, path || '%zz', '/Config' || path][1 + page_id % 6] AS asked FROM u)
SELECT page_id, asked, list_bool_or(list_transform(['/\.env', '/\.git', '/\.npmrc', '/\.yarn', '/\.ssh', '/\.aws', '/\.docker', '/\.stripe', '/\.bash_history', '/\.netrc', '/\.htpasswd', '(?i)config', '^/api/', '^/backend/', '/wp-', '/phpmy'],
  lambda r: regexp_matches(asked, r) OR regexp_matches(url_decode(asked), r))) AS probe, regexp_extract(url, '://([^/?#]+)', 1) AS host,
  TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]+)/?$', 1) AS BIGINT) AS chapter, regexp_extract(path, '^/([^/]+)/[0-9]+/?$', 1) AS book
FROM q
""")
def navigation_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of page addresses as they are and as probes would ask for them, and the chapters that they name."""
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", "url", path.alias("path"))
    p = F.col("path")
    asked = F.get(F.array(p, F.concat(p, F.lit("/.env")), F.concat(F.lit("/api"), p), F.concat(F.lit("/%2Egit"), p), F.concat(p, F.lit("%zz")), F.concat(F.lit("/Config"), p)), (F.col("page_id") % 6).cast("int"))
    place = lambda i: F.regexp_extract(p, "^/([^/]+)/([0-9]+)/?$", i)
    return rows.select("page_id", asked.alias("asked"), bans.is_probe(asked).alias("probe"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), place(2).try_cast("bigint").alias("chapter"), place(1).alias("book"))


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS search FROM pages),
p AS (SELECT page_id, regexp_extract(path, '^/([^/]+)/[0-9]+/?$', 1) AS book, TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]+)/?$', 1) AS BIGINT) AS chapter, regexp_extract(search, '[?&]page=([^&]*)', 1) AS v1, regexp_extract(search, '[?&]ref=([^&]*)', 1) AS v2, path || search AS href FROM u)
SELECT v1, v2, count(*) AS entries, md5(string_agg(href, ' ' ORDER BY CASE book WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, chapter, page_id)) AS hrefs_md5, min(page_id) AS first_seen
FROM p WHERE book IN ('en', 'fr', 'de') AND v1 <> '' AND v2 <> '' GROUP BY v1, v2
""")
def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of comparisons grouped by their pair of versions, by order of books and chapter, groups known by their first page."""
    order = ["en", "fr", "de"]
    p = table(spark, sf_dir, "pages").select("page_id", T.cached_entry(F.col("url"), order, "page", "ref").alias("e")).where("e IS NOT NULL").select("page_id", "e.*")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("book"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "chapter", "page_id", "href"))), lambda x: x["href"])
    return p.groupBy("v1", "v2").agg(F.count("*").alias("entries"), F.md5(F.array_join(entries, " ")).alias("hrefs_md5"), F.min("page_id").alias("first_seen"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations), l AS (
  SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS text, min(turn) AS first, count(*) AS words FROM c GROUP BY conv_id, role)
SELECT conv_id, role, md5(text) AS text_md5, words, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN chr((96 + row_number() OVER (PARTITION BY conv_id ORDER BY first, role))::INTEGER) END AS suffix FROM l
""")
def lines_of_verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts grouped by line in order, lines over several verses lettered."""
    c = table(spark, sf_dir, "conversations")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    lines = c.groupBy("conv_id", "role").agg(F.md5(F.array_join(texts, " ")).alias("text_md5"), F.count("*").alias("words"), F.min("turn").alias("first"))
    w = Window.partitionBy("conv_id")
    letter = F.char(96 + F.row_number().over(w.orderBy("first", "role")))
    return lines.withColumn("suffix", F.when(F.count("*").over(w) > 1, letter)).drop("first")


@query(r"""
WITH c AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'unknown version' WHEN turn < 0 OR turn > 4 THEN 'chapter out of range'
  WHEN length(text) = 0 THEN 'no text' WHEN length(text) > 500 THEN 'text too long' END AS error FROM c)
SELECT coalesce(error, 'valid') AS outcome, count(*) AS reports, min(conv_id) AS first_conv FROM e GROUP BY 1
""")
def correction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks in order, the first that fails names the outcome."""
    error = F.when(~F.col("role").isin("user", "assistant"), "unknown version").when((F.col("turn") < 0) | (F.col("turn") > 4), "chapter out of range")
    error = error.when(F.length("text") == 0, "no text").when(F.length("text") > 500, "text too long").otherwise("valid")
    return table(spark, sf_dir, "conversations").groupBy(error.alias("outcome")).agg(F.count("*").alias("reports"), F.min("conv_id").alias("first_conv"))


QUERIES, ORACLES = query.queries, query.oracles
