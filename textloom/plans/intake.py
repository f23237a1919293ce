"""Bans and correction reports: users of events stand for clients, conversations for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bans, intake
from .common import Registry, table
from .limits import DAY

query = Registry()
VERSIONS, CHAPTERS = ["user", "assistant"], {"alma": 63, "ether": 15, "moro": 3}

_BANS = rf"""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_id, event_type = 'signup' AS unban, event_type = 'error' AS missing,
  CASE WHEN event_id % 97 = 0 THEN '/%2Eenv' WHEN event_id % 89 = 0 THEN '/CONFIG.php' WHEN event_id % 83 = 0 THEN '/api%2Fx' WHEN event_id % 79 = 0 THEN '/a+b/%zz' WHEN event_id % 73 = 0 THEN '/API/x' ELSE '/alma/3' END AS path FROM events),
p AS (SELECT *, list_bool_or(list_transform(['/\.env', '/\.git', '/\.npmrc', '/\.yarn', '/\.ssh', '/\.aws', '/\.docker', '/\.stripe', '/\.bash_history', '/\.netrc', '/\.htpasswd', '(?i)config', '^/api/', '^/backend/', '/wp-', '/phpmy'],
  lambda r: regexp_matches(path, r) OR regexp_matches(url_decode(path), r))) AS probe, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
f AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, FALSE AS banned, 0 AS n, 0::BIGINT AS start, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason FROM (SELECT DISTINCT user_id FROM p)
  UNION ALL
  SELECT user_id, i, event_id, CASE WHEN unban THEN FALSE WHEN was OR probe THEN TRUE WHEN missing THEN m >= 3 ELSE FALSE END, CASE WHEN unban OR was OR probe OR NOT missing THEN n ELSE m END,
    CASE WHEN unban OR was OR probe OR NOT missing THEN start WHEN m = 1 THEN t ELSE start END,
    CASE WHEN unban THEN CASE WHEN was THEN 'removed' ELSE 'not banned' END WHEN was OR probe THEN 'blocked' WHEN missing THEN 'missing' ELSE 'served' END,
    CASE WHEN unban THEN NULL WHEN was THEN 'ip_banned' WHEN probe THEN 'probe_path' WHEN missing AND m >= 3 THEN 'rate_limit_404' END
  FROM (SELECT p.*, f.banned AS was, f.n, f.start, CASE WHEN f.n = 0 OR p.t - f.start > {DAY} THEN 1 ELSE f.n + 1 END AS m FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1)
)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    path = F.when(n % 97 == 0, "/%2Eenv").when(n % 89 == 0, "/CONFIG.php").when(n % 83 == 0, "/api%2Fx").when(n % 79 == 0, "/a+b/%zz").when(n % 73 == 0, "/API/x").otherwise("/alma/3")
    requests = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), n.alias("seq"),
        F.when(F.col("event_type") == "signup", "unban").otherwise("request").alias("kind"), path.alias("path"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"),
    )
    return bans.decided(requests, DAY, 3)


@query(_BANS + " SELECT user_id, event_id, outcome, reason, banned FROM f WHERE i > 0")
def ban_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are served, counted or blocked, bans by probes and by missing pages, and their removal."""
    return _decided(spark, sf_dir).select(F.col("client").alias("user_id"), F.col("seq").alias("event_id"), "outcome", "reason", "banned")


@query(_BANS + ", z AS (SELECT user_id, arg_max(banned, i) AS banned FROM f GROUP BY user_id) SELECT user_id, count(*) OVER () AS bans FROM z WHERE banned")
def ban_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that are banned at the end, and how many they are."""
    listed = bans.bans(_decided(spark, sf_dir))
    return listed.select(F.col("client").alias("user_id"), F.lit(listed.count()).cast("long").alias("bans"))


_PAYLOAD = """CASE WHEN n % 17 = 0 THEN '{"version":' WHEN n % 41 = 0 THEN 'null' WHEN n % 43 = 0 THEN '[1]' ELSE
  '{"version":"' || CASE WHEN n % 11 = 0 THEN 'zz' ELSE role END || '","comparedWith":' || CASE WHEN n % 19 = 0 THEN '5' ELSE '"assistant"' END ||
  ',"book":"' || CASE conv_id % 4 WHEN 0 THEN 'alma' WHEN 1 THEN 'ether' WHEN 2 THEN 'moro' ELSE 'none' END || '","chapter":' || CASE WHEN n % 23 = 0 THEN '1.5' WHEN n % 3 = 0 THEN '1.0' ELSE (turn + 1)::STRING END ||
  ',"verses":[' || CASE WHEN n % 29 = 0 THEN '' WHEN n % 47 = 0 THEN '301' WHEN n % 53 = 0 THEN '"1"' ELSE (conv_id % 60 + turn + 1)::STRING || ',' || (conv_id % 60 + 1 + n % 3)::STRING || ',' || (conv_id % 60 + turn + 1)::STRING END ||
  '],"errorType":"' || CASE WHEN n % 31 = 0 THEN 'bad' ELSE 'typo' END || '","selectedText":"' || repeat('x', ((n % 7) * 100)::INT) || '"' ||
  CASE WHEN n % 13 = 0 THEN ',"website":"bot"' ELSE '' END || CASE WHEN n % 5 = 0 THEN '' WHEN n % 37 = 0 THEN ',"url":"ftp://x"' ELSE ',"url":"https://e.x/"' END || ',"description":null}' END"""

_INTAKE = rf"""
WITH RECURSIVE c AS (SELECT *, conv_id + turn AS n, row_number() OVER (ORDER BY conv_id, turn, role, text) AS seq FROM conversations),
p AS (SELECT seq, conv_id % 40 AS client, conv_id * 500 + turn * 1000 AS ms, {_PAYLOAD} AS j FROM c),
v AS (SELECT *, json_valid(j) AS valid FROM p),
x AS (SELECT *, CASE WHEN valid THEN j END AS k FROM v),
y AS (SELECT *, json_type(k) AS kind, json_extract_string(k, '$.version') AS version, json_type(k, '$.comparedWith') AS ct, json_extract_string(k, '$.comparedWith') AS other, json_extract_string(k, '$.book') AS book,
  TRY_CAST(json_extract_string(k, '$.chapter') AS DOUBLE) AS chapter, json_type(k, '$.verses') AS vt, json_extract(k, '$.verses[*]') AS vs, json_extract_string(k, '$.errorType') AS et, json_extract_string(k, '$.selectedText') AS st,
  coalesce(json_extract_string(k, '$.url'), '') AS url, coalesce(json_extract_string(k, '$.website'), '') <> '' AS trapped FROM x),
z AS (SELECT *, CASE WHEN NOT valid THEN 'invalid json' WHEN kind NOT IN ('OBJECT', 'ARRAY') THEN 'payload must be an object' WHEN version IS NULL OR version NOT IN ('user', 'assistant') THEN 'unknown version'
  WHEN ct IS DISTINCT FROM 'VARCHAR' OR other NOT IN ('user', 'assistant') THEN 'unknown comparedWith version' WHEN book IS NULL OR book NOT IN ('alma', 'ether', 'moro') THEN 'unknown book'
  WHEN chapter IS NULL OR chapter <> floor(chapter) OR chapter < 1 OR chapter > CASE book WHEN 'alma' THEN 63 WHEN 'ether' THEN 15 ELSE 3 END THEN 'chapter out of range'
  WHEN len(vs) NOT BETWEEN 1 AND 20 OR NOT list_bool_and(list_transform(vs, lambda q: json_type(q) IN ('UBIGINT', 'BIGINT') AND coalesce(TRY_CAST(CAST(q AS VARCHAR) AS BIGINT) BETWEEN 1 AND 300, FALSE))) THEN 'invalid verses'
  WHEN et NOT IN ('verse-boundary', 'spacing-hyphenation', 'typo', 'other') THEN 'unknown errorType' WHEN length(st) > 500 THEN 'selectedText too long' WHEN url <> '' AND NOT regexp_matches(url, '^https?://\S+$') THEN 'invalid url' END AS error FROM y),
l AS (SELECT client, seq, ms, row_number() OVER (PARTITION BY client ORDER BY ms, seq) AS i FROM z WHERE valid AND NOT trapped),
r AS (
  SELECT client, seq, i, ms AS ma, 1 AS na, ms AS mb, 1 AS nb FROM l WHERE i = 1
  UNION ALL
  SELECT l.client, l.seq, l.i, CASE WHEN l.ms - ma > 60000 THEN l.ms ELSE ma END, CASE WHEN l.ms - ma > 60000 THEN 1 ELSE na + 1 END, CASE WHEN l.ms - mb > 3600000 THEN l.ms ELSE mb END, CASE WHEN l.ms - mb > 3600000 THEN 1 ELSE nb + 1 END
  FROM r JOIN l ON l.client = r.client AND l.i = r.i + 1
),
g AS (SELECT z.*, r.na <= 3 AND r.nb <= 30 AS allowed FROM z LEFT JOIN r USING (seq)),
h AS (SELECT *, CASE WHEN error = 'invalid json' THEN error WHEN trapped THEN 'ignored' WHEN NOT allowed THEN 'rate limited' ELSE error END AS fate, CASE WHEN error IS NULL THEN list_sort(list_distinct(list_transform(vs, lambda q: CAST(CAST(q AS VARCHAR) AS BIGINT)))) END AS verses FROM g),
o AS (SELECT seq, ms, version, book, chapter, verses, row_number() OVER (PARTITION BY version, book, chapter ORDER BY ms, seq) AS i FROM h WHERE fate IS NULL),
d AS (
  SELECT version, book, chapter, 0::BIGINT AS i, NULL::BIGINT AS seq, [10]::BIGINT[] AS covered, ['open:10']::VARCHAR[] AS owners, NULL::VARCHAR AS met FROM (SELECT DISTINCT version, book, chapter FROM o)
  UNION ALL
  SELECT version, book, chapter, i, seq, CASE WHEN met IS NULL THEN covered || verses ELSE covered END, CASE WHEN met IS NULL THEN owners || list_transform(verses, lambda q: 'new:' || seq) ELSE owners END, met
  FROM (SELECT o.*, d.covered, d.owners, d.owners[list_position(d.covered, list_filter(o.verses, lambda q: list_contains(d.covered, q))[1])] AS met
    FROM d JOIN o ON o.version = d.version AND o.book = d.book AND o.chapter = d.chapter AND o.i = d.i + 1)
)
SELECT h.seq, coalesce(fate, CASE WHEN d.met IS NULL THEN 'created' ELSE 'duplicate' END) AS outcome, d.met AS duplicate_of FROM h LEFT JOIN d ON d.seq = h.seq
"""


@query(_INTAKE)
def report_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON, some broken, through hidden field, limits, checks and comparison with open ones."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") + F.col("turn"))
    number = F.row_number().over(Window.orderBy("conv_id", "turn", "role", "text")).cast("long")
    reports = c.select(number.alias("seq"), (F.col("conv_id") % 40).alias("client"), (F.col("conv_id") * 500 + F.col("turn") * 1000).alias("ms"), F.expr(_PAYLOAD).alias("payload"))
    known = spark.range(1).select(F.lit("open:10").alias("issue"), F.explode(F.array(*map(F.lit, VERSIONS))).alias("version"), F.array(F.lit(10)).alias("verses"))
    known = known.select("*", F.explode(F.array(*map(F.lit, CHAPTERS))).alias("book")).select("*", F.explode(F.sequence(F.lit(1), F.lit(63))).alias("chapter"))
    found = intake.outcomes(intake.limited(intake.checked(reports, VERSIONS, CHAPTERS)), known)
    return found.select("seq", "outcome", "duplicate_of")


QUERIES, ORACLES = query.queries, query.oracles
