"""Rate limits over events: users stand for clients, errors for failed requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import limits
from .common import Registry, table

query = Registry()
DAY, HOUR = 86_400_000, 3_600_000


def fold(where: str, window: int, name: str) -> str:
    """A recursive walk over each user's events in order: the count and start of its window."""
    return f"""
{name}e AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000)) AS i FROM events WHERE {where}),
{name} AS (
  SELECT user_id, i, t, 1::BIGINT AS n, t AS start FROM {name}e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.t, CASE WHEN e.t - f.start > {window} THEN 1 ELSE f.n + 1 END, CASE WHEN e.t - f.start > {window} THEN e.t ELSE f.start END
  FROM {name} f JOIN {name}e e ON e.user_id = f.user_id AND e.i = f.i + 1
)"""


def millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.hits(millis(spark, sf_dir).where("event_type = 'error'"), "user_id", "ms", DAY, 3)


@query(f"WITH RECURSIVE {fold("event_type = 'error'", DAY, 'f')} SELECT user_id, count(*)::INTEGER AS events, count(*) FILTER (n = 1)::INTEGER AS windows, count(*) FILTER (n >= 3)::INTEGER AS hits, coalesce(min(CASE WHEN n >= 3 THEN t END), 0) AS first_hit FROM f GROUP BY user_id")
def failure_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three failures within a day of the first ban a client (T1, T4); first_hit 0: never."""
    return _failures(spark, sf_dir).withColumn("first_hit", F.coalesce("first_hit", F.lit(0)))


@query(f"WITH RECURSIVE {fold('true', HOUR, 'f')}, {fold('true', DAY, 'g')} SELECT f.user_id, count(*)::INTEGER AS events, count(*) FILTER (f.n <= 1 AND g.n <= 3)::INTEGER AS allowed FROM f JOIN g ON f.user_id = g.user_id AND f.i = g.i GROUP BY f.user_id")
def report_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event an hour and three a day are allowed; denied ones count too."""
    return limits.allowed(millis(spark, sf_dir), "user_id", "ms", [(HOUR, 1), (DAY, 3)])


@query(f"""
WITH RECURSIVE {fold("event_type = 'error'", DAY, 'f')}, b AS (SELECT user_id, min(CASE WHEN n >= 3 THEN t END) AS banned FROM f GROUP BY user_id)
SELECT events.user_id, count(*) AS requests, count(*) FILTER (banned IS NULL OR (epoch_us(ts) // 1000) <= banned) AS served FROM events LEFT JOIN b ON b.user_id = events.user_id GROUP BY events.user_id
""")
def banned_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests served before a client's ban."""
    all_, bans = millis(spark, sf_dir), _failures(spark, sf_dir).select("user_id", "first_hit")
    served = F.count_if(F.col("first_hit").isNull() | (F.col("ms") <= F.col("first_hit")))
    return all_.join(bans, "user_id", "left").groupBy("user_id").agg(F.count("*").alias("requests"), served.alias("served"))


QUERIES, ORACLES = query.queries, query.oracles
