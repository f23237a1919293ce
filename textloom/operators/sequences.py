"""Ordered operators: fills, islands, neighbours, n-gram anchors, interpolation and top-k, all by windows within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def runs(df: DataFrame, keys: list[str], order: list[str], changed: Column, name: str = "runs") -> DataFrame:
    """Number of maximal runs of changed rows in each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_c", changed).withColumn("_p", F.coalesce(F.lag("_c").over(w), F.lit(False)))
    return df.groupBy(*keys).agg(F.sum((F.col("_c") & ~F.col("_p")).cast("int")).alias(name))


def filled(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last value seen; leading gaps get the first one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(back, ahead))


def nearest_kept(df: DataFrame, keys: list[str], order: list[str], position: str, kept: Column, out: str) -> DataFrame:
    """Position of the nearer kept neighbour, the earlier one on ties; a kept row is its own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = F.when(kept, F.col(position))
    back = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    nearer = F.when(back.isNull(), ahead).when(ahead.isNull(), back).when(ahead - F.col(position) < F.col(position) - back, ahead).otherwise(back)
    return df.withColumn(out, nearer)


def lettered(df: DataFrame, keys: list[str], order: list[str], member: list[str], out: str) -> DataFrame:
    """a, b, c ... for the distinct members of a key in first-seen order (W11); null where there is one only."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.min("_at").over(Window.partitionBy(*keys, *member))
    df = df.withColumn("_at", F.row_number().over(w)).withColumn("_first", first)
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first"))
    df = df.withColumn("_rank", rank).withColumn("_all", F.max("_rank").over(Window.partitionBy(*keys)))
    return df.withColumn(out, F.when(F.col("_all") > 1, F.char(96 + F.col("_rank")))).drop("_at", "_first", "_rank", "_all")


def ngrams(df: DataFrame, key: str, words: str, n: int) -> DataFrame:
    """(key, pos, ngram) of an array of words, from 0."""
    arr = F.col(words)
    at = F.sequence(F.lit(0), F.size(arr) - n)
    grams = F.when(F.size(arr) >= n, F.transform(at, lambda i: F.array_join(F.slice(arr, i + 1, n), " ")))
    return df.select(key, F.posexplode(grams).alias("pos", "ngram"))


def unique_ngrams(grams: DataFrame, key: str) -> DataFrame:
    """N-grams that occur once in all, with their place (A5)."""
    place = F.min(F.struct(key, "pos")).alias("_at")
    return grams.groupBy("ngram").agg(F.count("*").alias("_n"), place).where("_n = 1").select("ngram", f"_at.{key}", "_at.pos")


def anchors(source: DataFrame, target: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """Pairs of places of n-grams that are unique on both sides."""
    a = unique_ngrams(source, source_key).withColumnRenamed("pos", "s")
    b = unique_ngrams(target, target_key).withColumnRenamed("pos", "t")
    return a.join(b, "ngram").select(source_key, target_key, "s", "t", "ngram")


def interpolated(df: DataFrame, keys: list[str], position: str, anchor: str, out: str) -> DataFrame:
    """Anchors where given, between them linear, outside with the slope of the nearest pair (1 if single); half up."""
    w = Window.partitionBy(*keys).orderBy(position)
    p, known = F.col(position), F.col(anchor).isNotNull()
    pair = F.when(known, F.struct(p.alias("s"), F.col(anchor).alias("t")))
    prev = F.last(pair, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(pair, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    # the slopes at both ends: of the first and of the last two anchors of each key
    after, before = F.lead(pair).over(w), F.lag(pair).over(w)
    ends = df.where(known).withColumns({"_pair": pair, "_after": after, "_before": before})
    rise = lambda a, b: (b["t"] - a["t"]) / (b["s"] - a["s"])
    low = F.min_by(rise(F.col("_pair"), F.col("_after")), p).alias("_first")
    high = F.max_by(rise(F.col("_before"), F.col("_pair")), p).alias("_last")
    ends = ends.groupBy(*keys).agg(low, high)
    df = df.withColumns({"_prev": prev, "_next": following}).join(ends, keys, "left")
    first, last = F.coalesce("_first", F.lit(1.0)), F.coalesce("_last", F.lit(1.0))
    inner = F.col("_prev.t") + (p - F.col("_prev.s")) * (F.col("_next.t") - F.col("_prev.t")) / (F.col("_next.s") - F.col("_prev.s"))
    value = F.when(known, F.col(anchor).cast("double")).when(F.col("_prev").isNull(), F.col("_next.t") - (F.col("_next.s") - p) * first)
    value = value.when(F.col("_next").isNull(), F.col("_prev.t") + (p - F.col("_prev.s")) * last).otherwise(inner)
    return df.withColumn(out, F.floor(value + 0.5)).drop("_prev", "_next", "_first", "_last")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each key in the order given, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
