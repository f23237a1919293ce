"""Mixing of sources to target weights by systematic sampling.

A source's target is its weight's share of the mix, at most `most` times its size; what is above goes to the other sources
by weight until none is above. A document is expected target / source size times. These expected copies are added up
within the source, documents ordered by size, one random offset is added, and a document is emitted once for each integer
that the sum crosses at it. As neighbours in that order have about one size, a source's words miss its target by less than
its largest document's. Of CANDIDATES random offsets a source takes the one whose words come nearest to its target, which
counts where a source has few documents (one of a single document can miss it by half, as copies are whole).

Expected copies are whole multiples of 2^-24, so sums are exact whatever the partitions, no document is emitted more than
`most` times, and reruns agree. The offsets come from the seed and the source's name.

Running sums are taken in two passes: rows are dealt by ranges of (source, size, id, hash of the text), each range sums its
own, and the ranges' totals, one row for each source in each range, give the offsets. So a source may hold all rows.

Edge cases: null texts have size 0; a null source is a source of its own, the last; a table or source without words has
target 0 and takes nothing; repeated rows and ids are documents like others; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import salted_join, stored

WEIGHTS, UNIT, CANDIDATES = (3, 1, 2), 1 << 24, 16
WORD = r"[^\x20\x09-\x0D]+"


def running_totals(df: DataFrame, by: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows before in the same group; `by` columns are not null, a group may be any part of the table."""
    dealt = df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt)  # both passes see the same ranges
    own = Window.partitionBy("__part", *by)
    before = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("__local", F.coalesce(F.sum(value).over(before), F.lit(0)))
    totals = dealt.groupBy("__part", *by).agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__part", *by, F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    return local.join(bases, ["__part", *by]).withColumn(out, F.col("__local") + F.col("__base")).drop("__part", "__local", "__base")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds the place of each source by code points, from 0; `key` sorts like the sources, null last."""
    return running_totals(sources.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)), ["__all"], [F.col("key")], "__one", "place").drop("__one", "__all")


def targets(sources: DataFrame, share: Sequence[int] = (3, 2), weights: Sequence[int] = WEIGHTS, most: int = 2) -> DataFrame:
    """Adds target: words of each source in a mix of share[0] / share[1] times all words. sources: key, source_size.

    A source above `most` times its size is held there, and the rest is shared by the others; each round settles every
    source that is above, so a few rounds do, and only sums reach the driver.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = stored(numbered(sources).withColumn("weight", weight.cast("long")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    up, down = share
    high, low = None, None  # what free sources get for a unit of weight, as a fraction

    def held() -> Column:
        """most * size < high / low * weight, without rounding"""
        wide = lambda x: F.col(x).cast("decimal(19,0)")
        return wide("source_size") * F.lit(most * low).cast("decimal(19,0)") < wide("weight") * F.lit(high).cast("decimal(19,0)")

    settled = (0, 0)
    while True:
        is_held = F.lit(False) if high is None else held()
        r = table.agg(F.sum(F.when(is_held, F.col("source_size")).otherwise(0)).alias("size"), F.count_if(is_held).alias("n"), F.sum(F.when(is_held, 0).otherwise(F.col("weight"))).alias("free")).first()
        if high is not None and (r["n"], r["size"]) == settled or not r["free"]:
            break
        settled = (r["n"], r["size"])
        high, low = total * up - down * most * r["size"], down * r["free"]
    if high is None:  # no sources at all
        return table.withColumn("target", F.lit(0.0))
    given = F.col("weight") * F.lit(float(high)) / F.lit(float(low))
    return table.withColumn("target", F.when(held(), (F.col("source_size") * most).cast("double")).otherwise(given))


def mix(docs: DataFrame, seed: int = 13, share: Sequence[int] = (3, 2), weights: Sequence[int] = WEIGHTS, most: int = 2, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, size, source_size, target and copies of every document: how often the mix takes it, whole."""
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.col(source).cast("string")
    base = docs.select(F.col(key).alias("id"), name.alias("source"), F.coalesce(F.concat(F.lit("s"), name), F.lit("t")).alias("key"), words.alias("size"), F.xxhash64(text).alias("hash"))
    base = stored(base)
    wanted = targets(base.groupBy("key").agg(F.sum("size").alias("source_size")), share, weights, most)
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0).cast("long")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(CANDIDATES - 1)), lambda j: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(":"), F.col("key"))), 1, 6), 16, 10).cast("long"))
    wanted = wanted.select("key", "source_size", "target", F.least(expected, F.lit(most * UNIT)).alias("expected"), drawn.alias("offsets"))  # below UNIT
    rows = salted_join(base, wanted, ["key"]).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("size"), F.col("id"), F.col("hash"), F.col("row")]
    summed = stored(running_totals(rows, ["key"], order, "expected", "before"))
    crossed = lambda x, offset: F.shiftright(x + offset, 24)
    copies_at = lambda offset: crossed(F.col("before") + F.col("expected"), offset) - crossed(F.col("before"), offset)
    words_at = [F.sum(copies_at(F.get("offsets", j)) * F.col("size")).alias(f"w{j}") for j in range(CANDIDATES)]
    sums = summed.groupBy("key").agg(F.first("target").alias("target"), F.first("offsets").alias("offsets"), *words_at)
    misses = F.array(*(F.struct(F.abs(F.col(f"w{j}") - F.col("target")).alias("miss"), F.lit(j).alias("j"), F.get("offsets", j).alias("offset")) for j in range(CANDIDATES)))
    summed = salted_join(summed.drop("offsets"), sums.select("key", F.array_min(misses)["offset"].alias("offset")), ["key"])
    copies = copies_at(F.col("offset"))
    return summed.select(F.col("id").alias(key), "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", **how: object) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with `copy` from 0. Ids are to be unique and not null."""
    taken = mix(docs, key=key, **how).where("copies > 0").select(key, F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"))
    return docs.join(taken, key)
