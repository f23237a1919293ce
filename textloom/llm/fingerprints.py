"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge into that of the whole,
and estimate resemblance, containment and the number of distinct shingles. Words are lower-cased (A-Z) runs without ASCII
white space; a shingle has five words, and a text of fewer words has one, its whole word sequence. A text without words
has an empty sketch; two empty sketches resemble each other fully, an empty and another not at all.

Edge cases: null texts count as empty; rows with equal or null ids are ordered by text after their id (nulls last), so
that neighbours are defined; repeated rows are each other's neighbours. The results have new columns only besides the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import frugal
from .words import shingles

K = 128
WIDTH = 5


def sketch(texts: list[str], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    cuts = np.concatenate([[0], np.cumsum([len(b) for b in data])]).astype(np.int64)
    values, at = shingles(np.frombuffer(b"".join(data), np.uint8), cuts, width)
    return [smallest(values[a:b], k) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def smallest(values: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, in order."""
    take = k
    while len(values) > 4 * take:
        part = np.unique(np.partition(values, 2 * take)[: 2 * take])
        if len(part) >= k:
            return part[:k]
        take *= 4  # many repeated values
    return np.unique(values)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, a, assume_unique=True) @ np.isin(both, b, assume_unique=True).astype(float)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def text_of(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def array_of(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def in_order(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Column]:
    """Rows laid out by descending key in buckets of about equal row counts, each followed by the next bucket's first row.

    Only keys are gathered to find the buckets' bounds: quantiles of all keys and the largest key of each bucket, so the
    driver gets a row per bucket. Texts are shuffled once. Returned: (_bucket, _guard, key, text) sorted within partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / wanted for i in range(1, wanted)]
    bounds = rows.agg(F.percentile_approx("_key", steps, 20 * wanted)).first()[0] or []
    bounds = sorted(set(bounds))
    # bucket 0 has the largest keys; null keys come last
    least = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>")
    bucket = F.when(F.col("_key").isNull(), len(bounds) + 1).otherwise(_after(F.col("_key"), bounds, least))
    rows = rows.withColumn("_bucket", bucket.cast("int"))
    heads = [(r["_bucket"], r["_key"]) for r in rows.groupBy("_bucket").agg(F.max("_key").alias("_key")).orderBy("_bucket").collect()]
    if not heads:
        return rows.withColumn("_guard", F.lit(0)), bucket
    # by bucket, so that a row finds its own in constant time
    first: list[int | None] = [None] * (len(bounds) + 2)
    to = [0] * (len(bounds) + 2)
    for i, (b, k) in enumerate(heads):
        first[b], to[b] = k, heads[i - 1][0]  # the first head follows the last bucket
    at = F.col("_bucket") + 1
    own = F.struct(F.col("_bucket").alias("_to"), F.lit(0).alias("_guard"))
    guard = F.struct(F.element_at(F.array(*map(F.lit, to)), at).alias("_to"), F.lit(1).alias("_guard"))
    is_head = F.col("_key").eqNullSafe(F.element_at(F.array(*(F.lit(x).cast("long") for x in first)), at))
    copies = F.explode(F.when(is_head, F.array(own, guard)).otherwise(F.array(own))).alias("_copy")
    out = rows.select("_key", "_text", copies).select(F.col("_copy._to").alias("_bucket"), F.col("_copy._guard").alias("_guard"), "_key", "_text")
    out = out.repartition("_bucket").sortWithinPartitions("_bucket", "_guard", F.desc_nulls_last("_key"), "_text")
    return out, bucket


def _after(key: Column, bounds: list[int], array: Column) -> Column:
    """How many bounds are above the key: a binary search, as nested comparisons would grow with the bounds."""
    n = max(1, len(bounds))
    low = F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b"))

    def step(s: Column, _: Column) -> Column:
        middle = ((s["a"] + s["b"]) / 2).cast("int")
        above = F.element_at(array, middle + 1) <= key
        grown = F.struct(F.when(above, middle + 1).otherwise(s["a"]).alias("a"), F.when(above, s["b"]).otherwise(middle).alias("b"))
        return F.when(s["a"] < s["b"], grown).otherwise(s)

    rounds = F.sequence(F.lit(1), F.lit(n.bit_length() + 1))
    return F.lit(len(bounds)) - F.aggregate(rounds, low, step, lambda s: s["a"])


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is replaced by the start of the next text.

    Next is in descending order of ids, after the last the first. Columns: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_distinct (estimated) and within (containment of the text in the edited).
    """
    rows, _ = in_order(docs, key, text)

    def edited(own: str, following: str) -> str:
        cut = len(own) // 3
        return own[: len(own) - cut] + following[:cut]

    def results(pending: list[tuple[int | None, str]], following: str | None) -> Iterator[pa.RecordBatch]:
        """Rows of pending whose next text is known."""
        texts = [t for _, t in pending] + ([] if following is None else [following])
        n = len(texts) - 1
        if n < 1:
            return
        own = sketch(texts, k)
        changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
        other = sketch(changed, k)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in pending[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([text_of(a) for a in own[:n]]), pa.array([text_of(a) for a in other]),
                pa.array([resemblance(own[i], other[i], k) for i in range(n)]), pa.array([resemblance(own[i], own[i + 1], k) for i in range(n)]),
                pa.array([distinct(a, k) for a in own[:n]]), pa.array([containment(own[i], other[i], k) for i in range(n)]),
            ],
            [f.name for f in schema],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[int | None, str]] = []
        bucket, chars, closed = None, 0, True
        for batch in batches:
            for b, guard, key_, text_ in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != bucket:
                    bucket, closed, pending, chars = b, False, [], 0
                if closed:
                    continue  # further guards: rows with the id of the first
                if guard:
                    yield from results(pending, text_)
                    closed, pending = True, []
                    continue
                pending.append((key_, text_))
                chars += len(text_)
                if chars > 4_000_000 and len(pending) > 1:
                    yield from results(pending, None)
                    pending = pending[-1:]
                    chars = len(text_)

    doubles = ("near_edited", "near_next", "n_distinct", "within")
    strings = ("edited_sha256", "fingerprint", "edited_fingerprint")
    schema = StructType([StructField("key", LongType()), StructField("n_chars", LongType()), *(StructField(x, StringType()) for x in strings), *(StructField(x, DoubleType()) for x in doubles)])
    return rows.mapInArrow(frugal(run), schema).withColumnRenamed("key", key)
