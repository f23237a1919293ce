"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space, as `[^\x20\x09-\x0D]+` sees it.
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "textloom-checkpoints"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of fewer rows for the jobs run within: with long texts, JVM and Python hold several batches a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends at files in the shared folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpoint(), but as compressed Parquet in the shared folder; partitions need not be kept.

    The folder that Spark makes for the application's checkpoints goes with the driver: results read from it lazily.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    path = f"{base}/table-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets the context cleaner drop shuffle files that are no longer needed
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(spark: SparkSession) -> None:
    """Lets the context cleaner drop the shuffle files of tables that Python no longer holds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def trim() -> None:
    """Gives memory that this Python process no longer uses back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def frugal(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that returns its memory at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = 1000, least: int = 32, salts: int = 64, counts: DataFrame | None = None) -> DataFrame:
    """left.join(right, keys) where one key, or null, may hold any part of left's rows; right has few rows of each key.

    Keys with a thousandth of left's rows (so a thousand at most, which are collected) are dealt to `salts` tasks each.
    left should be a stored table, so that its rows have the same salts in a repeated task. counts: left's rows by key, as
    (keys, n), where they are known.
    """
    total = left.count()
    counts = (left.groupBy(*keys).agg(F.count("*").alias("__n")) if counts is None else counts.select(*keys, F.col("n").alias("__n"))).where((F.col("__n") * share >= total) & (F.col("__n") >= least)).drop("__n")
    rows = counts.collect()
    if not rows:
        return left.join(right, keys, how)
    heavy = left.sparkSession.createDataFrame(rows, counts.schema).toDF(*(f"__{k}" for k in keys)).withColumn("__heavy", F.lit(True))

    def marked(df: DataFrame) -> DataFrame:
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        return df.join(F.broadcast(heavy), on, "left").drop(*(f"__{k}" for k in keys))

    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))
    left = marked(left).withColumn("__salt", F.when(F.col("__heavy"), salt).otherwise(0)).drop("__heavy")
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    right = marked(right).withColumn("__salt", F.explode(F.when(F.col("__heavy"), every).otherwise(F.array(F.lit(0).cast("long"))))).drop("__heavy")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def with_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Null texts count as empty."""
    return docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def ascii_words(text: str) -> list[str]:
    """Maximal runs without ASCII white space."""
    # str.split() also splits at U+001C-1F, U+0085, U+00A0 and other Unicode spaces
    return ASCII_WORD.findall(text)
