"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read back: several uses compute them once, and a lost executor costs no more than a read.

    The folder is that of spark.checkpoint.dir, or a temporary one in local mode; Spark's own folder in it goes with the driver.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "textloom-checkpoints"))
    base = sc._jsc.sc().getCheckpointDir().get()
    folder = sc._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    path = f"{base}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
