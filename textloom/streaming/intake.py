"""Correction reports as a stream: limits in keyed state, then each batch against what is open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import intake

ISSUES = "issue string, version string, book string, chapter int, verses array<int>"


def limited(reports: DataFrame, limits: intake.Limits = (intake.MINUTE, intake.HOUR)) -> DataFrame:
    """As intake.limited() over a stream: (client, ms, seq, payload, allowed), all windows of a client in one state."""
    names = ", ".join(f"n{i} long, begin{i} long" for i in range(len(limits)))
    kind = dict(reports.dtypes)["client"]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        flat = tuple(state.get) if state.exists else (0, 0) * len(limits)
        now = tuple(zip(flat[::2], flat[1::2]))
        out = []
        for r in pd.concat(list(frames)).sort_values(["ms", "seq"]).itertuples():
            now, (right,) = intake.step(now, int(r.ms), bool(r.counts), limits)
            out.append((keys[0], r.ms, r.seq, r.payload, right))
        state.update(tuple(x for pair in now for x in pair))
        yield pd.DataFrame(out, columns=["client", "ms", "seq", "payload", "allowed"])

    counts = ~F.col("trapped") & (F.coalesce("error", F.lit("")) != "invalid json")
    rows = reports.select("client", F.col("ms").cast("long").alias("ms"), F.col("seq").cast("long").alias("seq"), "payload", counts.alias("counts"))
    return rows.groupBy("client").applyInPandasWithState(run, f"client {kind}, ms long, seq long, payload string, allowed boolean", names, "append", "NoTimeout")


def open_issues(spark: SparkSession, path: str, but: int | None = None) -> DataFrame:
    """Issues under `path`, one folder for each batch that created some; `but`: without those of that batch."""
    rows = spark.read.schema(f"{ISSUES}, batch long").option("basePath", path).parquet(path)
    return rows.where(F.col("batch") != but).drop("batch") if but is not None else rows.drop("batch")


def take_in(reports: DataFrame, versions: list[str], chapters: dict[str, int], issues_path: str, out_path: str, checkpoint: str, limits: intake.Limits = (intake.MINUTE, intake.HOUR)) -> StreamingQuery:
    """Starts the intake of a stream of (client, ms, seq, payload).

    Each batch writes its outcomes under out_path/batch=<id> and what it creates under issues_path/batch=<id>, and compares
    with the issues of the other batches; a batch that is repeated after a failure overwrites its own folders, so nothing is
    created twice. issues_path must exist, with a folder batch=-1 for issues from elsewhere, empty ones included.
    """
    ready = limited(intake.checked(reports, versions, chapters), limits)

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()  # the state is stepped once
        found = intake.outcomes(intake.checked(rows, versions, chapters), open_issues(spark, issues_path, number))
        found.select("client", "ms", "seq", "outcome", "duplicate_of", "report").write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        done = spark.read.parquet(f"{out_path}/batch={number}").where("outcome = 'created'")
        new = done.select(F.concat(F.lit("new:"), F.col("seq").cast("string")).alias("issue"), *(F.col(f"report.{c}").alias(c) for c in ("version", "book", "chapter", "verses")))
        new.write.mode("overwrite").parquet(f"{issues_path}/batch={number}")
        rows.unpersist()

    return ready.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").start()
