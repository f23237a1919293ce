"""The ban store over a stream of requests: the state and the step are those of textloom.operators.bans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import bans


def decided(requests: DataFrame, window_ms: int = bans.WINDOW_MS, threshold: int = bans.THRESHOLD) -> DataFrame:
    """(client, ms, seq, outcome, reason, banned) of each request; those of a batch are taken in the order of ms and seq."""
    kind = dict(requests.dtypes)["client"]
    rows = requests.select("client", F.col("ms").cast("long").alias("ms"), F.col("seq").cast("long").alias("seq"), "kind", F.coalesce(bans.is_probe(F.col("path")), F.lit(False)).alias("probe"), F.coalesce("status", F.lit(0)).cast("int").alias("status"))

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else bans.start()
        out = []
        for r in pd.concat(list(frames)).sort_values(["ms", "seq"]).itertuples():
            now, values = bans.step(now, r.kind, bool(r.probe), int(r.status), int(r.ms), window_ms, threshold)
            out.append((keys[0], r.ms, r.seq, *values))
        state.update(now)
        yield pd.DataFrame(out, columns=["client", "ms", "seq", "outcome", "reason", "banned"])

    schema = f"client {kind}, ms long, seq long, outcome string, reason string, banned boolean"
    return rows.groupBy("client").applyInPandasWithState(run, schema, "banned boolean, count long, begin long", "append", "NoTimeout")
