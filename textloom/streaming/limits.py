"""Rate limits over a stream: one state per key, as in textloom.operators.limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def step(count: int, start: int, at: int, window_ms: int) -> tuple[int, int]:
    """Count and start of the window after an event at a time; count 0: no event so far."""
    return (1, at) if count == 0 or at - start > window_ms else (count + 1, start)


def limited(events: DataFrame, key: str, ms: str, window_ms: int, threshold: int) -> DataFrame:
    """(key, ms, n, hit) of each event; events of a batch are taken in time order, and no late data is waited for."""
    kind = dict(events.dtypes)[key]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, start = state.get if state.exists else (0, 0)
        rows = []
        for at in sorted(x for f in frames for x in f[ms]):
            count, start = step(count, start, int(at), window_ms)
            rows.append((keys[0], int(at), count, count >= threshold))
        state.update((count, start))
        yield pd.DataFrame(rows, columns=[key, ms, "n", "hit"])

    schema = f"{key} {kind}, {ms} long, n long, hit boolean"
    return events.select(key, ms).groupBy(key).applyInPandasWithState(run, schema, "count long, start long", "append", "NoTimeout")
