"""Rate limits with windows that start at a key's first event (T1, T2, T4, T5): batch folds over sorted events.

These are not tumbling or session windows: a window is replaced when an event comes more than its length after its start.
A gap of more than a window's length always begins a new one, so a key's events are cut there and the parts folded apart:
what is gathered is one uninterrupted stretch of a key, 8 bytes an event, and a fold carries a few numbers only.
The streaming form is in textloom.streaming.limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _stretches(events: DataFrame, key: str, ms: str, window_ms: int) -> DataFrame:
    """(key, _t): sorted times of each stretch of a key without a gap of more than the window."""
    w = Window.partitionBy(key).orderBy(ms)
    begins = F.coalesce((F.col(ms) - F.lag(ms).over(w) > window_ms).cast("int"), F.lit(0))
    rows = events.select(key, ms).withColumn("_new", begins)
    rows = rows.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_part").agg(F.array_sort(F.collect_list(ms)).alias("_t"))


def _step(state: Column, window_ms: int, at: Column, name: str) -> tuple[Column, Column]:
    """Count and start of a window after an event."""
    fresh = (state[f"{name}n"] == 0) | (at - state[f"{name}s"] > window_ms)
    n = F.when(fresh, F.lit(1).cast("bigint")).otherwise(state[f"{name}n"] + 1)
    return n.alias(f"{name}n"), F.when(fresh, at).otherwise(state[f"{name}s"]).cast("bigint").alias(f"{name}s")


def _zero(*names: str) -> list[Column]:
    return [F.lit(0).cast("bigint").alias(x) for x in names]


def hits(events: DataFrame, key: str, ms: str, window_ms: int, threshold: int) -> DataFrame:
    """Per key: events, windows begun, events at or over the threshold, and the first such time (T1, T4: a ban)."""
    zero = F.struct(*_zero("n", "s", "windows", "hits"), F.lit(None).cast("bigint").alias("first"))

    def step(acc: Column, t: Column) -> Column:
        n, s = _step(acc, window_ms, t, "")
        over = n >= threshold
        return F.struct(n, s, (acc["windows"] + (n == 1).cast("bigint")).alias("windows"), (acc["hits"] + over.cast("bigint")).alias("hits"), F.coalesce(acc["first"], F.when(over, t)).cast("bigint").alias("first"))

    parts = _stretches(events, key, ms, window_ms).select(key, F.size("_t").alias("_n"), F.aggregate("_t", zero, step).alias("_f"))
    sums = [F.sum(c).cast("int").alias(n) for c, n in (("_n", "events"), ("_f.windows", "windows"), ("_f.hits", "hits"))]
    return parts.groupBy(key).agg(*sums, F.min("_f.first").alias("first_hit"))


def allowed(events: DataFrame, key: str, ms: str, limits: list[tuple[int, int]]) -> DataFrame:
    """Per key: events and how many were allowed under all (window, limit) pairs; denied ones count too."""
    zero = F.struct(*_zero(*(f"{i}{x}" for i in range(len(limits)) for x in "ns"), "allowed"))

    def step(acc: Column, t: Column) -> Column:
        states = [_step(acc, window, t, str(i)) for i, (window, _) in enumerate(limits)]
        right = F.lit(True)
        for (n, _), (_, most) in zip(states, limits):
            right = right & (n <= most)
        return F.struct(*(x for pair in states for x in pair), (acc["allowed"] + right.cast("bigint")).alias("allowed"))

    parts = _stretches(events, key, ms, max(w for w, _ in limits)).select(key, F.size("_t").alias("_n"), F.aggregate("_t", zero, step)["allowed"].alias("_a"))
    return parts.groupBy(key).agg(F.sum("_n").cast("int").alias("events"), F.sum("_a").cast("int").alias("allowed"))
