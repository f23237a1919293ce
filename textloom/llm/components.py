"""Connected components of an edge table by alternating large and small stars, entirely distributed.

Once FEW edges or fewer are left, a single task joins them in memory; that bounds its size and spares the last rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

FEW = 200_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) of a task, by union to the smaller root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node reachable.

    Each round turns every node's neighbours towards the smallest of them (large star: those above the node; small star:
    those below) and is written to the shared folder. The rounds needed grow with the logarithm of the longest path.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stored(now)
    last, left = None, now.count()
    for _ in range(rounds):
        if left <= few:
            return now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(joined, "node long, component long")
        # large star
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own smallest neighbour stays its edge
        kept = least.where("m < u").select("u", F.col("m").alias("v"))
        large = large.unionAll(kept).where("u != v").distinct()
        # small star
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last, left = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
