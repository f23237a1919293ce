"""Pairing of versions and word diffs.

Texts are diffed in Arrow batches and classified in the same pass, spread over all tasks of a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels

TOKEN = "array<struct<value:string,op:string,kind:string>>"


def pair_positions(left: DataFrame, right: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Full outer zip by position within the keys, not by number (J1): keys, rn, left_text, right_text ("" where missing)."""
    w = Window.partitionBy(*keys).orderBy(order)
    side = lambda df, name: df.withColumn("rn", F.row_number().over(w)).select(*keys, "rn", F.col(text).alias(name))
    both = side(left, "left_text").join(side(right, "right_text"), [*keys, "rn"], "full_outer")
    return both.select(*keys, "rn", F.coalesce("left_text", F.lit("")).alias("left_text"), F.coalesce("right_text", F.lit("")).alias("right_text"))


def _spread(pairs: DataFrame) -> DataFrame:
    """Dealt to as many tasks as a shuffle has: diffs are work, not data, so small inputs must not end in one task."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *pairs.columns)


def token_lists(tokens: list[list[tuple]], kind: pa.DataType) -> pa.ListArray:
    """Arrow lists of structs from lists of tuples."""
    flat = list(zip(*(t for row in tokens for t in row))) or [()] * kind.num_fields
    fields = [kind.field(i) for i in range(kind.num_fields)]
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, tokens), initial=0)), pa.int32()), structs)


def with_diff(pairs: DataFrame, left: str = "left_text", right: str = "right_text", out: str = "tokens", kinds: bool = True) -> DataFrame:
    """Adds the classified diff of two texts as an array of (value, op, kind) (D-1, D-2, D-5), in one pass.

    Without kinds, which cost the most, kind is null.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + f", {out} {TOKEN}"
    kind = pa.struct([("value", pa.string()), ("op", pa.string()), ("kind", pa.string())])
    named = kernels.classified if kinds else lambda found: [(v, o, None) for v, o in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (left, right))
            tokens = [named(kernels.diff(kernels.display(p), kernels.display(q))) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([*batch.columns, token_lists(tokens, kind)], [*batch.schema.names, out])

    return _spread(pairs).mapInArrow(run, schema)


def diff_counts(pairs: DataFrame, keys: list[str], left: str = "left_text", right: str = "right_text", kinds: bool = True) -> DataFrame:
    """Per row the keys, has_left, has_right, runs of changes (W1) and the changed tokens of each kind (D-5), null without kinds.

    Equal texts reach the kernel as nulls, and no tokens leave it.
    """
    same = F.col(left) == F.col(right)
    sides = [(F.length(c) > 0).alias(n) for c, n in ((left, "has_left"), (right, "has_right"))]
    rows = pairs.select(*keys, *sides, *(F.when(~same, F.col(c)).alias(n) for c, n in ((left, "_x"), (right, "_y"))))
    names = [*keys, "has_left", "has_right"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names) + ", runs int, kinds map<string,bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, counts = [], []
            for x, y in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                tokens = kernels.diff(kernels.display(x), kernels.display(y)) if x is not None else []
                runs.append(kernels.runs([o for _, o in tokens]))
                counts.append(list(Counter(k for _, o, k in kernels.classified(tokens) if o != "eq").items()) if kinds else None)
            columns = [*batch.columns[: len(names)], pa.array(runs, pa.int32()), pa.array(counts, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "runs", "kinds"])

    return _spread(rows).mapInArrow(run, schema)


def changed_runs(tokens: str = "tokens"):
    """Maximal runs of changed tokens of an array."""
    ops = F.transform(tokens, lambda t: t["op"] != "eq")
    before = F.concat(F.array(F.lit(False)), F.slice(ops, F.lit(1), F.greatest(F.size(ops) - 1, F.lit(0))))
    return F.size(F.filter(F.zip_with(ops, before, lambda x, p: x & ~F.coalesce(p, F.lit(False))), lambda x: x))


def chapter_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Variants, changed verses and all verses of each chapter (A1); chapters with an empty side are left out."""
    sums = [F.sum("runs").alias("variant_count"), F.sum((F.col("runs") > 0).cast("int")).alias("changed_verse_count"), F.count("*").alias("total_verse_count")]
    sides = [F.max(c).alias(f"_{c}") for c in ("has_left", "has_right")]
    return diff_counts(pairs, keys, kinds=False).groupBy(*keys).agg(*sums, *sides).where("_has_left AND _has_right").drop("_has_left", "_has_right")


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = 40, band: int = 50) -> DataFrame:
    """Two versions of a text: each document with the next longer one of the same opening (a, b).

    Rows are paired with their successor only, so a common opening costs no more than a sort of its ids. The sort is split
    by bands of length, whose ends are then joined. A text shorter than the prefix is its own opening: it pairs with equal
    texts only. Null ids and texts have no pair.
    """
    rows = docs.select(key, F.xxhash64(F.substring(text, 1, prefix)).alias("_p"), F.length(text).alias("_n"))
    rows = rows.where(F.col(key).isNotNull() & F.col("_n").isNotNull()).withColumn("_band", F.floor(F.col("_n") / band))
    within = rows.withColumn("b", F.lead(key).over(Window.partitionBy("_p", "_band").orderBy("_n", key))).where("b IS NOT NULL").select(F.col(key).alias("a"), "b")
    at = F.struct("_n", key)
    ends = rows.groupBy("_p", "_band").agg(F.min(at)[key].alias("first"), F.max(at)[key].alias("a"))
    ends = ends.withColumn("b", F.lead("first").over(Window.partitionBy("_p").orderBy("_band"))).where("b IS NOT NULL")
    return within.unionByName(ends.select("a", "b"))


def line_pairs(docs: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of both documents of each pair, paired by position: a, b, rn, left_text, right_text."""
    lines = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1)
    left = docs.select(F.col(key).alias("a"), F.col(text).alias("_x"))
    right = docs.select(F.col(key).alias("b"), F.col(text).alias("_y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.arrays_zip(lines("_x").alias("l"), lines("_y").alias("r")).alias("_z"))
    out = both.select("a", "b", F.posexplode("_z").alias("rn", "z"))
    return out.select("a", "b", (F.col("rn") + 1).alias("rn"), F.coalesce("z.l", F.lit("")).alias("left_text"), F.coalesce("z.r", F.lit("")).alias("right_text"))
