"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products within them.

Equal vectors are one row with a weight. All rows of one length form one cell; a cell with more than `cell` rows at the start, or more
than BLOCK later, is split into at most FAN cells by spherical k-means on a sample of PER rows for each, so cells stay small
at any size of the table. Cells whose centroids are linked themselves are joined again: what lies that close is mostly
linked, and is compared in blocks. A row belongs to its nearest cell and visits those whose border is within a margin.

The margin is half the chord of the threshold where visits allow: two linked vectors are at most that chord apart, so one
of them is within half of it of the border between their cells, and no pair is missed. Where that means more than `probes`
visits a row, as for vectors without clusters in many dimensions, the margin is what gives so many on the sample, and pairs
near the threshold can be missed (README has the recall); probes=None never does so. A pair that meets in several cells is
counted in the first.

Each cell, or pair of blocks of a cell, is one task: it multiplies them in double precision, adds up each row's links and
gives a spanning forest of what is linked, never the pairs themselves. Components are found over row numbers.
Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths do not link with each other. Rows that share an id are counted one by one and share
its component; a null id counts as a vector and links others, with a null component itself. Ids are integers. Other columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, frugal, salted_join, stored
from .components import components

CELL, FAN, PER, PROBES, BLOCK, LEAST = 256, 256, 32, 4, 4096, 0.9
SENT = 64_000_000  # bytes of centroids that are broadcast at once; a pass over the rows for each lot


def margin_of(least: float) -> float:
    """Half the chord of a cosine, with room for rounding."""
    return float(np.sqrt(max(0.0, (1 - least) / 2))) + 1e-6


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Normalised rows in double precision."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, initial=0, keepdims=True)  # before the norm, which could overflow
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def fit(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; empty cells keep their centroid."""
    centers = rows[:: max(1, len(rows) // k)][:k].copy()
    for _ in range(rounds):
        own = nearest(rows, centers)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
        sums = np.zeros_like(centers)
        sums[own[order][first]] = np.add.reduceat(rows[order], first)
        norm = np.sqrt((sums**2).sum(axis=1))
        centers = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centers)
    return centers


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[i : i + 4096] @ centers.T).argmax(axis=1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)


def slack(rows: np.ndarray, centers: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and its distance to the border of every other (infinite within the same cell)."""
    dots = rows @ centers.T
    home = dots.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 1e-12))
    out = (dots[np.arange(len(rows)), home][:, None] - dots) / gap[home]
    out[child[home][:, None] == child] = np.inf
    return home, out


def split(rows: np.ndarray, k: int, least: float, probes: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Centroids, the cell of each (linked ones share a cell), and the margin of visits."""
    apart = np.arange(len(rows)) % 3 == 2  # rows that centroids were fitted on lie nearer to them than others do
    rows, held = (rows[~apart], rows[apart]) if len(rows) > 2 * k else (rows, rows)
    centers = fit(rows, k)
    i, j = np.nonzero(np.triu(centers @ centers.T >= least, 1))
    child = forest(i, j, len(centers))
    margin = margin_of(least)
    if probes is not None:
        near = np.sort(np.concatenate([(x := slack(held[a : a + 1024], centers, child)[1])[x <= margin] for a in range(0, len(held), 1024)]))
        wanted = int(probes * len(held))
        margin = float(near[wanted]) if len(near) > wanted else margin
    return centers, child, margin


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest position that each of n positions reaches over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _fitted(now: DataFrame, sizes: DataFrame, cell: int, least: float, probes: float | None) -> DataFrame:
    """(cell, n, size, centers, child, margin) of cells that fall into several; sizes: (cell, n) of those to be split."""

    def one(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(np.asarray(group.column("at")), kind="stable"))
        rows = matrix(group.column("vector"))
        centers, child, margin = split(rows, max(2, min(FAN, -(-group.column("n")[0].as_py() // cell))), least, probes)
        name = group.column("cell")[:1]
        if len(np.unique(child)) < 2:
            name, centers = name[:0], centers[:0]
        size = len(name)
        return pa.table([name, group.column("n")[:size], pa.array([rows.shape[1]] * size, pa.int32()), pa.array([centers.tobytes()] * size, pa.binary()), pa.array([child.tobytes()] * size, pa.binary()), pa.array([margin] * size, pa.float64())], ["cell", "n", "size", "centers", "child", "margin"])

    at = F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(1 << 40))
    share = PER * F.least(F.lit(FAN), F.ceil(F.col("n") / cell)) / F.col("n") * (1 << 40)
    rows = now.join(sizes, "cell").withColumn("at", at).where(F.col("at") < share).select("cell", "n", "at", "vector")
    return rows.groupBy("cell").applyInArrow(one, "cell string, n long, size int, centers binary, child binary, margin double")


def _placed(now: DataFrame, fitted: list) -> DataFrame:
    """(uid, cell, was, weight, vector) of the rows of the fitted cells, one for each of their cells on the next level.

    was: rows of the cell before.
    """
    known = {}
    for r in fitted:
        centers = np.frombuffer(r["centers"], np.float64).reshape(-1, r["size"])
        known[r["cell"]] = (centers, np.frombuffer(r["child"], np.int64), r["margin"], r["n"])
    sent = now.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                names = batch.column(1).to_pylist()
                for name in dict.fromkeys(names):
                    if name not in sent.value:
                        continue
                    centers, child, margin, n = sent.value[name]
                    part = batch.take(pa.array([i for i, x in enumerate(names) if x == name]))
                    home, far = slack(matrix(part.column("vector")), centers, child)
                    row, to = np.nonzero(far <= margin)
                    row, to = np.concatenate([np.arange(len(home)), row]), child[np.concatenate([home, to])]
                    row, to = np.unique(np.stack([row, to]), axis=1)
                    cells = [f"{name}.{x}" for x in to.tolist()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(cells), pa.array(np.full(len(row), n)), *(part.column(x).take(pa.array(row)) for x in ("weight", "vector"))], batch.schema.names)

    return now.mapInArrow(frugal(run), now.schema)


def _cells(reps: DataFrame, cell: int, block: int, least: float, probes: float | None) -> DataFrame:
    """(uid, cell) of all rows (uid, weight, vector)."""
    now, done, room, old = reps.select("uid", F.size("vector").cast("string").alias("cell"), F.lit(None).cast("long").alias("was"), "weight", "vector"), None, cell, []
    while True:
        sizes = now.groupBy("cell").agg(F.count("*").alias("n"), F.max("was").alias("was"))
        # a cell that has kept most rows of the one before is not split again
        sizes = sizes.where((F.col("n") > room) & (F.col("was").isNull() | (F.col("n") < 0.75 * F.col("was")))).drop("was")
        fitted = stored(_fitted(now, sizes, cell, least, probes))
        going = now.join(fitted.select("cell"), "cell", "left_anti").select("uid", "cell")
        done = stored(going if done is None else done.unionAll(going))
        rows, lots = fitted.toLocalIterator(), []
        while True:  # centroids of a bounded size at once
            lot, held = [], 0
            for r in islice(rows, 1 << 20):
                lot.append(r)
                held += len(r["centers"])
                if held >= SENT:
                    break
            if not lot:
                break
            lots.append(stored(_placed(now, lot)))
        discard(fitted, *old)
        if not lots:
            return done
        now, old = lots[0], lots
        for x in lots[1:]:
            now = now.unionAll(x)
        room = block


def compare(a: pa.Table, b: pa.Table | None, cell: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of linked weights, and labels, of the rows of both blocks (a then b); b None: a with itself."""
    both = a if b is None else pa.concat_tables([a, b])
    n, na = both.num_rows, a.num_rows
    rows, weight = matrix(both.column("vector")), np.asarray(both.column("weight"))
    codes = both.column("cells").combine_chunks()
    sets = {}
    code = np.array([sets.setdefault(tuple(x), len(sets)) for x in codes.to_pylist()])
    sets = [set(x) for x in sets]
    first = len(sets)
    known: dict[int, bool] = {}
    total, label = np.zeros(n, np.int64), np.arange(n)
    other = 0 if b is None else na
    for at in range(0, na, 512):
        upto = min(at + 512, na)
        low = at if b is None else other
        i, j = np.nonzero(rows[at:upto] @ rows[low:].T >= least)
        i, j = i + at, j + low
        if b is None:
            i, j = i[i < j], j[i < j]
        if first > 1 or len(sets[0]) > 1:  # a pair is counted in the first cell of those that both are in
            pair = code[i] * first + code[j]
            kinds, inverse = np.unique(pair, return_inverse=True)
            for x in kinds.tolist():
                if x not in known:
                    known[x] = min(sets[x // first] & sets[x % first]) == cell
            keep = np.array([known[x] for x in kinds.tolist()], bool)[inverse] if len(kinds) else np.zeros(0, bool)
            i, j = i[keep], j[keep]
        total += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
        old = np.flatnonzero(label != np.arange(n))
        label = forest(np.concatenate([i, old]), np.concatenate([j, label[old]]), n)
    return total, label


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST, cell: int = CELL, block: int = BLOCK, probes: float | None = PROBES) -> DataFrame:
    """One row per vector: key, n_links, component_id and kept (whether it is its component's representative)."""
    v = F.col("vector")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    named = rows.select("id", F.when(usable, F.xxhash64(v)).alias("h"), F.when(usable, F.xxhash64(v, F.lit(1))).alias("g"), F.when(usable, v).alias("vector"))
    members = stored(named.select("id", "h", "g"))
    reps = named.where("vector IS NOT NULL").groupBy("h", "g").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("id").alias("least_id"))
    reps = stored(reps.withColumn("uid", F.monotonically_increasing_id()))
    light = reps.select("uid", "h", "g", "weight", "least_id")
    found = _cells(reps.select("uid", "weight", "vector"), cell, block, least, probes)
    placed = found.groupBy("uid").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    counts = found.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = placed.withColumn("cell", F.explode("cells")).join(counts, "cell").withColumn("own", F.pmod(F.xxhash64("uid"), "blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    dealt = placed.withColumn("pair", F.explode(pairs)).select("uid", "cell", "cells", "own", "pair.i", "pair.j")
    dealt = dealt.join(reps.select("uid", "weight", "vector"), "uid")

    def task(group: pa.Table) -> pa.Table:
        i, j, name = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("cell")[0].as_py()
        mine = np.asarray(group.column("own"))
        a, b = group.filter(pa.array(mine == i)), None if i == j else group.filter(pa.array(mine == j))
        if not a.num_rows or b is not None and not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, ["uid", "n", "peer"])
        total, label = compare(a, b, name, least)
        uid = np.asarray(a.column("uid") if b is None else pa.concat_tables([a, b]).column("uid"))
        keep = np.flatnonzero(total)
        return pa.table([pa.array(uid[keep]), pa.array(total[keep]), pa.array(uid[label[keep]])], ["uid", "n", "peer"])

    linked = stored(dealt.groupBy("cell", "i", "j").applyInArrow(task, "uid long, n long, peer long"))
    links = linked.groupBy("uid").agg(F.sum("n").alias("n"))
    shared = members.where("id IS NOT NULL AND h IS NOT NULL").join(light.select("h", "g", "uid"), ["h", "g"]).select("id", "uid").distinct()
    first = shared.groupBy("id").agg(F.min("uid").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = shared.join(first, "id").select(F.col("uid").alias("a"), "b")
    groups = components(linked.select(F.col("uid").alias("a"), F.col("peer").alias("b")).unionByName(same)).withColumnRenamed("node", "uid")
    grouped = stored(light.join(groups, "uid", "left").withColumn("component", F.coalesce("component", "uid")).join(links, "uid", "left"))
    least_ids = grouped.groupBy("component").agg(F.min("least_id").alias("least_id"))
    result = salted_join(grouped.drop("least_id"), least_ids, ["component"])
    result = result.select("h", "g", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least_id")
    out = salted_join(members, result, ["h", "g"], "left")
    ids = F.col("id").isNotNull()
    mixed = members.where(ids).groupBy("id").agg(F.count_if(F.col("h").isNull()).alias("odd"), F.count("h").alias("usable")).where("odd > 0 AND usable > 0").select("id")
    if mixed.limit(1).count():  # an unusable row that shares its id with a usable one has that id's component too
        by_id = out.where("h IS NOT NULL").join(mixed, "id").groupBy("id").agg(F.min("least_id").alias("by_id"))
        odd = out.where(F.col("h").isNull() & ids).join(by_id, "id", "left").withColumn("least_id", F.col("by_id")).drop("by_id")
        out = out.where(~(F.col("h").isNull() & ids)).unionByName(odd)
    component = F.when(F.col("id").isNotNull(), F.coalesce("least_id", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
