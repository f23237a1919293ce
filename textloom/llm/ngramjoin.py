"""N-gram Jaccard self-join of documents by grouped prefixes.

A document's set holds its distinct word shingles. All shingles have one order, the rarer first (by the counts of hash
buckets over all documents, then by hash); two sets that are similar enough share a shingle among their first ones, the
prefixes. Documents with equal sets are one class, and classes with equal prefixes and sizes one group. A posting list holds
the groups that share a prefix shingle; it is cut where sizes cannot be similar, and equal lists are checked once. Groups
that cannot be similar by their prefixes leave a list, the others are expanded to their classes; classes that cannot be
similar by a parity bitmap of their sets leave too, and the whole sets of the rest are intersected.

Components are all that is wanted, so what is linked already is not compared again: first each group is checked in its
largest list alone, then the lists that still hold two components, and in these only members of different components.
A list of more than BLOCK members is cut into packs; its first check stays within packs, and later only members outside
the list's main component meet all the others, in blocks. So a group of near copies of any size costs a number of packs in
proportion to it, and no task holds more than two blocks. Frequent shingles are salted before their lists are gathered.
Lists are made in ROUNDS, each of its share of the shingles, so that only a part of the prefixes is on disk twice.

The counts go over all documents, their size is fixed (2 ** BITS buckets, sent as levels of one byte, STEPS to a doubling,
so that a shared shingle stands out from a bucket's other ones also where these are many); so is that of the bitmap of rows
whose sets are fetched (2 ** FETCHED bits). Every pair of linked classes is met, so no link is lost and none is invented:
intersections are counted on 64-bit shingle hashes.
Edge cases: null and empty texts, and texts of white space only, have no shingles and link with nothing; rows with equal
sets link with each other; rows that share an id are separate documents that give one id. A row with a null id links
others; its own component is null where it has no id to give. Ids are integers. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, frugal, release, salted_join, stored
from .components import components
from .words import blocks, data_of, mixed, shingles, word_hashes

PERCENT, WIDTH, BITS, CHUNK, BLOCK, TEXTS = 80, 5, 22, 1 << 14, 1024, 4_000_000  # TEXTS: bytes that a task holds at once
FETCHED, SALTED = 26, 16  # bits of the filter of rows fetched; doublings from which a shingle's list is salted
STEPS = 8  # levels to a doubling
ROUNDS, ROUND_BYTES = 4, 8_000_000  # rounds at most; bytes of prefixes that are worth another
UNITS = "list binary, many boolean, pack long, grp long"


def sets_of(column: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    values, at = shingles(*data_of(column), width, word_hashes)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        x = np.sort(values[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
    return out


def shingle_levels(docs: DataFrame, text: str, width: int, bits: int = BITS) -> np.ndarray:
    """Logarithm (base 2, in parts of 1 / STEPS) of the number of documents with a shingle of each hash bucket; the array has 2 ** bits bytes."""

    size = min(CHUNK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for table in blocks(batches, text, TEXTS):
            sets = sets_of(table.column(text), width)
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=len(counts))
        for i in range(0, len(counts), size):
            if most := int((part := counts[i : i + size]).max()):
                kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u8"
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.astype(kind).tobytes()], pa.binary())], ["at", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // size}").astype(np.int64)
        level = np.minimum(np.ceil(STEPS * np.log2(np.maximum(total, 1) + 0.5)), 255).astype(np.uint8)
        return pa.table({"at": group.column("at")[:1], "level": pa.array([level.tobytes()], pa.binary())})

    rows = docs.select(text).mapInArrow(frugal(count), "at long, counts binary").groupBy("at").applyInArrow(add, "at long, level binary").collect()
    levels = np.zeros(1 << bits, np.uint8)
    for r in rows:
        levels[r["at"] : r["at"] + size] = np.frombuffer(r["level"], np.uint8)
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def parity_bitmap(x: np.ndarray, size: int) -> bytes:
    """For each of `size` (a power of two) buckets, whether an odd number of the hashes falls into it.

    Two bitmaps differ in no more places than their sets have elements of one of them alone, also after folding.
    """
    return np.packbits((np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _power(n: int, least: int, most: int) -> int:
    return 1 << min(most, max(least, int(n - 1).bit_length()))


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the shortest."""
    least = min(map(len, maps))
    out = np.empty((len(maps), least // 8), np.uint64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        while x.nbytes > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _documents(docs: DataFrame, key: str, text: str, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """(id, th, n, node, grp, prefix, tail, low, bits): the class of equal sets, the group of equal prefixes and sizes.

    tail is the place of the prefix's last shingle in the order of all shingles, cut to 63 bits; low and bits are parity
    bitmaps of the prefix and of the set.
    """
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - int(levels.size).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "_text", TEXTS):
            rows: list[tuple] = []
            for x in sets_of(table.column("_text"), width):
                n = len(x)
                if not n:
                    rows.append((0, None, None, None, None, None, None))
                    continue
                first = x[np.argsort(sent.value[(x >> shift).astype(np.int64)], kind="stable")[: prefix_length(n, percent)]]
                prefix, end = first.tobytes(), first[-1]
                tail = int(sent.value[int(end >> shift)]) << 55 | int(end) >> 9
                low, bits = parity_bitmap(first, _power(8 * len(first), 6, 14)), parity_bitmap(x, _power(2 * n, 6, 16))
                rows.append((n, _signed(xxhash.xxh3_64_intdigest(x.tobytes(), n)), _signed(xxhash.xxh3_64_intdigest(prefix, n)), prefix, tail, low, bits))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            columns = [table.column("id"), table.column("th"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
            yield from pa.table(columns, ["id", "th", "n", "node", "grp", "prefix", "tail", "low", "bits"]).to_batches(4096)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("_text"))
    return rows.mapInArrow(frugal(run), "id long, th long, n long, node long, grp long, prefix binary, tail long, low binary, bits binary")


def _tokens(known: DataFrame, levels: np.ndarray, salted: int, share: int = 0, shares: int = 1) -> DataFrame:
    """(token, salt, n, grp) of each prefix shingle in a share of all; a task gives those of a group it has just had once."""
    sent = known.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - int(levels.size).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, g in enumerate(batch.column(0).to_pylist()):
                if g not in seen:
                    seen.add(g)
                    new.append(i)
            if len(seen) > 200_000:
                seen.clear()
            if not new:
                continue
            parts = [np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64) for i in new]
            each = np.fromiter(map(len, parts), np.int64, len(parts))
            token = np.concatenate(parts)
            grp, n = (np.repeat(np.asarray(batch.column(j))[new], each) for j in (0, 1))
            if shares > 1:
                mine = (token & np.uint64(0xFFFF)) % np.uint64(shares) == share
                token, grp, n = token[mine], grp[mine], n[mine]
            over = np.maximum(-(-sent.value[(token >> shift).astype(np.int64)].astype(np.int64) // STEPS) - salted, 0)
            salt = (mixed(grp.view(np.uint64) ^ token) & ((np.uint64(1) << over.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            columns = [pa.array(token.view(np.int64)), pa.array(np.where(over > 0, salt + 1, 0)), pa.array(n), pa.array(grp)]
            yield from pa.table(columns, ["token", "salt", "n", "grp"]).to_batches(65536)

    return known.where("n > 0").select("grp", "n", "prefix").mapInArrow(frugal(run), "token long, salt long, n long, grp long")


def _lists(tokens: DataFrame, percent: int, block: int) -> DataFrame:
    """(list, many, pack, grp): distinct posting lists of two groups or more; many: of packs, or salted.

    A task streams the tokens in order and holds one pack at most. Equal lists are known by two 64-bit sums.
    """
    names = ["list", "many", "pack", "grp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held = [np.zeros(0, np.int64)] * 4
        packs, segment = 0, 0  # of the list that is held, which goes on

        def big(part: list[np.ndarray], pack: int) -> pa.RecordBatch:
            name = xxhash.xxh3_128_digest(f"{part[0][0]}:{segment}")
            count = len(part[3])
            return pa.RecordBatch.from_arrays([pa.array([name] * count, pa.binary()), pa.array([True] * count), pa.array(np.full(count, pack)), pa.array(part[3])], names)

        def small(token: np.ndarray, salt: np.ndarray, n: np.ndarray, grp: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The lists that end here, all of them whole and without a salt."""
            cut = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
            at = np.concatenate([[0], np.flatnonzero(cut) + 1])
            size = np.diff(np.append(at, len(token)))
            sums = [np.add.reduceat(mixed(grp.view(np.uint64) + np.uint64(seed)), at) for seed in (0, 0x9E3779B97F4A7C15)]
            two = np.flatnonzero(size > 1)
            _, once = np.unique(sums[0][two] ^ mixed(sums[1][two]), return_index=True)
            named, grps = [], []
            for i in two[np.sort(once)].tolist():
                name = (int(sums[0][i]), int(sums[1][i]))
                if name not in seen:
                    seen.add(name)
                    named.append((name[0].to_bytes(8) + name[1].to_bytes(8), int(size[i])))
                    grps.append(grp[at[i] : at[i] + size[i]])
            if len(seen) > 300_000:
                seen.clear()  # equal lists are found again by distinct()
            if named:
                lists = pa.array([x for x, _ in named], pa.binary()).take(pa.array(np.repeat(np.arange(len(named)), [c for _, c in named])))
                count = len(lists)
                yield pa.RecordBatch.from_arrays([lists, pa.array(np.zeros(count, bool)), pa.array(np.zeros(count, np.int64)), pa.array(np.concatenate(grps))], names)

        def close() -> Iterator[pa.RecordBatch]:
            """What is held is the end of a list."""
            nonlocal packs, segment
            if len(held[0]) and (packs or held[1][0]):
                yield big(held, packs + (int(held[1][0]) << 32))
            elif len(held[0]) > 1:
                yield from small(*held)
            packs, segment = 0, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(i)) for i in range(4)]
            if len(held[0]):
                now = [np.concatenate(x) for x in zip(held, now)]
            keep = np.ones(len(now[0]), bool)  # one row of each group
            keep[1:] = (now[3][1:] != now[3][:-1]) | (now[0][1:] != now[0][:-1])
            now = [x[keep] for x in now]
            token, salt = now[0], now[1]
            new = np.concatenate([[0], np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(token)]])
            size = np.diff(new)
            whole = np.zeros(len(size), bool)  # ends in this batch, is small and not the end of a larger list
            whole[:-1] = (size[:-1] <= block) & (salt[new[:-2]] == 0)
            if packs and len(whole) > 1:
                whole[0] = False
            if whole.any():
                mask = np.repeat(whole, size)
                yield from small(*(x[mask] for x in now))
            for i in np.flatnonzero(~whole).tolist():
                held = [x[new[i] : new[i + 1]] for x in now]
                while len(held[0]) > block:
                    yield big([x[:block] for x in held], packs + (int(held[1][0]) << 32))
                    held, packs = [x[block:] for x in held], packs + 1
                if i + 1 < len(size):
                    yield from close()
                    held = [np.zeros(0, np.int64)] * 4
        if len(held[0]):
            yield from close()

    rows = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "grp")
    return rows.mapInArrow(frugal(run), UNITS)


def _all_lists(known: DataFrame, levels: np.ndarray, salted: int, percent: int, block: int, round_bytes: int, rounds: int = ROUNDS) -> DataFrame:
    """The lists of all prefix shingles, each list once, stored."""
    shares = int(min(rounds, 1 + (known.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // round_bytes))
    found = []
    for share in range(shares):
        release(known.sparkSession)
        found.append(stored(_lists(_tokens(known, levels, salted, share, shares), percent, block)))
    release(known.sparkSession)
    out = stored(reduce(DataFrame.unionAll, found).distinct())
    discard(*found)
    return out


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Rows with equal values of a column, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = np.asarray(batch.column(column)) if not pa.types.is_binary(batch.column(column).type) else np.array(batch.column(column).to_pylist(), object)
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and held[-1].column(column)[0].as_py() != part.column(column)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)



def forest(sets: list[np.ndarray], linked: Callable[[np.ndarray, int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (sorted); linked(shared, x, others) says which others x is linked with.

    shared[i]: the elements of set others[i] that set x has.
    """
    n = len(sets)
    if n == 2:
        shared = np.array([np.isin(sets[1], sets[0]).sum()])
        return [(0, 1)] if linked(shared, 0, np.array([1]))[0] else []
    size = np.fromiter(map(len, sets), np.int64, n)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    waiting, left, out = np.ones(n, bool), n, []
    held = n  # sets that flat still has
    for start in range(n):
        if not waiting[start]:
            continue
        waiting[start] = False
        left -= 1
        todo = [start]
        while todo and left:
            x = todo.pop()
            if left < held // 2:
                keep = waiting[owner]
                flat, owner, held = flat[keep], owner[keep], left
            own = sets[x]
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            shared = np.bincount(owner[own[at] == flat], minlength=n)
            others = np.flatnonzero(waiting)
            new = others[linked(shared[others], x, others)]
            waiting[new] = False
            left -= len(new)
            todo += new.tolist()
            out += [(x, y) for y in new.tolist()]
    return out




def links(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs (of different labels) among sets of sorted distinct hashes."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    label = np.arange(len(sets)) if label is None else label
    return forest(sets, lambda shared, x, y: (100 * shared >= percent * (size[x] + size[y] - shared)) & (label[x] != label[y]))


def parts_of(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[list[int]]:
    """Connected parts of n members; near(x, others) says which others may be similar to member x."""
    waiting, out = np.arange(n), []
    while len(waiting):
        part, todo = [], [int(waiting[0])]
        waiting = waiting[1:]
        while todo:
            x = todo.pop()
            part.append(x)
            if len(waiting):
                found = near(x, waiting)
                todo += waiting[found].tolist()
                waiting = waiting[~found]
        out.append(sorted(part))
    return out


def groups_near(low: list[bytes], n: np.ndarray, tail: np.ndarray, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """By prefixes: shared are at most those of the prefixes, and what remains of the set whose prefix ends first."""
    maps, p = folded(low), prefix_length(n, percent)
    rest = n - p

    def near(x: int, y: np.ndarray) -> np.ndarray:
        shared = np.minimum((p[x] + p[y] - np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)) // 2, np.minimum(p[x], p[y]))
        more = np.where(tail[x] < tail[y], rest[x], np.where(tail[x] > tail[y], rest[y], np.maximum(rest[x], rest[y])))
        most = np.minimum(shared + more, np.minimum(n[x], n[y]))
        return (100 + percent) * most >= percent * (n[x] + n[y])

    return near


def classes_near(bits: list[bytes], n: np.ndarray, label: np.ndarray, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """By the bitmaps of whole sets; members of one label are not compared."""
    maps = folded(bits)

    def near(x: int, y: np.ndarray) -> np.ndarray:
        shared = (n[x] + n[y] - np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)) // 2
        most = np.minimum(shared, np.minimum(n[x], n[y]))
        return ((100 + percent) * most >= percent * (n[x] + n[y])) & (label[x] != label[y])

    return near


def _narrowed(lists: DataFrame, groups: DataFrame, percent: int, block: int) -> DataFrame:
    """(list, many, pack, grp, slots): lists without groups that cannot be similar to another; a list may fall into several.

    slots: parts that the classes of a pack are dealt to, so that each has about a block. Lists of packs stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bool, int, int, int]] = []
        names, kinds = ["list", "many", "pack", "grp", "slots"], (pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        for group in runs(batches, 0):
            n, m, tail, grp = (np.asarray(group.column(x)) for x in ("n", "m", "tail", "grp"))
            bits = group.column("bits").to_pylist()
            known = np.array([b is not None for b in bits])
            by_low = groups_near(group.column("low").to_pylist(), n, tail, percent)
            by_bits = classes_near([b or b"\0" * max(len(b or b"") for b in bits) for b in bits], n, np.arange(len(n)), percent) if known.any() else None

            def near(x: int, y: np.ndarray) -> np.ndarray:
                out = by_low(x, y)
                if by_bits and known[x]:  # noqa: B023
                    out[out] = by_bits(x, y[out]) | ~known[y[out]]  # noqa: B023
                return out

            for part in parts_of(len(n), near):
                total = int(m[part].sum())
                if total > 1:
                    units = np.sort(grp[part])
                    slots = -(-total // block)
                    name = xxhash.xxh3_128_digest(units.tobytes())
                    out += [(name, slots > 1, 0, g, slots) for g in units.tolist()]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "list binary, many boolean, pack long, grp long, slots long"
    few = lists.where("NOT many").select("list", "grp").join(groups, "grp").select("list", "grp", "low", "bits", "n", "m", "tail")
    few = few.repartition("list").sortWithinPartitions("list").mapInArrow(frugal(run), schema).distinct()
    many = lists.where("many").join(groups.select("grp", "m"), "grp")
    total = many.groupBy("list", "pack").agg(F.ceil(F.sum("m") / block).alias("slots"))
    many = many.join(total, ["list", "pack"]).select("list", "many", "pack", "grp", "slots")
    alone = groups.where("m > 1").select(F.unhex(F.sha2(F.col("grp").cast("string"), 256)).alias("list"), (F.col("m") > block).alias("many"), F.lit(0).cast("long").alias("pack"), "grp", F.ceil(F.col("m") / block).alias("slots"))
    return few.unionAll(many).unionAll(alone)


def _class_sets(docs: DataFrame, key: str, text: str, width: int, classes: DataFrame) -> DataFrame:
    """(node, shingles) of each class (node, rep).

    Texts are not shuffled: those whose name is in a bitmap of the wanted ones, of fixed size, are read into sets, and
    sets that are not wanted go in a join.
    """
    spark = docs.sparkSession
    place = F.pmod("rep", F.lit(1 << FETCHED))
    rows = classes.select((place / 32768).cast("long").alias("at"), (place % 32768).alias("bit")).groupBy("at").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    wanted = np.zeros(1 << FETCHED - 3, np.uint8)
    for r in rows.toLocalIterator():  # 2 ** FETCHED bits at most
        part = np.frombuffer(r["bits"], np.uint8)
        wanted[r["at"] * 4096 : r["at"] * 4096 + len(part)] = part
    sent = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: set[int] = set()
        for table in blocks(chosen(batches), "_text", TEXTS):
            sets = [x for x in sets_of(table.column("_text"), width) if len(x)]
            nodes = [_signed(xxhash.xxh3_64_intdigest(x.tobytes(), len(x))) for x in sets]
            rows = [(n, x.tobytes()) for n, x in dict(zip(nodes, sets)).items() if n not in last]
            last = last | set(nodes) if len(last) < 200_000 else set(nodes)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(0))
            yield batch.filter(pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("_text"))
    texts = texts.select(F.pmod(F.xxhash64("id", "th"), F.lit(1 << FETCHED)).alias("at"), "_text")
    sets = texts.mapInArrow(frugal(run), "node long, shingles binary")
    return sets.join(classes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verified(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links among the members (task, node, label) of each task with different labels."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 0):
            n, label, node = (np.asarray(group.column(x)) for x in ("n", "label", "node"))
            task = group.column("task")[0].as_py()
            for i, part in enumerate(parts_of(len(n), classes_near(group.column("bits").to_pylist(), n, label, percent))):
                if len(part) > 1:
                    name = task + i.to_bytes(4)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.binary()), pa.array(node[part]), pa.array(label[part])], ["task", "node", "label"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in runs(batches, 0):
            node, label = (np.asarray(group.column(x)) for x in ("node", "label"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
            found = links(sets, percent, label)
            a += [int(node[x]) for x, _ in found]
            b += [int(node[y]) for _, y in found]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = members.join(classes.select("node", "n", "bits"), "node").select("task", "node", "label", "n", "bits")
    rows = rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(frugal(narrow), "task binary, node long, label long")
    rows = stored(rows).join(sets, "node").select("task", "node", "label", "shingles")
    return rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(frugal(check), "a long, b long")


def _task(*columns: str) -> Column:
    """Names a task by its list and numbers."""
    return F.concat("list", *(F.encode(F.concat(F.lit(":"), F.col(c).cast("string")), "UTF-8") for c in columns))


def _first_members(units: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(task, node, label): each group's classes in its largest list, within packs; every class is its own label."""
    size = units.join(groups.select("grp", "m"), "grp").groupBy("list").agg(F.sum("m").alias("size"))
    sized = salted_join(units, size, ["list"])
    own = sized.groupBy("grp").agg(F.max_by(F.struct("list", "many", "pack", "slots"), F.struct("size", "list", "pack")).alias("u")).select("grp", "u.*")
    members = classes.select("grp", "node").join(own, "grp").withColumn("slot", F.pmod("node", "slots"))
    return members.select(_task("pack", "slot").alias("task"), "node", F.col("node").alias("label"))


def _second_members(units: DataFrame, classes: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(task, node, label) of the lists that hold more than one label.

    Lists of a block are one task. In longer ones the members outside the main label, in blocks, meet all members in blocks.
    """
    labelled = stored(classes.select("grp", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    bounds = labelled.groupBy("grp").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    divided = units.join(bounds, "grp").groupBy("list").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("list")
    left = salted_join(units, divided, ["list"], "left_semi").select("list", "many", "grp").distinct()
    left = stored(left.join(labelled, "grp").select("list", "many", "node", "label"))
    few = left.where("NOT many").select(_task().alias("task"), "node", "label")
    many = left.where("many")
    if not many.limit(1).count():
        return few
    half = max(1, block // 2)
    counts = many.groupBy("list", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("list").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.select("list", "main", F.ceil(F.col("all") / half).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / half).alias("others"))
    spread = salted_join(many, main, ["list"])
    h = F.xxhash64("node", F.lit(17))
    every = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))).withColumn("block", F.pmod(h, F.col("blocks")))
    apart = spread.where("label <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("other", F.pmod(h, F.col("others")))
    both = every.unionByName(apart.select(*every.columns)).select(_task("other", "block").alias("task"), "node", "label").distinct()
    return few.unionAll(both)


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH, block: int = BLOCK, salted: int = SALTED, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest id reachable by links, its own included).

    Also th, the xxhash64 of the text, and label, which rows of one component share (null without shingles).
    """
    levels = shingle_levels(docs, text, width)
    known = stored(_documents(docs, key, text, levels, width, percent))
    rows = stored(known.select("id", "th", "n", "node"))
    lists = _all_lists(known, levels, salted, percent, block, round_bytes)
    several = known.where("n > 0").groupBy("grp").agg(F.count_distinct("node").alias("m")).where("m > 1").select("grp")
    kept = [F.first(x).alias(x) for x in ("n", "tail", "low", "bits")]
    listed = salted_join(known.drop("prefix"), stored(lists.select("grp").unionAll(several).distinct()), ["grp"], "left_semi")
    classes = stored(listed.groupBy("grp", "node").agg(F.min(F.xxhash64("id", "th")).alias("rep"), *kept))
    discard(known)
    # a group of one class has its bitmap too
    groups = stored(classes.groupBy("grp").agg(F.count("*").alias("m"), *kept).withColumn("bits", F.when(F.col("m") == 1, F.col("bits"))))
    units = stored(_narrowed(lists, groups, percent, block))
    discard(lists)
    wanted = classes.join(units.select("grp").distinct(), "grp", "left_semi")
    sets = stored(_class_sets(docs, key, text, width, wanted.select("node", "rep")))
    # first each group in its largest list alone, which links most of what is alike; then the lists that are still divided
    first = stored(_verified(_first_members(units, groups, wanted), wanted, sets, percent))
    labels = stored(components(first)).withColumnRenamed("component", "label")
    second = stored(_verified(_second_members(units, wanted, labels, block), wanted, sets, percent))
    discard(sets, units, groups, classes)
    labels = stored(components(first.unionAll(second))).withColumnRenamed("component", "label")
    # the smallest id of each component
    member = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("own")).join(labels, "node", "left")
    member = stored(member.withColumn("label", F.coalesce("label", "node")))
    least = member.groupBy("label").agg(F.min("own").alias("least"))
    named = salted_join(member, least, ["label"]).select("node", "label", "least")
    out = salted_join(rows, named, ["node"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), "th", "label")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each component one row of its smallest id; columns stay as they are.

    Of rows of a component that share that id the one with the smallest text hash stays, once. Rows without an id all
    stay; of texts without words one for each id.
    """
    found = stored(similar(docs, key, text, **options))
    first = found.where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("__id"), "label")
    chosen = first.agg(F.min("th").alias("__th")).select("__id", "__th").distinct()
    named = docs.withColumns({"__id": F.col(key).cast("long"), "__th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    counts = found.groupBy(F.col(key).alias("__id"), F.col("th").alias("__th")).agg(F.count("*").alias("__n"))
    chosen = stored(counts.join(chosen, ["__id", "__th"]))
    kept = named.join(chosen, ["__id", "__th"]).unionByName(named.where("__id IS NULL").withColumn("__n", F.lit(1).cast("long")))
    if chosen.where("__n > 1").limit(1).count():
        many = kept.where("__n > 1").dropDuplicates(["__id", "__th"])
        kept = kept.where("__n = 1").unionByName(many)
    return kept.select(*docs.columns)
