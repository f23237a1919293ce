"""Removal of long passages that occur more than once, by suffix arrays of shards.

Every start of a LENGTH-byte string is assigned to one anchor: the leftmost smallest hash of the GRAM-byte strings inside
it. Equal strings have equal anchors at equal places, so the starts of one anchor form a window (the bytes of all their
strings), and only windows whose anchor hash occurs again can hold a repeated string. Equal windows are counted, not
copied. Distinct windows of an anchor hash go to one shard; where a hash has a single window, runs of such windows of a
document are joined. Each shard sorts its suffixes by induction (suffixsort), computes the permuted common prefixes, and
finds the starts that share LENGTH bytes with another, windows counting as often as they occur. A window that any part of
all documents holds is salted where its documents are found again.

Nothing is sampled: anchors only decide where a string is compared. A hash with more than HOT distinct windows would make
a shard too large; its strings are counted one by one instead, by two 64-bit hashes, in a shuffle with partial sums.
Edge cases: null texts count as empty; texts shorter than LENGTH lose nothing; of repeated rows each loses all of its
strings, as the others hold them too; rows that share an id are separate; null ids are ids like others. Removed bytes may cut a character: kept bytes
are given as they are, and kept text drops the pieces of cut characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import discard, frugal, salted_join, stored
from .suffixsort import common_prefixes, suffix_array
from .words import blocks, data_of, mixed

LENGTH, GRAM, HOT, SHARD_BYTES, SEGMENT, TEXTS = 400, 200, 4096, 1_000_000, 1 << 20, 2_000_000
_SEED = np.arange(1, 257, dtype=np.uint64)


class Hasher:
    """Hashes of substrings by prefix sums: value of byte i times BASE ** i, modulo 2 ** 64."""

    def __init__(self, size: int, seed: int = 0):
        self.value = mixed(_SEED + np.uint64(seed << 16)) | np.uint64(1)
        base = 0x9E3779B97F4A7C15 + 2 * seed
        self.up = np.cumprod(np.full(size + 1, np.uint64(base % (1 << 64)))) if size else np.ones(1, np.uint64)
        self.down = np.cumprod(np.full(size + 1, np.uint64(pow(base, -1, 1 << 64)))) if size else np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.up[: len(data)])])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def windows(data: np.ndarray, cuts: np.ndarray, length: int, gram: int, hasher: Hasher, segment: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """(doc, first start, last start, anchor hash, window hash) of each window; doc is the number of the text."""
    n, k = len(data), length - gram + 1
    most = np.uint64(2 * segment - 1)
    parts = []
    for a in range(0, n - length + 1, segment):
        b = min(a + segment, n - length + 1)
        x = data[a : b + length - 1]
        sums = hasher.sums(x)
        size = len(x) - gram + 1
        h = hasher.of(sums, np.arange(size), np.arange(gram, size + gram))
        ranked = np.full(-(-size // k) * k, np.uint64(2**64 - 1))
        ranked[:size] = (h & ~most) | np.arange(size, dtype=np.uint64)  # of equal hashes the leftmost
        ranked = ranked.reshape(-1, k)
        before = np.minimum.accumulate(ranked, axis=1).ravel()
        after = np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].ravel()
        s = np.arange(b - a)
        anchor = (np.minimum(after[s], before[s + k - 1]) & most).astype(np.int64)
        doc = np.searchsorted(cuts, s + a, side="right") - 1
        inside = s + a + length <= cuts[doc + 1]
        s, anchor, doc = s[inside], anchor[inside], doc[inside]
        if not len(s):
            continue
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        low, high, anchor = s[new], s[np.append(new[1:], len(s)) - 1], anchor[new]
        placed = mixed(((high - low) << 32 | (anchor - low)).astype(np.uint64))
        parts.append((doc[new], low + a, high + a, h[anchor], mixed(hasher.of(sums, low, high + length) + placed)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))


def repeated_starts(text: np.ndarray, start: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which of the starts (positions in text, with weights) begin a string of the given length that weighs 2 or more."""
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    owner = np.full(len(text), -1, np.int64)
    owner[start] = np.arange(len(start))
    group = np.cumsum(shared[order] < length)
    at = owner[order]
    group, at = group[at >= 0], at[at >= 0]
    total = np.bincount(group, weights=weight[at])
    out = np.zeros(len(start), bool)
    out[at] = total[group] >= 2
    return out


def _records(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """(uid, id, th, low, high, anchor, window) of all windows; starts are bytes of the text.

    uid is a number of the row; only its first window has id and th, which name the row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rows = Hasher(SEGMENT + 2 * length), TaskContext.get().partitionId() << 33
        for table in blocks(batches, text, TEXTS):
            doc, low, high, anchor, window = windows(*(found := data_of(table.column(2))), length, gram, hasher)
            rows, base = rows + table.num_rows, rows
            if not len(doc):
                continue
            begin = found[1][doc]
            first = np.concatenate([[True], doc[1:] != doc[:-1]])
            names = [table.column(i).take(pa.array(doc, mask=~first)) for i in range(2)]
            columns = [pa.array(doc + base), *names, pa.array(low - begin, pa.int32()), pa.array(high - begin, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(window.view(np.int64))]
            yield from pa.table(columns, ["uid", "id", "th", "low", "high", "anchor", "window"]).to_batches(65536)

    return docs.select("id", "th", text).mapInArrow(frugal(run), "uid long, id long, th long, low int, high int, anchor long, window long")


def _items(texts: DataFrame, length: int, shards: int) -> DataFrame:
    """What goes to each shard: (shard, d, data, anchors, windows, offsets, sizes, weights)."""
    names = ["shard", "d", "data", "anchors", "windows", "offsets", "sizes", "weights"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), *(pa.list_(pa.int64()) for _ in range(5))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            bytes_held = 0
            for th, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                joined: list[dict] = []
                for w in [*sorted(wanted, key=lambda w: w["low"]), None]:
                    if joined and (w is None or w["d"] > 1 or w["low"] != joined[-1]["high"] + 1 or w["high"] - joined[0]["low"] > 200_000):
                        first = joined[0]["low"]
                        part = data[first : joined[-1]["high"] + length]
                        rows.append((th % shards, 1, part, [x["anchor"] for x in joined], [x["window"] for x in joined], [x["low"] - first for x in joined], [x["high"] - x["low"] + 1 for x in joined], [x["n"] for x in joined]))
                        bytes_held += len(part)
                        joined = []
                    if w is not None and w["d"] > 1:
                        part = data[w["low"] : w["high"] + length]
                        rows.append((w["anchor"] % shards, w["d"], part, [w["anchor"]], [w["window"]], [0], [w["high"] - w["low"] + 1], [w["n"]]))
                        bytes_held += len(part)
                    elif w is not None:
                        joined.append(w)
                if bytes_held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, bytes_held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    longs = ", ".join(f"{x} array<long>" for x in names[3:])
    return texts.select("th", "_text", "wanted").mapInArrow(frugal(run), f"shard long, d long, data binary, {longs}")


def _runs(hit: np.ndarray) -> list[int]:
    """Runs of true values as (from, to) pairs, one after another."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()


def _sorted_shards(items: DataFrame, length: int) -> DataFrame:
    """(anchor, window, runs): the repeated starts of each window, by suffix arrays."""

    def shard(group: pa.Table) -> pa.Table:
        size = [len(x.as_buffer()) for x in group.column("data")]
        base = np.cumsum([0, *size])[:-1]
        text = np.frombuffer(b"".join(group.column("data").to_pylist()), np.uint8)
        each = {x: group.column(x).to_pylist() for x in ("anchors", "windows", "offsets", "sizes", "weights")}
        first = np.concatenate([np.array(o, np.int64) + b for o, b in zip(each["offsets"], base)])
        starts, weight = np.array(sum(each["sizes"], []), np.int64), np.array(sum(each["weights"], []), np.int64)
        ends = np.cumsum(starts)
        start = np.repeat(first - (ends - starts), starts) + np.arange(int(ends[-1]))
        hit = repeated_starts(text, start, np.repeat(weight, starts), length)
        runs = [_runs(x) for x in np.split(hit, ends[:-1])]
        out = [(a, w, r) for a, w, r in zip(sum(each["anchors"], []), sum(each["windows"], []), runs) if r]
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["anchor", "window", "runs"])

    return items.groupBy("shard").applyInArrow(shard, "anchor long, window long, runs array<int>")


def _counted(items: DataFrame, length: int) -> DataFrame:
    """(anchor, window, runs) as from the shards, for hashes with very many windows: each string is counted by its hash."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [Hasher(1 << 16, 1), Hasher(1 << 16, 2)]
        for batch in batches:
            for data, anchor, window, size, weight in zip(*(batch.column(i) for i in (0, 1, 2, 3, 4))):
                x, n = np.frombuffer(data.as_buffer(), np.uint8), size[0].as_py()
                s = np.arange(n)
                g = [h.of(h.sums(x), s, s + length).view(np.int64) for h in by]
                same = lambda v: pa.array(np.full(n, v, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(g[0]), pa.array(g[1]), same(anchor[0].as_py()), same(window[0].as_py()), pa.array(s, pa.int32()), same(weight[0].as_py())], ["g1", "g2", "anchor", "window", "start", "weight"])

    rows = items.select("data", "anchors", "windows", "sizes", "weights").mapInArrow(frugal(grams), "g1 long, g2 long, anchor long, window long, start int, weight long")
    often = rows.groupBy("g1", "g2").agg(F.sum("weight").alias("total")).where("total >= 2").drop("total")
    starts = rows.join(often, ["g1", "g2"], "left_semi").groupBy("anchor", "window").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    pairs = F.flatten(F.transform("starts", lambda s: F.array(s, s + 1)))
    return starts.select("anchor", "window", pairs.alias("runs"))


def _by_row(left: DataFrame, right: DataFrame, how: str = "inner", key: str = "id", th: str = "th") -> DataFrame:
    """Joins by the row's name; a null id equals a null id. The keys and columns of the left come first."""
    right = right.withColumnsRenamed({key: "__right_id", th: "__right_th"})
    on = F.col(key).eqNullSafe(F.col("__right_id")) & (F.col(th) == F.col("__right_th"))
    return left.join(right, on, how).drop("__right_id", "__right_th")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, th, spans) of the texts with repeated passages: spans are (from, to) byte pairs, one after another, maximal runs.

    th is the xxhash64 of the text; id and th name the row, compared null-safe.
    """
    named = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("_text"))
    records = stored(_records(named, "_text", length, gram))
    names = stored(records.where("th IS NOT NULL").select("uid", "id", "th"))
    counts = stored(records.groupBy("anchor").agg(F.count("*").alias("n")).where("n >= 2"))
    rows = stored(salted_join(records.drop("id", "th"), counts.select("anchor"), ["anchor"], counts=counts))
    discard(records, counts)
    place = F.struct("uid", "low", "high")
    distinct = stored(rows.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min(place).alias("at")))
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("d"))
    again = stored(distinct.join(kinds, "anchor").select("anchor", "window", "n", "d", "at.*"))
    discard(distinct)
    total = again.agg(F.sum(F.when(F.col("d") > 1, F.col("high") - F.col("low") + length).otherwise(F.col("high") - F.col("low") + 20))).first()[0] or 0
    shards = int(total // shard_bytes) + 1
    wanted = again.groupBy("uid").agg(F.collect_list(F.struct("low", "high", "anchor", "window", "n", "d")).alias("wanted")).join(names, "uid").drop("uid")
    texts = _by_row(named, wanted)
    items = _items(texts, length, shards)
    if again.where(F.col("d") > hot).limit(1).count():
        items = stored(items)
        found = _sorted_shards(items.where(F.col("d") <= hot), length).unionAll(_counted(items.where(F.col("d") > hot), length))
    else:
        found = _sorted_shards(items, length)
    found = stored(found.groupBy("anchor", "window").agg(F.max("runs").alias("runs")))
    discard(again)
    # every window like it loses the same strings
    hits = salted_join(rows.select("uid", "low", "anchor", "window"), found, ["anchor", "window"]).groupBy("uid").agg(F.collect_list(F.struct("low", "runs")).alias("hits"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for hit in batch.column(1).to_pylist():
                pairs = sorted((h["low"] + a, h["low"] + b - 1 + length) for h in hit for a, b in zip(h["runs"][::2], h["runs"][1::2]))
                out: list[int] = []
                for a, b in pairs:
                    if out and a <= out[-1]:
                        out[-1] = max(out[-1], b)
                    else:
                        out += [a, b]
                spans.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int32()))], ["uid", "spans"])

    spans = hits.mapInArrow(frugal(merge), "uid long, spans array<int>").join(names, "uid")
    out = stored(spans.groupBy("id", "th").agg(F.first("spans").alias("spans")))  # equal rows have equal spans
    discard(rows, found, names)
    return out


def kept_bytes(data: bytes, spans: list[int]) -> bytes:
    cuts = [0, *spans, len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeats(docs, key, text, **options)
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(whole).alias("th"), whole.alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [hashlib.sha256(kept_bytes(t.as_py().encode("utf-8", "surrogatepass"), s)).hexdigest() for t, s in zip(batch.column(2), batch.column(3).to_pylist())]
            gone = [sum(s[1::2]) - sum(s[::2]) for s in batch.column(3).to_pylist()]
            count = [len(s) // 2 for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string())], ["id", "th", "n_removed", "n_spans", "kept"])

    changed = _by_row(named, found).mapInArrow(frugal(cut), "id long, th long, n_removed long, n_spans long, kept string").dropDuplicates(["id", "th"])
    rows = named.select("id", "th", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("own"))
    out = _by_row(rows, changed, "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "own").alias("kept_sha256"))


def long_spans(data: bytes, spans: list[int], words: int) -> list[int]:
    """The spans of LENGTH bytes or of so many words."""
    return [x for a, b in zip(spans[::2], spans[1::2]) if b - a >= LENGTH or len(data[a:b].split()) >= words for x in (a, b)]


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 0, **options) -> DataFrame:
    """The documents, with repeated passages removed from their texts; columns stay as they are.

    words: of the passages under LENGTH bytes, which a smaller length finds, those with fewer words stay.
    """
    names = {"id": "__id", "th": "__th", "spans": "__spans"}  # no column of the documents may have these
    found = repeats(docs, key, text, **options).withColumnsRenamed(names)
    named = docs.withColumns({"__id": F.col(key).cast("long"), "__th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    joined = _by_row(named, found, "left", "__id", "__th")
    at = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            column = batch.column(at)
            for i, s in enumerate(spans):
                spans[i] = long_spans(column[i].as_py().encode("utf-8", "surrogatepass"), s, words) if s and words else s
            texts = [kept_bytes(column[i].as_py().encode("utf-8", "surrogatepass"), s).decode("utf-8", "ignore") if s else column[i].as_py() for i, s in enumerate(spans)]
            columns = [pa.array(texts, column.type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.select(*docs.columns, "__spans").mapInArrow(frugal(cut), docs.schema)
