"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its documents in blocks of bounded size. The distinct pieces of a block (matches of the split pattern that
no earlier block of the task had) are laid out as one byte array, and an inverted index from the rank of a token pair to
word positions is kept. Ranks are replayed in order from a heap: each step merges all positions of the lowest rank at once
and updates only their neighbours. Of several occurrences in one word the leftmost goes first, and a merge that makes a
lower rank possible is followed by that one, so the ids are those of the usual word-by-word encoder. Words longer than
LONG bytes are replayed alone from a heap of their own.

No shuffle and no driver state: memory is bounded by the block size and the piece table, which is emptied beyond KEPT
chunks and at the end of a task.
Edge cases: null and empty texts have no ids; bytes are those of UTF-8; other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import frugal, trim
from .words import blocks, chunks, data_of

KEPT, BLOCK_BYTES, PART = 250_000, 8_000_000, 20_000  # chunks that a table keeps; bytes of text encoded, chunks learned at once
#: The usual split pattern for texts below U+0250, with its classes written out for the faster `re` module.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_beyond_latin = re.compile("[^\x00-\u024f]").search
LONG = 2_000
NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank file (base64 token and rank in each line) as arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        top = max(self.token) + 1
        size = np.zeros(top, np.int64)
        for r, t in self.token.items():
            size[r] = len(t)
        self.size, self.start = size, np.concatenate([[0], np.cumsum(size)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(top)), np.uint8)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.made = np.arange(top, dtype=np.int32)  # the token that a merge makes: in rank files, its rank
        self.final = self.byte
        self.index(pairs)

    def index(self, pairs: dict[int, int]) -> None:
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.of_key = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each token pair, NONE where it doesn't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.of_key[at], NONE)


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def replay(words: list[bytes], table: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one word after another, and the number of ids of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int32), sizes
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(words), np.uint8)
    token = table.byte[data]
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    last = ends[sizes > 0] - 1
    token[last] = table.final[data[last]]
    after[last] = -1
    before[(ends - sizes)[sizes > 0]] = -1
    pair = np.full(n, NONE, np.int32)
    inner = np.flatnonzero(after >= 0)
    pair[inner] = table.of(token[inner], token[inner + 1])
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(at: np.ndarray) -> None:
        r = pair[at]
        at, r = at[r != NONE], r[r != NONE]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for rank, part in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(heap, rank)

    put(inner)
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = np.concatenate(parts) if len(parts) > 1 else parts[0]
        at = np.sort(at[pair[at] == rank])
        if not len(at):
            continue
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        w = word[at]
        first = np.ones(len(at), bool)
        first[1:] = w[1:] != w[:-1]
        if not first.all():  # the leftmost of each word; the others wait
            index[rank] = [at[~first]]
            heapq.heappush(heap, rank)
            at = at[first]
        right = after[at]
        token[at] = table.made[rank]
        alive[right], pair[right] = False, NONE
        beyond = after[right]
        after[at] = beyond
        pair[at] = NONE
        has = beyond >= 0
        before[beyond[has]] = at[has]
        pair[at[has]] = table.of(token[at[has]], token[beyond[has]])
        prior = before[at]
        left, mine = prior[prior >= 0], at[prior >= 0]
        pair[left] = table.of(token[left], token[mine])
        put(np.concatenate([at[has], left]))
    return token[alive], np.bincount(word[alive], minlength=len(words))


def replay_long(text: bytes, table: Ranks) -> np.ndarray:
    """Ids of one long word: the same replay with a heap of (rank, position)."""
    n = len(text)
    token = [int(table.byte[b]) for b in text[:-1]] + [int(table.final[text[-1]])]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    pairs = table.pairs
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(token[i] << 32 | token[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or pairs.get(token[i] << 32 | token[j]) != rank:
            continue
        token[i], alive[j], after[i] = int(table.made[rank]), False, after[j]
        k = after[i]
        if k < n:
            before[k] = i
            if (r := pairs.get(token[i] << 32 | token[k])) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := pairs.get(token[h] << 32 | token[i])) is not None:
            heapq.heappush(heap, (r, h))
    return np.array([t for t, a in zip(token, alive) if a], np.int32)


class Numbers(defaultdict):
    """Numbers its keys as they are first looked up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Vocabulary:
    """Ids of distinct chunks, learned block by block; chunks met before are looked up."""

    def __init__(self, find: Callable[[str], list[str]], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = KEPT):
        self.find, self.learn, self.most = find, learn, most
        self.clear()

    def clear(self) -> None:
        self.number, self.pieces = Numbers(), Numbers()
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)  # of chunks
        self.piece_flat, self.piece_size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of ids of each text."""
        if len(self.number) > self.most:
            self.clear()
        codes, distinct, each = chunks(data, cuts)
        names = np.empty(len(distinct), np.int32)
        for i in range(0, len(distinct), PART):  # in parts, as Python objects take much memory
            part = distinct.slice(i, PART).to_pylist()
            names[i : i + len(part)] = np.fromiter(map(self.number.__getitem__, part), np.int32, len(part))
        known = len(self.size)
        if len(self.number) > known:
            new, used, each_split = islice(self.number, known, None), [], []
            while split := [self.find(x.decode("utf-8", "replace")) for x in islice(new, PART)]:
                used.append(np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split)), np.int32))
                each_split.append(np.fromiter(map(len, split), np.int64, len(split)))
            ids, counts = self.learn(list(islice(self.pieces, len(self.piece_size), None)))
            self.piece_flat, self.piece_size = np.concatenate([self.piece_flat, ids]), np.concatenate([self.piece_size, counts])
            flat, size = joined(self.piece_flat, self.piece_size, np.concatenate(used), np.concatenate(each_split))
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        return joined(self.flat, self.size, names[codes], each)


class Encoder:
    """Encodes blocks of texts by a rank file and a split pattern.

    The usual pattern never matches across the start of an ASCII white-space run, so its texts are cut there and each
    distinct chunk is split once; texts with other white space, and other patterns, take the pattern's own way.
    """

    def __init__(self, path: str, pattern: str):
        self.table, self.find_any = ranks(path), regex.compile(pattern).findall
        self.usual = pattern == USUAL
        self.chunked, self.whole = Vocabulary(self.find, self.learn), Vocabulary(self.find_any, self.learn)

    def find(self, text: str) -> list[str]:
        return LATIN(text) if text.isascii() or not _beyond_latin(text) else self.find_any(text)

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        rank = self.table.rank
        order = [[], [], []]  # whole tokens, which need no merges; words; long words
        for i, b in enumerate(data):
            order[0 if b in rank else 2 if len(b) > LONG else 1].append(i)
        ids, counts = replay([data[i] for i in order[1]], self.table)
        alone = [replay_long(data[i], self.table) for i in order[2]]
        flat = np.concatenate([np.array([rank[data[i]] for i in order[0]], np.int32), ids, *alone])
        size = np.concatenate([np.ones(len(order[0]), np.int64), counts, np.fromiter(map(len, alone), np.int64, len(alone))])
        back = np.argsort(np.array(sum(order, []), np.int64))
        return ragged(flat, (np.cumsum(size) - size)[back], size[back]), size[back]

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of ids of each text."""
        odd = other_space(data, cuts) if self.usual else np.ones(len(cuts) - 1, bool)
        if not odd.any():
            return self.chunked.encode(data, cuts)
        parts = []
        for i, strange in enumerate(odd.tolist()):
            text = data[cuts[i] : cuts[i + 1]]
            if strange:
                pieces = self.find_any(text.tobytes().decode("utf-8", "replace"))
                parts.append((np.concatenate([self.piece(p) for p in pieces]) if pieces else np.zeros(0, np.int32)))
            else:
                parts.append(self.chunked.encode(text, np.array([0, len(text)]))[0])
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def clear(self) -> None:
        self.chunked.clear()
        self.whole.clear()

    def piece(self, piece: str) -> np.ndarray:
        return self.whole.encode(np.frombuffer(piece.encode(), np.uint8), np.array([0, len(piece.encode())]))[0]


def other_space(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Texts that may hold white space beyond ASCII, by the lead bytes of such characters."""
    second = np.append(data[1:], 0)
    lead = (data == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (data == 0xE1) & (second == 0x9A) | (data == 0xE2) & ((second == 0x80) | (second == 0x81)) | (data == 0xE3) & (second == 0x80)
    return np.diff(np.concatenate([[0], np.cumsum(lead)])[cuts]) > 0


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    """A worker's encoder: tasks that it runs one after another share the ranks; each empties the piece table."""
    return Encoder(path, pattern)


def joined(flat: np.ndarray, size: np.ndarray, names: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat (of the given sizes) that the names name, and the total of each list of names."""
    sums = np.concatenate([[0], np.cumsum(size[names])])
    return ragged(flat, (np.cumsum(size) - size)[names], size[names]), np.diff(sums[np.concatenate([[0], np.cumsum(each)])])


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start + size] of each run, one after another."""
    total = int(size.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((start - (np.cumsum(size) - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return values[at]


def _with(table: pa.Table, name: str, column: pa.Array) -> Iterator[pa.RecordBatch]:
    at = table.schema.get_field_index(name)
    table = table.set_column(at, name, column) if at >= 0 else table.append_column(name, column)
    yield from table.combine_chunks().to_batches()


def _schema(df: DataFrame, name: str, kind) -> StructType:
    fields = [StructField(name, kind) if f.name == name else f for f in df.schema.fields]
    return StructType(fields if name in df.columns else [*fields, StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each text as array<int>; a column named as the result is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for table in blocks(batches, text, BLOCK_BYTES):
            ids, counts = encoder.encode(*data_of(table.column(text)))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield from _with(table, out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
            trim()
        encoder.clear()

    return docs.mapInArrow(frugal(run), _schema(docs, out, ArrayType(IntegerType())))


def decode_block(table: Ranks, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all id lists, one after another, and where each list begins; the last entry is the end."""
    size = table.size[ids]
    data = ragged(table.bytes, table.start[ids], size)
    sums = np.concatenate([[0], np.cumsum(size)])
    return np.ascontiguousarray(data), sums[np.concatenate([[0], np.cumsum(counts)])]


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of each id list; null lists give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(ids)).cast(pa.list_(pa.int32()))
            counts = np.asarray(column.value_lengths().fill_null(0))
            data, cuts = decode_block(table, column.flatten().to_numpy(zero_copy_only=False), counts)
            buffers = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]
            yield from _with(pa.Table.from_batches([batch]), out, pa.BinaryArray.from_buffers(pa.binary(), len(counts), buffers))

    return docs.mapInArrow(run, _schema(docs, out, BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str, key: str, text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass without carrying the ids: key, n_tokens, ids_sha256, decoded_sha256 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for table in blocks(batches, text, BLOCK_BYTES):
            ids, counts = encoder.encode(*data_of(table.column(text)))
            data, cuts = decode_block(encoder.table, ids, counts)
            data = memoryview(data)
            decoded = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            ends = np.cumsum(counts).tolist()
            said = [hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip([0, *ends], ends)]
            columns = [table.column(key).combine_chunks(), pa.array(counts, pa.int64()), pa.array(said), pa.array(decoded)]
            yield from pa.table(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"]).to_batches()
            trim()
        encoder.clear()

    fields = [StructField("key", docs.schema[key].dataType), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType())]
    return docs.select(key, text).mapInArrow(frugal(run), StructType([*fields, StructField("decoded_sha256", StringType())])).withColumnRenamed("key", key)
