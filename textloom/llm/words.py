"""Texts of a block cut into words or chunks by array operations, each distinct one being handled once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 16_000_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Batches joined or cut so that each block holds about `most` bytes of text (or one text)."""
    kept: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)).astype(np.int64)
        begin = 0
        while begin < len(size):
            upto = begin + int(np.searchsorted(np.cumsum(size[begin:]), most - total)) + 1
            part = size[begin:upto]
            kept.append(batch.slice(begin, len(part)))
            total += int(part.sum())
            begin += len(part)
            if total >= most:
                yield pa.Table.from_batches(kept)
                kept, total = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def data_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins; the last entry is the end. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.chunked_array([pc.fill_null(c, "") for c in column.chunks if len(c)], pa.string()).combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    else:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _coded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the byte runs from each start to the next (the last to the end), and the distinct runs."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    runs = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = runs.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def chunks(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Chunks (ASCII white space and what follows up to the next): codes, distinct chunks, and the number in each text."""
    space = SPACE[data]
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[cuts[:-1][cuts[:-1] < len(data)]] = True
    starts = np.flatnonzero(start)
    codes, distinct = _coded(data, starts)
    return codes, distinct, np.diff(np.searchsorted(starts, cuts))


def words(data: np.ndarray, cuts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Maximal runs without ASCII white space, A-Z lower-cased: codes, distinct words, and the number in each text."""
    space = SPACE[data]
    inner = ~space
    start = inner.copy()
    start[1:] &= space[:-1]
    first = cuts[:-1][cuts[:-1] < len(data)]
    start[first] = inner[first]
    begin = np.flatnonzero(start)
    kept = data[inner]
    codes, distinct = _coded(LOWER[kept] if lower else kept, begin - np.searchsorted(np.flatnonzero(space), begin))
    return codes, distinct, np.diff(np.searchsorted(begin, cuts))


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte strings."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in distinct.to_pylist()), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings by sums of random numbers, one for each byte and its place; long ones by hashes()."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, distinct.offset * 4).astype(np.int64)
    size = np.diff(offsets)
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(RANDOM[np.minimum(place, PLACES - 1), data], dtype=np.uint64)])
    out = mixed(sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]] + size.astype(np.uint64))
    long = np.flatnonzero(size >= PLACES)
    out[long] = hashes(distinct.take(pa.array(long)))
    return out


PLACES = 64
RANDOM = mixed(mixed(np.arange(1, PLACES * 256 + 1, dtype=np.uint64)) ^ np.uint64(0x9E3779B97F4A7C15)).reshape(PLACES, 256)


def shingles(data: np.ndarray, cuts: np.ndarray, width: int = 5, hashed: Callable[[pa.Array], np.ndarray] = hashes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles in order, and where those of each text begin (the last entry is the end).

    A text of fewer words has one shingle, its whole word sequence; one without words has none.
    """
    codes, distinct, counts = words(data, cuts)
    h = hashed(distinct)[codes]
    n = len(h)
    ends = np.cumsum(counts)
    total = np.zeros(n, np.uint64)
    weight = [np.uint64(mixed(np.array([j + 1], np.uint64))[0] | np.uint64(1)) for j in range(width)]
    for j in range(min(width, n)):
        total[: n - j] += h[j:] * weight[j]
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the end of the text
    keep = left >= width
    # texts of fewer words, from their first word: the words of the next text do not count
    short = (ends - counts)[(counts > 0) & (counts < width)]
    size = counts[(counts > 0) & (counts < width)]
    keep[short], total[short] = True, 0
    for j in range(width - 1):
        more = size > j
        total[short[more]] += h[short[more] + j] * weight[j]
    total += np.uint64(width)
    total[short] += size.astype(np.uint64) - np.uint64(width)
    each = np.where(counts < width, np.minimum(counts, 1), counts - width + 1)
    return mixed(total[keep]), np.concatenate([[0], np.cumsum(each)])
