"""Packing of documents into token sequences: concatenate and cut.

Two passes. The first tokenises each partition, keeps running token offsets within it, and stores ids as unsigned 16-bit
numbers; the totals of the partitions are summed up to global offsets (one number per partition on the driver). The
second cuts the concatenated ids at fixed windows, row by row; a document that crosses a border gets a boundary record
(piece) on each side. All sequences but the last are full, so there is no padding between documents.

The tokenizer drops white space and splits at it and at letter, digit and sign borders, so each distinct piece is encoded
once and looked up afterwards; the ids are those of encoding the whole text with the library.
Edge cases: null and empty texts give the end-of-document id alone; an empty table gives no pieces; repeated rows are
packed one by one; other columns are not carried.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from .bpe import BLOCK_BYTES, LONG, Ranks, Vocabulary, _L, _N, _S, replay, replay_long
from .common import checkpoint, frugal, trim
from .words import blocks, data_of

LENGTH = 4096
END = 2
#: The tokenizer's own split of a lower-cased word, its classes written out for texts below U+0250.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+").findall
#: Characters that need the library: beyond U+024F, one whose lower case is two, and controls seen as spaces by some.
not_plain = re.compile("[^\x00-\u024f]|[\u0130\x1c-\x1f]").search


class Merges(Ranks):
    """The merges of a tokenizer file with word ends, as arrays for the replay."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the others follow 255
        sign = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printed)}
        self.byte = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[sign[b] + suffix] for b in range(256)], np.int32)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.index({vocab[a] << 32 | vocab[b]: i for i, (a, b) in reversed(list(enumerate(merges)))})


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, lower-cases and marks the ends of words.

    The distinct pieces of Latin words are encoded together by the merge replay; other words by the library itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = Merges(path)
        self.vocabulary = Vocabulary(self.find, self.learn)
        self.encode = self.vocabulary.encode

    def find(self, word: str) -> list[str]:
        """Lower-cased pieces of a Latin word; other words whole."""
        return PIECES(word.lower()) if word.isascii() or not not_plain(word) else [word]

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = {i: p for i, p in enumerate(new) if len(p) > LONG or not_plain(p)}
        ids, counts = replay([b"" if i in alone else p.encode() for i, p in enumerate(new)], self.merges)
        if alone:
            got = np.split(ids, np.cumsum(counts)[:-1])
            for i, p in alone.items():
                plain = not not_plain(p)
                got[i] = replay_long(p.encode(), self.merges) if plain else np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.int32)
            ids, counts = np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
        return ids, counts


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """The tokenizer of a task, which drops it at its end."""
    return WordTokenizer(path)


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """First pass: key, part (of the partition), before (tokens before it there), n_tokens and ids, the end id included.

    ids holds little-endian unsigned 16-bit numbers, or 32-bit ones where the vocabulary needs them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        kind = "<u2" if max(tokenizer.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
        part, before = TaskContext.get().partitionId(), 0
        for table in blocks(batches, text, BLOCK_BYTES):
            ids, counts = tokenizer.encode(*data_of(table.column(text)))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end).astype(kind)
            counts, ends = counts + 1, ends + np.arange(1, len(ends) + 1)
            starts = ends - counts
            width = np.dtype(kind).itemsize
            offsets = np.concatenate([[0], ends]) * width
            data = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
            columns = [table.column(key).combine_chunks(), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + starts), pa.array(counts), data]
            before += int(ends[-1]) if len(ends) else 0
            yield from pa.table(columns, ["key", "part", "before", "n_tokens", "ids"]).to_batches()
            trim()
        tokenizer.vocabulary.clear()
        del tokenizer
        tokenizer_of.cache_clear()  # idle workers would keep its tables
        gc.collect()

    fields = [("part", IntegerType()), ("before", LongType()), ("n_tokens", LongType()), ("ids", BinaryType())]
    schema = StructType([StructField("key", docs.schema[key].dataType), *(StructField(*x) for x in fields)])
    return docs.select(key, text).mapInArrow(frugal(run), schema)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (binary, as tokenize() has them)."""
    tokens = checkpoint(tokenize(docs, path, key, text, end))  # both passes see the same partitions
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per partition
    base, at = {}, 0
    for r in totals:
        base[r["part"]] = at
        at += r["n"]
    bases = np.zeros(max(base, default=0) + 1, np.int64)
    for part, n in base.items():
        bases[part] = n
    sent = tokens.sparkSession.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, before, counts = (np.asarray(batch.column(i)) for i in (1, 2, 3))
            begin = sent.value[part] + before
            pieces = (begin + counts - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[row] // length + nth
            left = np.maximum(begin[row], sequence * length)
            size = np.minimum((begin + counts)[row], (sequence + 1) * length) - left
            start = left - begin[row]
            data = [x.as_buffer() for x in batch.column(4)]
            width = data[0].size // int(counts[0])
            cut = [memoryview(data[r])[a * width : (a + n) * width] for r, a, n in zip(row.tolist(), start.tolist(), size.tolist())]
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4")) for x in cut]
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(counts[row]), pa.array(sequence), pa.array(left % length), pa.array(map(bytes, cut), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = StructType([StructField("key", docs.schema[key].dataType), *(StructField(x, LongType()) for x in longs), StructField("ids", BinaryType())])
    return tokens.mapInArrow(frugal(run), schema).withColumnRenamed("key", key)
