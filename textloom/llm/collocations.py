"""Phrase collocations: candidates by the upper bounds of a sketch, counted by automata over guarded words.

1. Every phrase of one to `longest` words adds one to a cell of a count-min sketch (one row of cells, as wide as the table
   asks for, up to 2^30). Blocks send their cells, reducers add them by ranges and keep one bit of each: whether the cell
   reaches `least`. A cell is never below the count of a phrase in it, so phrases without the bit are no candidates. The
   bits, 128 MB at most, are all that is broadcast; a sketch that is too narrow lets more through, and changes no count.
2. A block's phrases with the bit become patterns of automata, a space before and after each; the automata run over the
   block's words, written with the same guards, and count all matches, overlapping ones too. Sums over blocks are exact.
3. Thresholds, cuts, coverage by longer phrases and ranks are joins and windows over the phrases that reach `least`.

Edge cases: null texts are empty; a null language is `und`, the same as a language of that name; an empty table gives no
rows; repeated rows and ids count each time; ties are broken by the phrase's bytes; other columns are not read. A word may
be of any length and a text of any size: a block is cut between texts, and an automaton between patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, frugal, salted_join, stored, trim
from .words import LOWER, _coded, blocks, data_of, hashes, mixed

BLOCK_BYTES, SLAB, MOST_CELLS, PATTERN_CHARS = 8_000_000, 1 << 20, 1 << 30, 2_000_000
GAP, BREAK = np.zeros(256, bool), np.zeros(256, bool)
GAP[[9, 32]] = True
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
UNKNOWN = "und"


def pieces(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all texts, A-Z lower-cased: codes, distinct words, and a number for the piece that each is in."""
    broken = BREAK[data]
    gap = broken | GAP[data]
    start = ~gap
    start[1:] &= gap[:-1]
    first = np.unique(cuts[:-1][cuts[:-1] < len(data)])
    start[first] = ~gap[first]
    broken[first] = True  # the first byte of a text ends what came before, whatever it is
    starts = np.flatnonzero(start)
    number = np.searchsorted(np.flatnonzero(broken), starts, "right")
    before = np.cumsum(gap, dtype=np.int32)
    codes, distinct = _coded(LOWER[data[~gap]], starts - before[starts])
    return codes, distinct, number


def phrases(h: np.ndarray, number: np.ndarray, seed: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, places where such a phrase begins, hashes) for each number of words."""
    total = np.zeros(len(h), np.uint64)
    for n in range(1, longest + 1):
        weight = mixed(np.array([n], np.uint64))[0] | np.uint64(1)
        if len(h) < n:
            return
        total = total[: len(h) - n + 1] + h[n - 1 :] * weight
        at = np.flatnonzero(number[: len(total)] == number[n - 1 :])
        yield n, at, mixed(total[at] + np.uint64((seed + n) & (1 << 64) - 1))


def by_language(table: pa.Table) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts of each language of a block, as data_of() gives them."""
    languages = pc.fill_null(table.column("lang"), UNKNOWN).combine_chunks()
    for lang in pc.unique(languages).to_pylist():
        yield lang, *data_of(table.column("text").filter(pc.equal(languages, lang)))


def _seed(lang: str) -> int:
    return int(hashes(pa.array([lang.encode()], pa.binary()))[0])


def sketch(texts: DataFrame, cells: int, least: int, longest: int) -> np.ndarray:
    """One bit for each cell of the sketch: whether `least` phrases or more fell into it."""
    kind = np.uint8 if least < 128 else np.uint32

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for table in blocks(batches, "text", BLOCK_BYTES):
            parts = []
            for lang, data, cuts in by_language(table):
                codes, distinct, number = pieces(data, cuts)
                h = hashes(distinct)[codes]
                parts += [(x & np.uint64(cells - 1)).astype(np.uint32) for _, _, x in phrases(h, number, _seed(lang), longest)]
            met = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)
            first = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]])) if len(met) else np.zeros(0, np.int64)
            cell, often = met[first], np.minimum(np.diff(np.append(first, len(met))), least).astype(kind)
            slab, begin = np.unique(cell // SLAB, return_index=True)
            rows = []
            for a, b in zip(begin, [*begin[1:], len(cell)]):
                own = cell[a:b] % SLAB
                rows.append(press.compress(np.diff(own, prepend=np.uint32(0)).astype(np.uint32).tobytes() + often[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(slab.astype(np.int32)), pa.array(rows, pa.binary())], ["slab", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for slab, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = press.decompress(packed.as_buffer())
                n = len(raw) // (4 + np.dtype(kind).itemsize)
                own = np.cumsum(np.frombuffer(raw, np.uint32, n))
                sums.setdefault(slab, np.zeros(SLAB, kind))
                sums[slab][own] = np.minimum(sums[slab][own] + np.frombuffer(raw, kind, n, 4 * n), least)
        for slab, counts in sums.items():
            bits = np.packbits(counts >= least).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([bits], pa.binary())], ["slab", "bits"])

    slabs = texts.mapInArrow(frugal(fill), "slab int, cells binary")
    bits = stored(slabs.repartition("slab").mapInArrow(frugal(merge), "slab int, bits binary"))
    out = np.zeros(max(cells, SLAB) // 8, np.uint8)
    for r in bits.toLocalIterator():  # one bit a cell in all: 128 MB at most
        out[r["slab"] * SLAB // 8 :][: SLAB // 8] = np.frombuffer(r["bits"], np.uint8)
    discard(bits)
    return out


def candidates(codes: np.ndarray, distinct: pa.Array, number: np.ndarray, seed: int, bits: np.ndarray, cells: int, longest: int) -> list[tuple[int, str]]:
    """(words, phrase) of a block's distinct phrases whose cell has the bit, as have the cells of all their parts."""
    names = [x.decode() for x in distinct.to_pylist()]
    out, own, ids, shorter = [], np.zeros(0, bool), np.zeros(0, np.int64), names
    for n, at, h in phrases(hashes(distinct)[codes], number, seed, longest):
        cell = (h & np.uint64(cells - 1)).astype(np.int64)
        passed = at[(bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)]
        if n > 1:
            passed = passed[own[passed] & own[passed + 1]]  # both parts of one word less
        here, exact = np.zeros(len(codes), bool), np.full(len(codes), -1, np.int64)
        here[passed] = True
        key = codes[passed].astype(np.int64) if n == 1 else ids[passed] << 32 | codes[passed + n - 1]
        _, place, exact[passed] = np.unique(key, return_index=True, return_inverse=True)
        first = passed[place]
        if n == 1:
            shorter = [names[c] for c in codes[first].tolist()]
        else:  # one word more than a phrase that is known
            shorter = [f"{shorter[i]} {names[c]}" for i, c in zip(ids[first].tolist(), codes[first + n - 1].tolist())]
        out += [(n, x) for x in shorter]
        own, ids = here, exact
    return out


def matches(text: str, patterns: list[str]) -> np.ndarray:
    """How often each pattern, guarded by spaces, occurs in a guarded text; automata of bounded size, one after another."""
    out = np.zeros(len(patterns), np.int64)
    order = sorted(range(len(patterns)), key=patterns.__getitem__)  # neighbours share the nodes of their beginnings
    at = 0
    while at < len(order):
        automaton, size = ahocorasick.Automaton(), 0
        while at < len(order) and (not size or size + len(patterns[order[at]]) <= PATTERN_CHARS):
            automaton.add_word(f" {patterns[order[at]]} ", order[at])
            size += len(patterns[order[at]]) + 2
            at += 1
        automaton.make_automaton()
        found = np.fromiter((v for _, v in automaton.iter(text)), np.int32)
        out += np.bincount(found, minlength=len(patterns))
    return out


def guarded(codes: np.ndarray, distinct: pa.Array, number: np.ndarray) -> str:
    """Words with a space on both sides, pieces divided by line breaks."""
    names = np.array([*(x.decode() for x in distinct.to_pylist()), "\n"], object)
    edges = np.flatnonzero(number[1:] != number[:-1]) + 1
    return f" {' '.join(names[np.insert(codes, edges, len(names) - 1)].tolist())} "


def counted(texts: DataFrame, bits: np.ndarray, cells: int, longest: int) -> DataFrame:
    """(lang, phrase, words, n) by block: exact counts of candidates, and of all words under the empty phrase."""
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", BLOCK_BYTES):
            for lang, data, cuts in by_language(table):
                codes, distinct, number = pieces(data, cuts)
                if not len(codes):
                    continue
                found = candidates(codes, distinct, number, _seed(lang), sent.value, cells, longest)
                n = matches(guarded(codes, distinct, number), [p for _, p in found])
                columns = [
                    pa.array([lang] * (len(found) + 1)),
                    pa.array(["", *(p for _, p in found)]),
                    pa.array([0, *(k for k, _ in found)], pa.int32()),
                    pa.array(np.concatenate([[len(codes)], n])),
                ]
                yield from pa.table(columns, ["lang", "phrase", "words", "n"]).to_batches(max_chunksize=50_000)
            trim()

    return texts.mapInArrow(frugal(scan), "lang string, phrase string, words int, n long")


def mine(docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, scale: int = 2_000_000, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words that occur `least` times.

    a, l, r: occurrences of the phrase and of the two parts of its lowest-scoring cut; n: words of the language; score:
    floor(scale * a / (l + r)). Phrases inside a longer one with `covered` percent of their occurrences are dropped.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST_CELLS, max(SLAB, 1 << (size // 16).bit_length()))
    bits = sketch(texts, cells, least, longest)
    sums = counted(texts, bits, cells, longest).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    counts = stored(sums.where((F.col("words") == 0) | (F.col("f") >= least)))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("words > 0")
    found = known.where("words > 1").withColumnRenamed("f", "a")

    word = F.split("phrase", " ")
    cut = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(0).alias("side"), F.array_join(F.slice(word, 1, k), " ").alias("part")),
            F.struct(k.alias("k"), F.lit(1).alias("side"), F.array_join(F.slice(word, k + 1, F.col("words")), " ").alias("part")),
        ),
    )
    parts = stored(found.select("lang", "phrase", "a", F.inline(F.flatten(cut))))
    parts = salted_join(parts, known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    scored = parts.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    scored = scored.withColumn("doubled", wide("a") * F.lit(scale)).withColumn("both", wide("l") + wide("r"))
    scored = scored.withColumn("score", F.expr("doubled div both"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(word, i, m), " "))))
    longer = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (wide("around") * 100 < wide("a") * covered))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
