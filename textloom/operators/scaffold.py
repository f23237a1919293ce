"""Alignment of fragmentary transcripts by a scaffold of unique n-grams, as joins, groups and windows.

Words are (version, pos, norm, line_no), the canon (ord, norms): its verses in reading order. Nothing of the canon goes
through the driver: its n-grams are grouped by place, those of a version by windows, and only anchors, a few numbers each,
are gathered by version for their longest increasing chain. What is sequential beyond that, the borders of verses, is
decided in groups of words near to them (`refined`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored
from . import kernels
from .matching import Matcher

#: Words of the tail and the head of a verse that a border is compared with, and words that may stand for one.
LOOK, MOST = 5, 4
#: Words behind a border that are gathered first, as far as it may go; where it goes farther, more are.
REACH = 24


def units(words: DataFrame, canon: DataFrame) -> DataFrame:
    """Adds unit and joined: words cut by a line break count as one unit with the text of both (L3).

    Two words are one where they are on different lines, together a canonical word, and not both canonical words. Of pairs
    that overlap, every second one counts.
    """
    known = canon.select(F.explode("norms").alias("w")).distinct()
    w = Window.partitionBy("version").orderBy("pos")
    rows = words.withColumns({"_next": F.lead("norm").over(w), "_cut": F.lead("line_no").over(w) != F.col("line_no")})
    rows = rows.withColumn("_both", F.when(F.col("_cut"), F.concat("norm", "_next")))
    for key, name in (("norm", "_a"), ("_next", "_b"), ("_both", "_ab")):
        rows = rows.join(known.select(F.col("w").alias(key), F.lit(True).alias(name)), key, "left")
    pair = F.coalesce(F.col("_ab"), F.lit(False)) & ~(F.coalesce(F.col("_a"), F.lit(False)) & F.coalesce(F.col("_b"), F.lit(False)))
    # all of it is counted in the order of words, so that rows are sorted once
    rows = rows.withColumns({"_pair": pair, "_i": F.row_number().over(w)})
    nth = F.col("_i") - F.coalesce(F.max(F.when(~F.col("_pair"), F.col("_i"))).over(w), F.lit(0))
    rows = rows.withColumn("_opens", F.col("_pair") & (nth % 2 == 1)).withColumn("_closes", F.coalesce(F.lag("_opens").over(w), F.lit(False)))
    rows = rows.withColumn("unit", F.sum((~F.col("_closes")).cast("int")).over(w) - 1)
    return rows.withColumn("joined", F.when(F.col("_opens"), F.col("_both")).otherwise(F.col("norm"))).withColumn("_first", ~F.col("_closes")).select(*words.columns, F.col("unit").cast("long").alias("unit"), "joined", F.col("_first").alias("first"))


def places(canon: DataFrame) -> DataFrame:
    """t, norm, ord: every word of the canon by its place in all. A book of verses is a window, all books are another."""
    own = Window.partitionBy("book").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    sizes = canon.withColumn("_n", F.size("norms").cast("long"))
    books = sizes.groupBy("book").agg(F.sum("_n").alias("_all"), F.min("ord").alias("_begin"))
    before = books.withColumn("_base", F.coalesce(F.sum("_all").over(Window.orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("book", "_base")
    at = sizes.withColumn("_own", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(before, "book")
    return at.select("ord", (F.col("_base") + F.col("_own")).alias("_at"), F.posexplode("norms").alias("_i", "norm")).select((F.col("_at") + F.col("_i")).alias("t"), "norm", "ord")


def canon_grams(tokens: DataFrame, n: int) -> DataFrame:
    """gram, t: n-grams that the canon has once. Each word is sent to the n places that it is part of."""
    spread = tokens.select(F.explode(F.sequence(F.greatest(F.col("t") - n + 1, F.lit(0)), F.col("t"))).alias("at"), "t", "norm")
    grams = spread.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("t", "norm"))).alias("g")).where(F.size("g") == n)
    gram = F.array_join(F.transform("g", lambda x: x["norm"]), " ")
    return grams.groupBy(gram.alias("gram")).agg(F.count("*").alias("_n"), F.min("at").alias("t")).where("_n = 1").drop("_n")


def own_grams(text: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """version, n, gram, s: the n-grams of each version, all sizes in one pass. text: version, unit, joined."""
    w = Window.partitionBy("version").orderBy("unit")
    rows = text.select("version", "unit", "joined", *(F.lead("joined", k).over(w).alias(f"_{k}") for k in range(1, max(sizes))))
    gram = lambda n: F.when(F.col(f"_{n - 1}").isNotNull() if n > 1 else F.lit(True), F.concat_ws(" ", "joined", *(f"_{k}" for k in range(1, n))))
    grams = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), gram(n).alias("gram")) for n in sizes)))
    return rows.select("version", F.col("unit").alias("s"), grams.alias("g")).select("version", "g.n", "g.gram", "s").where("gram IS NOT NULL")


def anchors(text: DataFrame, tokens: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """version, s, t: places of unique n-grams, the longer ones first, cut to an increasing chain after each size.

    Whether a version has an n-gram once is counted behind the join, where an n-gram is its place in the canon.
    """
    there = None
    for n in sizes:
        grams = canon_grams(tokens, n).select(F.lit(n).alias("n"), "gram", "t")
        there = grams if there is None else there.unionAll(grams)
    pairs = own_grams(text, sizes).join(stored(there), ["n", "gram"]).groupBy("version", "n", "t").agg(F.count("*").alias("_n"), F.min("s").alias("s")).where("_n = 1")
    found = pairs.groupBy("version").agg(F.collect_list(F.struct("n", "s", "t")).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chain: list[tuple[int, int]] = []
                for n in sorted({x["n"] for x in r["a"]}, reverse=True):
                    fresh = kernels.increasing(sorted((x["s"], x["t"]) for x in r["a"] if x["n"] == n))
                    chain = kernels.increasing(sorted({*chain, *fresh}))
                yield pa.RecordBatch.from_arrays([pa.array([r["version"]] * len(chain), pa.string()), pa.array([s for s, _ in chain], pa.int64()), pa.array([t for _, t in chain], pa.int64())], ["version", "s", "t"])

    return found.mapInArrow(run, "version string, s long, t long")


def interpolated(text: DataFrame, chain: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds t: the canonical place of each unit.

    Linear between anchors, with the outer pair's slope beyond them (1 for a single anchor), rounded half up, within the
    canon; a version without anchors is stretched over the canon.
    """
    w = Window.partitionBy("version").orderBy("unit")
    m = tokens.count()
    order = Window.partitionBy("version").orderBy("s")
    # each anchor knows the next one, so that no window has to look ahead over the words
    chain = chain.withColumns({"_s": F.lead("s").over(order), "_u": F.lead("t").over(order)})
    slope = (F.col("_u") - F.col("t")) / (F.col("_s") - F.col("s"))
    ends = chain.withColumn("_slope", slope).groupBy("version").agg(
        F.min_by("_slope", "s").alias("_low"), F.max_by("_slope", F.when(F.col("_slope").isNotNull(), F.col("s"))).alias("_high"), F.min(F.struct("s", "t")).alias("_begin")
    )
    at = F.struct(F.col("s"), F.col("t"), F.when(F.col("_s").isNotNull(), F.struct(F.col("_s").alias("s"), F.col("_u").alias("t"))).alias("b"))
    rows = text.join(chain.select("version", F.col("s").alias("unit"), F.col("t").alias("_t"), at.alias("_at")), ["version", "unit"], "left")
    sizes = text.groupBy("version").agg(F.count("*").alias("_n")).join(ends, "version", "left")
    rows = rows.withColumn("_a", F.last("_at", ignorenulls=True).over(w)).join(sizes, "version")
    rows = rows.withColumn("_b", F.when(F.col("_a").isNull(), F.col("_begin")).otherwise(F.col("_a.b")))
    u = F.col("unit")
    low, high = F.coalesce("_low", F.lit(1.0)), F.coalesce("_high", F.lit(1.0))
    inner = F.col("_a.t") + (u - F.col("_a.s")) / (F.col("_b.s") - F.col("_a.s")) * (F.col("_b.t") - F.col("_a.t"))
    value = F.when(F.col("_a").isNull() & F.col("_b").isNull(), u * (F.lit(m) / F.col("_n"))).when(F.col("_t").isNotNull(), F.col("_t").cast("double"))
    value = value.when(F.col("_a").isNull(), F.col("_b.t") + (u - F.col("_b.s")) * low).when(F.col("_b").isNull(), F.col("_a.t") + (u - F.col("_a.s")) * high).otherwise(inner)
    t = F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(m - 1.0)) + 0.5).cast("long")
    return rows.select(*text.columns, t.alias("t"))


def kept(rows: DataFrame, least: int) -> DataFrame:
    """Units of verses with fewer than `least` units go to the nearer kept neighbour, the earlier one on ties.

    Where a version keeps no verse at all its units have ord null.
    """
    w = Window.partitionBy("version").orderBy("unit")
    rows = rows.withColumn("_kept", F.when(F.count("*").over(Window.partitionBy("version", "ord")) >= least, F.col("ord")))
    # the next one is the last one of the other order: a frame up to the end is summed anew for each row
    back = Window.partitionBy("version").orderBy(F.col("unit").desc())
    rows = rows.withColumn("_after", F.last("_kept", ignorenulls=True).over(back)).withColumn("_before", F.last("_kept", ignorenulls=True).over(w))
    closer = F.when(F.abs(F.col("ord") - F.col("_before")) <= F.abs(F.col("_after") - F.col("ord")), F.col("_before")).otherwise(F.col("_after"))
    return rows.withColumn("ord", F.coalesce("_kept", closer, "_before", "_after")).drop("_kept", "_before", "_after")


def moved(words: list[str], verse: list[int | None], tails: dict[int, list[str]], heads: dict[int, list[str]], match: Matcher) -> list[int | None]:
    """The verse of each word after its borders are moved, from left to right.

    At a border between a verse and the next one: the last word goes over if it is like a word of the next verse's head and
    none of this verse's tail. If it is like neither, two to four words around the border may be one word written apart:
    if together they are like a word of the head, those before the border go over, unless one of them is like a word of the
    tail; if like one of the tail, those after it come over, unless one of them is like a word of the head.
    """
    out = list(verse)
    turns = (i for i in range(len(out) - 1) if out[i] != out[i + 1])
    like = lambda w, side: any(match(w, x) for x in side)
    spans = [(left, total - left) for total in range(2, MOST + 1) for left in range(1, total)]
    for i in turns:
        a, b = out[i], out[i + 1]
        if a is None or b is None or b - a != 1 or a not in tails or b not in heads:
            continue
        tail, head = tails[a], heads[b]
        if like(words[i], tail):
            continue
        if like(words[i], head):
            out[i] = b
            continue
        for left, right in spans:
            first, last = i - left + 1, i + right
            if first < 0 or last >= len(out) or any(v != a for v in out[first : i + 1]) or any(v != b for v in out[i + 1 : last + 1]):
                continue
            whole = "".join(words[first : last + 1])
            if like(whole, head):
                if not any(like(x, tail) for x in words[first : i + 1]):
                    out[first : i + 1] = [b] * left
                    break
            elif like(whole, tail) and not any(like(x, head) for x in words[i + 1 : last + 1]):
                out[i + 1 : last + 1] = [a] * right
                break
    return out


def refined(rows: DataFrame, canon: DataFrame, keys: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """The rows with ord moved over the borders of verses (L13). rows: version, unit, joined, ord; keys: what names a canon.

    canon: keys, ord, norms. Only words near a border are gathered, MOST - 1 before it and `reach` behind it, in groups that
    have no gap, so a long version is many small tasks. Versions where a border came near the end of its group, as text that
    repeats a word may move it, are done again with a longer reach.
    """
    keys = keys or []
    ends = canon.select(*keys, "ord", F.slice("norms", F.greatest(F.size("norms") - LOOK + 1, F.lit(1)), LOOK).alias("tail"), F.slice("norms", 1, LOOK).alias("head"))
    known = stored(ends.join(ends.select(*keys, (F.col("ord") - 1).alias("ord"), F.col("head").alias("_head")), [*keys, "ord"]).select(*keys, F.col("ord").alias("_at"), "tail", F.col("_head").alias("head")))
    columns = rows.columns
    rows = at = stored(_near_borders(rows, reach))
    done = None
    while True:
        found = stored(_moved_groups(at.where("_in IS NOT NULL"), known, keys))
        far = stored(found.where("far").select("version").distinct())
        last = far.isEmpty()
        new = found.where("NOT far").select("version", "unit", "new")
        new = new if last else new.join(far, "version", "left_anti")
        done = new if done is None else done.unionAll(new)
        if last:
            return rows.select(columns).join(done, ["version", "unit"], "left").withColumn("ord", F.coalesce("new", "ord")).drop("new")
        reach *= 16
        at = _near_borders(rows.select(columns).join(far, "version", "left_semi"), reach)


def _near_borders(rows: DataFrame, reach: int) -> DataFrame:
    """Adds _turns (a border follows), _ends (the version does) and _in, the number of the group of words near to borders or null."""
    w = Window.partitionBy("version").orderBy("unit")
    follows = F.lead("ord").over(w)
    rows = rows.withColumns({"_turns": F.coalesce(follows == F.col("ord") + 1, F.lit(False)), "_ends": F.lead("unit").over(w).isNull(), "_i": F.row_number().over(w)})
    since = F.col("_i") - F.last(F.when(F.col("_turns"), F.col("_i")), ignorenulls=True).over(w)
    near = F.coalesce(since <= reach, F.lit(False))
    for k in range(1, MOST - 1):
        near = near | F.coalesce(F.lead("_turns", k).over(w), F.lit(False))
    rows = rows.withColumn("_near", near).withColumn("_begins", F.col("_near") & ~F.coalesce(F.lag("_near").over(w), F.lit(False)))
    return rows.withColumn("_in", F.when(F.col("_near"), F.sum(F.col("_begins").cast("int")).over(w))).drop("_i", "_near", "_begins")


def _moved_groups(near: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """version, unit, new, far: words that change their verse, and a row with far for each group that a border may have left."""
    # a word that no border follows looks for a number that no verse has, each another one, so that they do not meet in one task
    near = near.withColumn("_at", F.when(F.col("_turns"), F.col("ord")).otherwise(-1 - F.col("unit"))).join(known, [*keys, "_at"], "left")
    groups = near.groupBy("version", "_in").agg(F.array_sort(F.collect_list(F.struct("unit", "joined", "ord", "tail", "head"))).alias("u"), F.max("_ends").alias("ends"))
    groups = groups.select("version", "ends", *(F.col(f"u.{c}").alias(c) for c in ("unit", "joined", "ord")), F.filter("u", lambda x: x["tail"].isNotNull()).alias("borders"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher()
        for batch in batches:
            out: list[tuple] = []
            for version, last, unit, words, own, borders in zip(*(c.to_pylist() for c in batch.columns)):
                tails, heads = {x["ord"]: x["tail"] for x in borders}, {x["ord"] + 1: x["head"] for x in borders}
                verse = moved(words, own, tails, heads, match)
                changed = [i for i, (a, b) in enumerate(zip(own, verse)) if a != b]
                if not last and changed and changed[-1] >= len(own) - 2 * MOST:
                    out.append((version, None, None, True))
                out += [(version, unit[i], verse[i], False) for i in changed]
            columns = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["version", "unit", "new", "far"])

    return groups.mapInArrow(run, "version string, unit long, new long, far boolean")


def refined_rows(rows: DataFrame, words: str = "words", verse: str = "verse", canon: str = "canon") -> DataFrame:
    """As refined(), of versions that are rows: verse (array, a number for each of words) moved over the borders of verses.

    canon: the words of the verses 0, 1, ..., an array of arrays. What is one row before stays one row, so nothing is shuffled.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in (verse, canon)) + f", `{verse}` array<bigint>"
    kept = [c for c in rows.columns if c not in (verse, canon)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher()
        for batch in batches:
            found = []
            for own, at, verses in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (words, verse, canon))):
                ends = {a for a, b in zip(at, at[1:]) if b == a + 1}
                # a border that moves to the right lies between the same two verses
                tails, heads = {a: verses[a][-LOOK:] for a in ends}, {a + 1: verses[a + 1][:LOOK] for a in ends}
                found.append(moved(own, at, tails, heads, match))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(found, pa.list_(pa.int64()))], [*kept, verse])

    return rows.mapInArrow(run, schema)


def scaffolded(words: DataFrame, canon: DataFrame, sizes: tuple[int, ...] = (6, 4, 3), least: int = 3) -> DataFrame:
    """version, pos, verse_ord of each word; versions that keep no verse give no rows.

    words: version, pos, norm, line_no. canon: ord (without gaps), book, norms.
    """
    w = Window.partitionBy("version").orderBy("pos")
    # a unit is a row with the place of its first word and, where it has two, of the second
    text = units(words, canon).withColumn("_also", F.when(~F.lead("first").over(w), F.lead("pos").over(w))).where("first")
    text = stored(text.select("version", "unit", "joined", "pos", "_also"))
    tokens = stored(places(canon))
    rows = interpolated(text, stored(anchors(text, tokens, sizes)), tokens).join(tokens.select("t", "ord"), "t").drop("t")
    rows = refined(kept(rows, least).where("ord IS NOT NULL"), canon)
    each = F.explode(F.when(F.col("_also").isNull(), F.array("pos")).otherwise(F.array("pos", "_also")))
    return rows.select("version", each.alias("pos"), F.col("ord").alias("verse_ord"))
