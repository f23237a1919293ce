"""Findings at verse boundaries of an aligned version against the canon, as suggestions for overrides (Q9-Q12).

Inputs are verses with their words: (keys, verse, words). A chapter is a group of equal keys; its canonical vocabulary is
the only thing gathered for it, and is bounded by the chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored

K = 5
#: Words that say nothing of a boundary by themselves.
STOP_WORDS = "and the of a an in to with that is he she we they his her their my thy for".split()


def all_stop_words(words: Column) -> Column:
    """Whether every word is a stop word (U4)."""
    return F.forall(words, lambda w: w.isin(*STOP_WORDS))


def head(words: Column, k: int = K) -> Column:
    """The first k words."""
    return F.slice(words, 1, k)


def tail(words: Column, k: int = K) -> Column:
    """The last k words."""
    return F.slice(words, F.greatest(F.size(words) - k, F.lit(0)) + 1, F.lit(k))


def shared(words: Column, other: Column) -> Column:
    """Words that the other list has too, in their order and as often as they come."""
    return F.filter(words, lambda w: F.array_contains(other, w))


def vocabulary(canon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vocab): the distinct words of each canonical chapter."""
    return canon.select(*keys, F.explode("words").alias("w")).groupBy(*keys).agg(F.collect_set("w").alias("vocab"))


def neighbours(aligned: DataFrame, canon: DataFrame, keys: list[str]) -> DataFrame:
    """Aligned verses (headings, verse 0, aside) with the canonical verse and the ones before and after it."""
    at = lambda step, name: canon.select(*keys, (F.col("verse") - step).alias("verse"), F.col("words").alias(name))
    out = aligned.where("verse <> 0").select(*keys, "verse", "words").join(at(0, "canon"), [*keys, "verse"])
    return out.join(at(1, "after"), [*keys, "verse"], "left").join(at(-1, "before"), [*keys, "verse"], "left")


def bleeds(aligned: DataFrame, canon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verse, into, type, tokens, score): words that belong to the verse before or after (Q9, Q10).

    A trailing and a leading finding that mirror each other at one boundary cancel (U6).
    """
    # only the ends of verses travel; words of the neighbours are canonical words of the chapter by themselves
    mine = stored(aligned.select(*keys, "verse", head(F.col("words")).alias("own"), tail(F.col("words")).alias("own_tail")))
    grid = stored(canon.select(*keys, "verse", head(F.col("words")).alias("first"), tail(F.col("words")).alias("last")))
    at = lambda step, end, name: grid.select(*keys, (F.col("verse") - step).alias("verse"), F.col(end).alias(name))
    rows = mine.where("verse <> 0").join(grid, [*keys, "verse"]).join(at(1, "first", "after"), [*keys, "verse"], "left").join(at(-1, "last", "before"), [*keys, "verse"], "left")
    telling = lambda words: (F.size(words) > 0) & ~all_stop_words(words)
    trailing = F.when(F.col("after").isNotNull(), shared(F.col("own_tail"), F.col("after")))
    inner = F.col("before").isNotNull() & (F.col("verse") > 1)
    leading = F.when(inner, shared(F.col("own"), F.col("before")))
    own, first = F.col("own"), F.col("first")
    same = F.filter(F.zip_with(F.slice(own, F.lit(2), F.lit(K)), first, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    shifted = inner & (F.size(own) >= 2) & (F.size(first) >= 2) & (F.get(own, F.lit(0)) != F.get(first, F.lit(0))) & (F.size(same) >= 2) & ~F.get(own, F.lit(0)).isin(*STOP_WORDS)
    rows = rows.withColumns({"trailing": trailing, "leading": leading, "same": F.when(shifted, F.size(same)), "word": F.when(shifted, F.get(own, F.lit(0)))})
    rows = rows.withColumn("trailing", F.when(telling(F.col("trailing")), F.col("trailing")))
    # what the verse after begins with, and what the verse before ends with, for the mirrored finding
    following = mine.select(*keys, (F.col("verse") - 1).alias("verse"), F.col("own").alias("next_head"))
    rows = rows.join(following, [*keys, "verse"], "left")
    mirrored = F.coalesce(F.size(F.filter(shared(F.col("next_head"), F.col("last")), lambda w: F.array_contains("trailing", w))) > 0, F.lit(False))
    rows = stored(rows.select(*keys, "verse", "own", "trailing", "leading", "same", "word", mirrored.alias("mirrored")))
    prior = rows.where("trailing IS NOT NULL").select(*keys, (F.col("verse") + 1).alias("verse"), F.col("trailing").alias("prior"))
    # a word before a verse's own words must be one of the chapter: looked up for the few verses that have one
    asked = rows.where("word IS NOT NULL").groupBy(*keys).agg(F.collect_set("word").alias("asked"))
    known = canon.select(*keys, "words").join(asked, keys).select(*keys, F.explode(F.array_intersect("asked", "words")).alias("word")).distinct()
    rows = rows.join(prior, [*keys, "verse"], "left").join(known.withColumn("known", F.lit(True)), [*keys, "word"], "left")
    symmetric = F.coalesce(F.arrays_overlap("leading", "prior"), F.lit(False))
    finding = lambda name, place, when, step, tokens, score: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(name).alias("type"), (F.col("verse") + step).alias("into"), tokens.alias("tokens"), score.alias("score")))
    found = F.array(
        finding("trailing-bleed", 0, F.col("trailing").isNotNull() & ~F.col("mirrored"), 1, F.col("trailing"), F.size("trailing")),
        finding("leading-bleed", 1, telling(F.col("leading")) & ~symmetric, -1, F.col("leading"), F.size("leading")),
        finding("leading-bleed", 2, F.col("known"), -1, F.slice("own", 1, 1), F.col("same")),
    )
    out = rows.select(*keys, "verse", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return out.select(*keys, "verse", "f.into", "f.type", "f.tokens", "f.score", "f.place")


def top_bleeds(found: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """The best findings of each chapter, one for a boundary, the earlier one on ties (O3)."""
    order = [F.desc("score"), "verse", "place"]
    one = found.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "verse", "into").orderBy(*order))).where("_k = 1")
    return one.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k", "place")


def split_words(aligned: DataFrame, canon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verse, next_verse, joined): a verse's last word and the next one's first that make a canonical word (Q11).

    Next is the next verse that is present.
    """
    w = Window.partitionBy(*keys).orderBy("verse")
    rows = aligned.select(*keys, "verse", F.try_element_at("words", F.lit(-1)).alias("last"), F.lead("verse").over(w).alias("next_verse"), F.lead(F.get("words", F.lit(0))).over(w).alias("first"))
    rows = rows.where("verse <> 0 AND last IS NOT NULL AND first IS NOT NULL").withColumn("joined", F.concat("last", "first"))
    known = canon.select(*keys, F.explode("words").alias("joined")).distinct()
    return rows.join(known, [*keys, "joined"], "left_semi").select(*keys, "verse", "next_verse", "joined")


def boundary_artefacts(aligned: DataFrame, canon: DataFrame, keys: list[str], word) -> DataFrame:
    """(keys, verse, type, fragment): a verse that ends with a lone &, or begins with a piece of a word (Q12).

    aligned has lines, texts in order; word() normalises the first word.
    """
    rows = aligned.where("verse <> 0 AND size(lines) > 0").select(*keys, "verse", F.get("lines", F.lit(0)).alias("first"), F.element_at("lines", -1).alias("last"))
    fragment = word(F.get(F.split(F.trim("first"), r"\s+"), F.lit(0)))
    rows = rows.withColumn("fragment", fragment)
    ends = rows.where(F.rlike("last", F.lit(r"(?:^|\s)&\s*$"))).select(*keys, "verse", F.lit("trailing-ampersand").alias("type"), F.lit(None).cast("string").alias("fragment"))
    known = canon.select(*keys, F.explode("words").alias("fragment")).distinct()
    short = rows.where("fragment <> '' AND length(fragment) < 3").join(known, [*keys, "fragment"], "left_anti")
    return ends.unionAll(short.select(*keys, "verse", F.lit("leading-fragment").alias("type"), "fragment"))


def by_book(findings: DataFrame, order: list[str]) -> DataFrame:
    """Findings of each book and type, books in the order given, others after them by name."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("book"))
    counts = findings.groupBy("book", "type").agg(F.count("*").alias("findings"))
    return counts.orderBy(F.when(rank > 0, rank).otherwise(len(order) + 1), "book", "type")


def resolved_lines(findings: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """The line that holds all tokens of a finding, nearest to the boundary, else the edge line.

    findings: keys, verse, into, tokens; lines: keys, verse, pos, page, line, norms. Adds page, line and word_range, the
    first and last place of a token in the line (null where they are one, or in the edge line).
    """
    back = F.col("into") > F.col("verse")
    rows = findings.join(lines, [*keys, "verse"])
    whole = F.forall("tokens", lambda t: F.array_contains("norms", t))
    places = F.filter(F.transform("norms", lambda w, i: F.when(F.array_contains("tokens", w), i)), lambda i: i.isNotNull())
    low, high = F.array_min(places), F.array_max(places)
    rows = rows.withColumns({"_whole": whole, "_near": F.when(back, -F.col("pos")).otherwise(F.col("pos")), "word_range": F.when(whole & (low < high), F.array(low, high))})
    w = Window.partitionBy(*keys, "verse", "into", "tokens").orderBy(F.desc("_whole"), "_near")
    best = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return best.select(*findings.columns, "page", "line", "word_range")


def known_words(docs: DataFrame, vocabulary: DataFrame, others: str = "source", words: str = "w", most: int = 1_000_000) -> DataFrame:
    """others, tokens, matched of each row: how many of its words the vocabulary (w, known) has.

    A vocabulary of up to `most` words is broadcast, and each row's words are looked up and summed where they are. Beyond
    that they are counted by row and word, so that frequent words travel as one row of a document, and joined.
    """
    rows = docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", others, F.explode_outer(words).alias("w"))
    if vocabulary.limit(most + 1).count() <= most:
        found = rows.join(F.broadcast(vocabulary), "w", "left").withColumn("n", F.when(F.col("w").isNotNull(), 1).otherwise(0))
    else:
        found = rows.groupBy("_row", others, "w").agg(F.count("w").alias("n")).join(vocabulary, "w", "left")
    return found.groupBy("_row", others).agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("matched")).drop("_row")
