"""Verses written from assigned words: lines with their ids and markup, joined or not, and insertions.

Words are (version, pos, raw, page, line, word, ord): word is the place in the line, ord the verse. Infos are (version,
page, line, text, markdown, source), one for each line. The canon is (ord, book, chapter, verse, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..storage import stored

#: Bits of the filter for pairs: so many for each pair that is looked for, and 2 ** MOST_BITS (64 MB) at most.
SPARE, MOST_BITS = 16, 29
#: What is no white space; the ranges decide nearly all signs before the long list does.
SIGN = rf"[\x21-\x7E\x{{00A1}}-\x{{167F}}[^{T.SPACES}]]"
LINE = "struct<id:string,page:int,line:int,text:string,markdown:string,source:string>"


def verse_lines(words: DataFrame, infos: DataFrame) -> DataFrame:
    """version, ord, page, line, first, id, text, markdown, source: the words of a verse that are on one line.

    A line over several verses has a letter in its ids, in the order in which the verses come. markdown: the part of the
    line's markdown that belongs to these words, null where it says no more than the text.
    """
    key = ["version", "ord", "page", "line"]
    # dealt by line once: the verses of a line, their letters and the line's markdown are then at hand
    lines = words.repartition("version", "page", "line").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("w"), F.min("pos").alias("first"), F.min("word").alias("low"), F.max("word").alias("high"))
    lines = lines.withColumn("text", F.array_join(F.transform("w", lambda x: x["raw"]), " "))
    own = Window.partitionBy("version", "page", "line")
    letter = F.when(F.count("*").over(own) > 1, F.char(96 + F.row_number().over(own.orderBy("first")))).otherwise("")
    name = F.concat(F.col("page").cast("string"), F.lit(":"), F.col("line").cast("string"), letter)
    about = infos.select("version", "page", "line", F.col("text").alias("_whole"), F.when(F.col("markdown") != F.col("text"), F.col("markdown")).alias("_markdown"), "source")
    lines = lines.withColumn("id", name).join(about, ["version", "page", "line"], "left")
    lines = lines.withColumn("_part", T.markdown_part(F.col("_markdown"), F.col("_whole"), F.col("low"), F.col("high")))
    part = F.col("_part")
    return lines.select(*key, "first", "id", "text", F.when((part != "") & (part != F.col("text")), part).alias("markdown"), "source")


def _letters(text: str) -> Column:
    # what is neither a letter nor white space goes from the whole text at once, and words without letters with it
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), rf"[[^a-z\x20]&&{SIGN}]+", ""), F.lit("[a-z]+"), 0)


def spoken(text: str) -> Column:
    """The words of a verse, letters only and with one space between."""
    return F.array_join(_letters(text), " ")


def compounds(text: str) -> Column:
    """The words of a verse with a hyphen, letters only."""
    found = F.transform(F.filter(T.white_words(F.col(text)), lambda w: F.contains(w, F.lit("-"))), T.stitch_word)
    return F.when(F.contains(text, F.lit("-")), found).when(F.col(text).isNotNull(), F.array().cast("array<string>"))


def canon_index(canon: DataFrame) -> DataFrame:
    """ord, spoken, compounds: the words of each verse, letters only and with one space between, and its compounds."""
    return canon.select("ord", spoken("text").alias("spoken"), compounds("text").alias("compounds"))


def joined_lines(lines: DataFrame, canon: DataFrame) -> DataFrame:
    """The lines with what joins each to the next of its verse: a space, or nothing within a word."""
    # by verse first: its own text, the next line and, in verses(), its lines are found without another shuffle
    rows = lines.join(canon_index(canon), "ord", "left")
    rows = rows.withColumn("next", F.lead("text").over(Window.partitionBy("version", "ord").orderBy("first")))
    return ended(rows, canon).select(*lines.columns)


def ended(rows: DataFrame, canon: DataFrame) -> DataFrame:
    """As joined_lines(), of lines that have next, the text that follows in their verse or null, and its canon_index(): spoken, compounds.

    The verse's own canonical text decides first, exactly or by one edit; the canon as a whole only where it holds the joined
    word and not the pair. A hyphen at the end of a line goes where the joined word is known and no compound, and stays
    otherwise. Only lines that their own verse leaves open are joined with the canon's words, pairs and compounds.
    """
    columns = [c for c in rows.columns if c not in ("spoken", "compounds", "next")]
    # words have one space between them
    last, first = (F.split_part(c, F.lit(" "), F.lit(n)) for c, n in (("text", -1), ("next", 1)))
    each = rows.withColumns({"_tail": F.coalesce(last, F.lit("")), "_head": first}).drop("next")
    each = each.withColumns({"_t": T.stitch_word(F.regexp_replace("_tail", "-$", "")), "_h": T.stitch_word(F.col("_head")), "_hyphen": F.col("_tail").endswith("-")}).drop("_tail")
    each = each.withColumns({"_merged": F.concat("_t", "_h"), "_pair": F.concat_ws(" ", "_t", "_h")})
    merged, space, hyphen, none = F.col("_merged"), F.lit(" "), F.col("_hyphen"), F.lit(False)
    says = lambda key: F.coalesce(F.contains(F.concat(space, "spoken", space), F.concat(space, F.col(key), space)), none)
    near = F.coalesce(F.exists(F.split("spoken", " "), lambda x: (F.length(x) >= 4) & (F.abs(F.length(x) - F.length(merged)) <= 2) & (F.levenshtein(x, merged) <= 1)), none)
    # what needs the joined word: a hyphen, or two words that the verse does not say one after another
    asks = F.when(F.col("_head").isNull(), False).when(hyphen, ~F.coalesce(F.array_contains("compounds", merged), none)).otherwise((F.col("_t") != "") & (F.col("_h") != "") & ~says("_pair"))
    each = each.withColumn("_asks", asks).drop("compounds")
    each = each.withColumn("_own", F.col("_asks") & ((merged != "") & says("_merged") | (F.length(merged) >= 5) & near)).drop("spoken")
    ending = F.when(F.col("_head").isNull() | hyphen, "").when(F.col("_asks") & F.col("_own"), "").otherwise(" ")
    wants = F.when(~F.col("_asks") | F.coalesce(merged == "", none), "nothing").when(F.col("_own"), F.when(hyphen, "compound").otherwise("nothing")).otherwise("word")
    each = each.withColumns({"_ending": ending, "_wants": wants})
    # the joined word is the pair without its space
    each = stored(each.select(*columns, "_ending", "_wants", *(F.when(F.col("_wants") != "nothing", F.col(c)).alias(c) for c in ("_hyphen", "_pair")))).withColumn("_merged", F.replace("_pair", space, F.lit("")))

    words = stored(canon.select(F.explode(_letters("text")).alias("_merged")).distinct()).withColumn("_word", F.lit(True))
    joint = stored(canon.where(F.contains("text", F.lit("-"))).select(F.explode(compounds("text")).alias("_merged")).distinct()).withColumn("_compound", F.lit(True))
    asking = each.where("_wants = 'word'")
    asked = stored(asking.where("NOT _hyphen").join(words, "_merged", "left_semi").select("_pair").distinct())
    paired = said_pairs(canon, asked).withColumn("_paired", F.lit(True))
    cut = F.when(F.col("_compound").isNull(), "cut").otherwise("")
    known = each.where("_wants = 'compound'").join(joint, "_merged", "left").withColumn("_ending", cut)
    found = asking.join(words, "_merged", "left").join(joint, "_merged", "left")
    # a line that asks for no pair looks for its joined word, which is none
    found = found.withColumn("_pair", F.when(~hyphen & F.col("_word"), F.col("_pair")).otherwise(merged)).join(paired, "_pair", "left")
    one = F.when(F.col("_word") & F.col("_paired").isNull(), "").otherwise(" ")
    found = found.withColumn("_ending", F.when(hyphen, F.when(F.col("_word"), cut).otherwise("")).otherwise(one))
    done = each.where("_wants = 'nothing'").select(*columns, "_ending")
    for part in (known, found):
        done = done.unionAll(part.select(*columns, "_ending"))
    closed = lambda c: F.when(F.col("_ending") == "cut", F.regexp_replace(c, "-$", "")).otherwise(F.concat(c, "_ending"))
    return done.withColumns({"text": closed("text"), "markdown": closed("markdown")}).drop("_ending")


def said_pairs(canon: DataFrame, asked: DataFrame) -> DataFrame:
    """_pair: those of the pairs asked for (distinct) that a verse of the canon says.

    Of the canon's pairs only those in a bitmap of the pairs asked for are shuffled; the join decides.
    """
    bits = 1 << min(max((SPARE * asked.count()).bit_length(), 20), MOST_BITS)
    cell = F.pmod(F.xxhash64("_pair"), F.lit(bits))
    longs = asked.select(cell.alias("c")).groupBy(F.expr("c div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(c % 64 AS INT)))").alias("b"))
    filled = longs.groupBy(F.expr("w div 256").alias("_at")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") % 256).cast("int").alias("i"), "b"))).alias("m"))
    bitmap = filled.select("_at", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("_bits"))
    words = canon.select(_letters("text").alias("s")).where("size(s) > 1")
    pairs = words.select(F.explode(F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s")), lambda a, b: F.concat_ws(" ", a, b))).alias("_pair"))
    pairs = pairs.withColumn("_c", cell).withColumn("_at", F.expr("_c div 16384")).join(F.broadcast(bitmap), "_at")
    pairs = pairs.where(F.expr("getbit(get(_bits, CAST(_c div 64 % 256 AS INT)), CAST(_c % 64 AS INT)) = 1")).select("_pair").distinct()
    return asked.join(pairs, "_pair", "left_semi")


def verses(lines: DataFrame, canon: DataFrame) -> DataFrame:
    """version, ord, book, chapter, verse, lines: one row for each canonical verse that has any."""
    # the canon comes first: what is dealt by verse need not be dealt again for a version's verse
    keys = ["version", "ord", "book", "chapter", "verse"]
    rows = lines.join(canon.select(*keys[1:]), "ord").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", F.struct("id", "page", "line", "text", "markdown", "source").alias("l")))).alias("l"))
    return rows.withColumn("lines", F.transform("l", lambda x: x["l"]).cast(f"array<{LINE}>")).select(*keys, "lines")


def inserted(verses: DataFrame, insertions: DataFrame) -> DataFrame:
    """Lines that the source lacks, put into verses one after another, by idx; adds warnings.

    insertions: idx, ord, text, markdown, before_page, before_line, after_page, after_line, after_word; all but the first
    three may be null. A line goes before or after the first line with that page and number, or between that line's words up
    to after_word (from 0) and the rest; at the end where none is named or the named one is missing, which is a warning.
    Insertions whose verse is missing are unplaced().
    """
    step = F.struct("idx", "text", "markdown", "before_page", "before_line", "after_page", "after_line", "after_word")
    wanted = insertions.groupBy("ord").agg(F.array_sort(F.collect_list(step)).alias("_wanted"))
    name = F.concat_ws("-", F.concat(F.lit("ins:"), F.col("book")), F.col("chapter").cast("string"), F.col("verse").cast("string"))
    start = F.struct(F.col("lines").alias("lines"), F.array().cast("array<string>").alias("warnings"))

    def line_of(id_: Column, like: Column, text: Column, markdown: Column) -> Column:
        return F.struct(id_.alias("id"), like["page"].alias("page"), like["line"].alias("line"), text.alias("text"), markdown.alias("markdown"), like["source"].alias("source")).cast(LINE)

    def put(acc: Column, x: Column) -> Column:
        lines, before = acc["lines"], x["before_page"].isNotNull() & x["before_line"].isNotNull()
        page, number = F.when(before, x["before_page"]).otherwise(x["after_page"]), F.when(before, x["before_line"]).otherwise(x["after_line"])
        at = F.array_position(F.transform(lines, lambda l: F.coalesce((l["page"] == page) & (l["line"] == number), F.lit(False))), F.lit(True)).cast("int")
        new = F.array(F.struct(name.alias("id"), F.lit(0).alias("page"), F.lit(0).alias("line"), x["text"].alias("text"), x["markdown"].alias("markdown"), F.lit(None).cast("string").alias("source")).cast(LINE))
        old = F.get(lines, at - 1)
        words = F.split(old["text"], " ", -1)
        cut = x["after_word"] + 1
        first, rest = F.array_join(F.slice(words, 1, cut), " "), F.array_join(F.slice(words, cut + 1, F.size(words)), " ")
        pre = line_of(F.concat(old["id"], F.lit(":pre")), old, first, T.markdown_part(old["markdown"], old["text"], F.lit(0), cut - 1, " "))
        post = line_of(F.concat(old["id"], F.lit(":post")), old, rest, T.markdown_part(old["markdown"], old["text"], cut, F.size(words) - 1, " "))
        halves = F.concat(F.array(pre), new, F.filter(F.array(post), lambda p: F.trim(p["text"]) != ""))
        begin, end = F.slice(lines, 1, F.greatest(at - 1, F.lit(0))), F.slice(lines, at + 1, F.size(lines))
        amid = F.concat(begin, F.when(before, F.concat(new, F.array(old))).when(x["after_word"].isNotNull(), halves).otherwise(F.concat(F.array(old), new)), end)
        missing = page.isNotNull() & number.isNotNull() & (at == 0)
        warning = F.concat(F.when(before, "before ").otherwise("after "), page.cast("string"), F.lit(":"), number.cast("string"), F.lit(" not found, appended"))
        out = F.when(at > 0, amid).otherwise(F.concat(lines, new))
        return F.struct(out.cast(f"array<{LINE}>").alias("lines"), F.concat(acc["warnings"], F.when(missing, F.array(warning)).otherwise(F.array().cast("array<string>"))).alias("warnings"))

    rows = verses.join(wanted, "ord", "left")
    none = F.array().cast("array<string>")
    done = F.when(F.col("_wanted").isNull(), start).otherwise(F.aggregate("_wanted", start, put))
    rows = rows.withColumn("_done", done)
    return rows.select(*(c for c in verses.columns if c != "lines"), F.col("_done.lines").alias("lines"), F.coalesce("_done.warnings", none).alias("warnings"))


def unplaced(verses: DataFrame, insertions: DataFrame) -> DataFrame:
    """Insertions whose verse no version has."""
    return insertions.join(verses.select("ord").distinct(), "ord", "left_anti")
