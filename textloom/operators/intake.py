"""Intake of correction reports: checks, rate limits, and comparison with what is open.

Reports come as JSON text. Open ones are (issue, version, book, chapter, verses).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .folds import folded

ERROR_TYPES = {"verse-boundary": "Words in the wrong verse", "spacing-hyphenation": "Spacing or hyphenation", "typo": "Transcription typo", "other": "Other"}
MOST_TEXT, MOST_DESCRIPTION, MOST_VERSES, LAST_VERSE = 500, 2000, 20, 300
MINUTE, HOUR = (60_000, 3), (3_600_000, 30)
REPORT = "struct<version:string,comparedWith:string,book:string,chapter:int,verses:array<int>,errorType:string,selectedText:string,expectedText:string,description:string,url:string>"


def utf16_length(text: Column) -> Column:
    """Length in units of 16 bits."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def _field(json: Column, name: str) -> Column:
    return F.try_variant_get(json, f"$.{name}", "variant")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID")).rlike(f"^({kind})")


def _text(value: Column) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _whole(value: Column) -> Column:
    """A number without a fraction, else null."""
    number = F.when(_is(value, "BIGINT|DECIMAL|DOUBLE|FLOAT"), F.try_variant_get(value, "$", "double"))
    return F.when(number == F.floor(number), number)


def checked(reports: DataFrame, versions: list[str], chapters: dict[str, int], payload: str = "payload") -> DataFrame:
    """Adds trapped (the hidden field is filled), error (the first check that fails, else null) and report.

    chapters: the number of chapters of each known book. Objects that name a field twice count as invalid JSON.
    """
    json = F.try_parse_json(payload)
    get = lambda name: _field(F.col("_json"), name)
    version, other, book, kind = (_text(get(n)) for n in ("version", "comparedWith", "book", "errorType"))
    chapter = _whole(get("chapter"))
    counts = F.create_map(*(F.lit(x) for pair in chapters.items() for x in pair))
    verses = F.when(_is(get("verses"), "ARRAY"), F.transform(F.try_variant_get(get("verses"), "$", "array<variant>"), _whole))
    good = (F.size(verses) >= 1) & (F.size(verses) <= MOST_VERSES) & F.forall(verses, lambda v: F.coalesce((v >= 1) & (v <= LAST_VERSE), F.lit(False)))
    no = lambda c: ~F.coalesce(c, F.lit(False))

    def optional(name: str, most: int) -> tuple[Column, Column]:
        absent = F.coalesce(F.schema_of_variant(get(name)), F.lit("VOID")) == "VOID"
        value = F.when(absent, F.lit("")).otherwise(_text(get(name)))
        return value, F.when(utf16_length(value) <= most, value)

    error = F.when(F.col("_json").isNull(), "invalid json").when(~_is(F.col("_json"), "OBJECT|ARRAY"), "payload must be an object")
    error = error.when(no(version.isin(versions)), "unknown version").when(no(other.isin(versions)), "unknown comparedWith version").when(no(book.isin(list(chapters))), "unknown book")
    error = error.when(no((chapter >= 1) & (chapter <= F.try_element_at(counts, book))), "chapter out of range").when(no(good), "invalid verses").when(no(kind.isin(list(ERROR_TYPES))), "unknown errorType")
    texts = {}
    for name, most in (("selectedText", MOST_TEXT), ("expectedText", MOST_TEXT), ("description", MOST_DESCRIPTION), ("url", MOST_TEXT)):
        _, texts[name] = optional(name, most)
        error = error.when(texts[name].isNull(), f"{name} too long")
    error = error.when((texts["url"] != "") & ~F.rlike(texts["url"], F.lit(r"^https?://\S+$")), "invalid url")
    sorted_ = F.array_sort(F.array_distinct(F.transform(verses, lambda v: v.cast("int"))))
    report = F.struct(version.alias("version"), other.alias("comparedWith"), book.alias("book"), chapter.cast("int").alias("chapter"), sorted_.alias("verses"), kind.alias("errorType"), *(v.alias(n) for n, v in texts.items()))
    trapped = F.coalesce(_text(get("website")) != "", F.lit(False))
    out = reports.withColumn("_json", json).withColumns({"trapped": trapped, "error": error})
    return out.withColumn("report", F.when(F.col("error").isNull(), report.cast(REPORT))).drop("_json")


Limits = tuple[tuple[int, int], ...]


def step(state: tuple, ms: int, counts: bool, limits: Limits = (MINUTE, HOUR)) -> tuple[tuple, tuple[bool]]:
    """(state, (allowed,)) after a report: (count, begin) of each limit's window; what is denied counts too."""
    if not counts:
        return state, (True,)
    state = tuple((1, ms) if n == 0 or ms - begin > window else (n + 1, begin) for (n, begin), (window, _) in zip(state, limits))
    return state, (all(n <= most for (n, _), (_, most) in zip(state, limits)),)


def start(limits: Limits = (MINUTE, HOUR)) -> tuple:
    return ((0, 0),) * len(limits)


def limited(reports: DataFrame, limits: Limits = (MINUTE, HOUR)) -> DataFrame:
    """Adds allowed. reports: client, ms, seq, and trapped and error as checked() gives them; traps and broken JSON do not count."""
    counts = ~F.col("trapped") & (F.coalesce("error", F.lit("")) != "invalid json")

    def one(state: tuple, ms: int, counted: bool) -> tuple:
        return step(state, ms, counted, limits)

    return folded(reports.withColumn("_counts", counts), ["client"], ["ms", "seq"], ["ms", "_counts"], "allowed boolean", lambda: start(limits), one).drop("_counts")


def outcomes(reports: DataFrame, open_issues: DataFrame) -> DataFrame:
    """Adds outcome and duplicate_of: what becomes of each report.

    outcome: invalid json, ignored (the hidden field), rate limited, the error of a check, duplicate, or created. A report is
    a duplicate where an open issue, or a report created before it, has its version, book and chapter and one of its verses;
    the state of a chapter is its covered verses, 300 at most. reports: seq is unique and not null.
    """
    fate = F.when(F.coalesce("error", F.lit("")) == "invalid json", "invalid json").when(F.col("trapped"), "ignored").when(~F.col("allowed"), "rate limited").otherwise(F.col("error"))
    rows = reports.withColumn("_fate", fate)
    place = ["version", "book", "chapter"]
    fresh = rows.where("_fate IS NULL").select(*(F.col(f"report.{c}").alias(c) for c in (*place, "verses")), "ms", F.col("seq").cast("long").alias("seq"), F.lit(None).cast("string").alias("issue"))
    known = open_issues.select(*place, "verses", F.lit(None).cast("long").alias("ms"), F.lit(None).cast("long").alias("seq"), F.col("issue").cast("string").alias("issue"))

    def one(covered: dict, verses: list[int], seq: int | None, issue: str | None) -> tuple[dict, tuple]:
        met = next((covered[v] for v in verses or [] if v in covered), None)
        if issue is not None or met is None:
            for v in verses or []:
                covered.setdefault(v, issue or f"new:{seq}")
        return covered, (None if issue is not None else met,)

    both = fresh.unionAll(known.select(*fresh.columns))
    found = folded(both, place, ["ms", "seq", "issue"], ["verses", "seq", "issue"], "duplicate_of string", dict, one).where("seq IS NOT NULL")
    found = found.select("seq", "duplicate_of", F.when(F.col("duplicate_of").isNull(), "created").otherwise("duplicate").alias("_new"))
    return rows.join(found, "seq", "left").withColumn("outcome", F.coalesce("_fate", "_new")).drop("_fate", "_new")


def _named(key: Column, names: dict[str, str]) -> Column:
    """A display name, or the key where there is none."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key), key) if names else key


def reference(report: Column, books: dict[str, str]) -> Column:
    """`Alma 3:4–6`."""
    verses = report["verses"]
    said = F.when(F.size(verses) == 1, F.get(verses, 0).cast("string")).otherwise(F.concat_ws("–", F.get(verses, 0).cast("string"), F.element_at(verses, -1).cast("string")))
    return F.concat(_named(report["book"], books), F.lit(" "), report["chapter"].cast("string"), F.lit(":"), said)


def issue_title(report: Column, books: dict[str, str]) -> Column:
    return F.concat(F.lit("[correction] "), report["version"], F.lit(" — "), reference(report, books))


def issue_body(report: Column, books: dict[str, str], versions: dict[str, str]) -> Column:
    """Headed parts, texts as quotes, and the report as a fenced block of JSON at the end."""
    part = lambda name, text: F.concat(F.lit(f"**{name}:** "), text)
    quoted = lambda name, c: F.when(c != "", F.concat(F.lit(f"**{name}:**\n> "), F.replace(c, F.lit("\n"), F.lit("\n> "))))
    parts = [part("Version", _named(report["version"], versions)), part("Compared with", _named(report["comparedWith"], versions)), part("Reference", reference(report, books))]
    parts += [part("Error type", _named(report["errorType"], ERROR_TYPES)), quoted("Reported text", report["selectedText"]), quoted("Should say", report["expectedText"]), quoted("Reporter's note", report["description"])]
    parts += [F.when(report["url"] != "", part("Page", report["url"])), F.concat(F.lit("---\n\n```json\n"), F.to_json(report, {"pretty": "true"}), F.lit("\n```"))]
    return F.concat_ws("\n\n", *parts)


def reports_of(issues: DataFrame, versions: list[str], chapters: dict[str, int], body: str = "body") -> DataFrame:
    """Adds report, read from the last fenced block of a body and checked again; null where there is none or it fails (F32)."""
    last = F.try_element_at(F.regexp_extract_all(F.col(body), F.lit(r"(?s)```json\n(.+?)\n```"), 1), F.lit(-1))
    return checked(issues.withColumn("_payload", last), versions, chapters, "_payload").drop("_payload", "trapped", "error")
