"""Titles, descriptions and sentences of pages within a budget of characters, and their structured data.

The first of several wordings that fits is taken; names of the site and of the two versions are the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

MOST_TITLE, MOST_DESCRIPTION, MOST_PAGE_TITLE = 60, 155, 70


@dataclass(frozen=True)
class Site:
    name: str
    old: str
    new: str

    @property
    def suffix(self) -> str:
        return f" — {self.name}"


def fitting(most: int, *wordings: Column) -> Column:
    """The first wording of at most so many characters, else the last one."""
    out = wordings[-1]
    for w in reversed(wordings[:-1]):
        out = F.when(F.length(w) <= most, w).otherwise(out)
    return out


def said(template: str, **parts: Column) -> Column:
    """A template with its {parts} filled in."""
    pieces, rest = [], template
    while rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before)] if before else []
        pieces += [parts[name]] if name else []
    return F.concat(*pieces)


def number(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def things(n: Column, one: str, many: str) -> Column:
    """`1 verse`, `1,234 verses`."""
    return F.concat(number(n), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def book_title(book: Column, site: Site) -> Column:
    core = said("{b} — Textual Variants by Chapter", b=book)
    return fitting(MOST_TITLE, F.concat(core, F.lit(site.suffix)), core)


def chapter_title(book: Column, chapter: Column, variants: Column, site: Site) -> Column:
    count = F.when(variants == 0, "No Textual Variants").otherwise(things(variants, "Textual Variant", "Textual Variants"))
    core = said("{b} {c} — {n}", b=book, c=chapter.cast("string"), n=count)
    return fitting(MOST_TITLE, F.concat(core, F.lit(site.suffix)), core)


def chapter_description(book: Column, chapter: Column, variants: Column, verses: Column, site: Site) -> Column:
    parts = {"b": book, "c": chapter.cast("string"), "n": things(variants, "textual variant", "textual variants"), "v": things(verses, "verse", "verses")}
    none = said(f"{{b}} {{c}} has no textual variants between the {site.old} and the {site.new} across its {{v}}", **parts)
    some = said(f"{{b}} {{c}} has {{n}} across its {{v}} between the {site.old} and the {site.new}", **parts)
    body = F.when(variants == 0, none).otherwise(some)
    return fitting(MOST_DESCRIPTION, F.concat(body, F.lit(", including spelling and punctuation.")), F.concat(body, F.lit(".")))


def chapter_sentence(variants: Column, verses: Column, site: Site) -> Column:
    both = f"between the {site.old} and the {site.new}"
    some = said(f"{{n}} across {{v}} {both}, including spelling, capitalization, and punctuation.", n=things(variants, "textual variant", "textual variants"), v=things(verses, "verse", "verses"))
    return F.when(variants == 0, f"No textual variants {both} in this chapter.").otherwise(some)


def book_description(book: Column, variants: Column, chapters: Column, site: Site) -> Column:
    parts = {"b": book, "n": things(variants, "textual variant", "textual variants"), "c": things(chapters, "chapter", "chapters")}
    none = fitting(MOST_DESCRIPTION, said(f"{{b}} has no textual variants between the {site.old} and the {site.new} across its {{c}}.", **parts), said("{b} has no textual variants across its {c}.", **parts))
    some = fitting(MOST_DESCRIPTION, said(f"{{b}} has {{n}} across {{c}}, compared verse by verse between the {site.old} and the {site.new}.", **parts), said("{b} has {n} across {c}.", **parts))
    return F.when(variants == 0, none).otherwise(some)


def book_sentences(book: Column, variants: Column, verses: Column, chapters: Column, busiest: Column, most: Column, site: Site) -> Column:
    """Two sentences on a book; busiest: its chapter with the most variants, of which there are `most`."""
    half_up = lambda x: F.floor(x + 0.5)
    parts = {"b": book, "n": things(variants, "textual variant", "textual variants"), "c": things(chapters, "chapter", "chapters"), "v": number(verses), "k": busiest.cast("string"), "m": number(most)}
    against = f"when the {site.old} is set against the {site.new}"
    first = said(f"{{b}} carries {{n}} across {{c}} {against}, including spelling, capitalization, and punctuation.", **parts)
    one = said("Its {v} verses carry an average of {a} variants each.", a=number(half_up(variants / verses)), **parts)
    many = said("Chapter {k} varies most, with {m}; across the book that is an average of {a} variants per chapter.", a=number(half_up(variants / chapters)), **parts)
    none = F.array(said(f"{{b}} carries no textual variants across {{c}} {against}.", **parts), said("All {v} of its verses read identically in both witnesses.", **parts))
    return F.when(variants == 0, none).otherwise(F.array(first, F.when(chapters == 1, one).otherwise(many)))


def version_title(name: Column, short: Column, site: Site) -> Column:
    """Name or short name with the site's, else the short name alone."""
    return fitting(MOST_PAGE_TITLE, F.concat(name, F.lit(site.suffix)), F.concat(short, F.lit(site.suffix)), short)


def structured(kind: str, *, site: Site, site_url: str, **fields: Column) -> Column:
    """An object of structured data (F42): Article with its publisher, CollectionPage, Dataset with its creator, Organization."""
    organization = F.struct(F.lit("Organization").alias("@type"), F.lit(site.name).alias("name"), F.lit(f"{site_url}/").alias("url"), F.lit(f"{site_url}/logo.svg").alias("logo"))
    if kind == "Organization":
        return organization
    extra = {"Article": [organization.alias("publisher")], "Dataset": [organization.alias("creator"), F.lit(True).alias("isAccessibleForFree")]}.get(kind, [])
    return F.struct(F.lit(kind).alias("@type"), *(c.alias(n) for n, c in fields.items()), *extra)


def graph(*objects: Column) -> Column:
    """Objects as a JSON-LD document that can stand in a script element: every < is escaped."""
    parts = F.concat_ws(",", *(F.to_json(o) for o in objects))
    return F.replace(F.concat(F.lit('{"@context":"https://schema.org","@graph":['), parts, F.lit("]}")), F.lit("<"), F.lit("\\u003c"))
