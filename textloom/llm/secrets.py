"""Secret scans with DataFrame functions only.

Three base patterns (assignments, access keys, hex keys) are joined by a learned rule: long tokens of letters and digits
are scored by two character Markov models, one of random strings and one of ordinary identifiers; a token whose
log-likelihood ratio passes a threshold is a `markov` span. The models are trained in Spark from labelled samples and go
into the plan as one array of fixed size (alphabet squared). A scan has no shuffle: each text is judged in its row.

Offsets are code points, ends exclusive. Edge cases: a null text counts as empty and has no spans; repeated rows are
scanned one by one; other columns pass through, but those named as the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import with_text

#: The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ["assign", "access", "hex", "markov"]

#: Tokens that the models judge: 20 characters or more, with a letter and a digit.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD = 8.0  # nats by which a random string must be likelier

_WORDS = (
    "account action active address agent alpha amount answer archive article author backup balance batch beta block board border bottom branch "
    "bucket buffer build button cache call camera category center channel chapter check child class client cloud code color column command "
    "comment config connection content context control copy count country course create currency current customer data date day default delete "
    "delta description detail device direction document domain download draft driver edit element email enabled end entry error event example "
    "export feature field file filter final first folder font footer form format frame function gallery game group guide handler header height "
    "history home host hour image import index info input invoice item job join key label language last layout level library license line link "
    "list local location login long main manager map market master match media member memory menu message method minute model module month name "
    "network news next node note number object offer office option order output owner package page panel parent part party path payment phone "
    "photo picture place plan platform player point policy position post price primary print private process product profile program project "
    "public query question queue random range rate record region release report request reset resource response result review role room root rule "
    "sample schedule school score script search second section select sender server service session setting shape share size source space start "
    "state static station status step stock storage store stream string student style subject summary support switch symbol system table target task "
    "team template test text theme thread time title topic total track trade train travel type update upload user value vector version video view "
    "visit volume weather week weight width window worker world year zone"
).split()


def default_samples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled samples (token, label): random strings of three alphabets (1) and identifiers joined from words (0).

    They are made by a rule from row numbers, so that any cluster trains the same models; `rows` of each label.
    """
    i = F.col("id")
    digest = F.concat(*(F.unhex(F.sha2(F.concat(F.lit(f"{salt}:"), i.cast("string")), 256)) for salt in range(2)))
    words = F.array(*map(F.lit, _WORDS))
    h = lambda k: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(1 << 20)).cast("int")
    word = lambda k: F.element_at(words, h(k) % len(_WORDS) + 1)
    size = 20 + F.pmod(h(0), F.lit(29))
    drawn = F.when(i % 3 == 0, F.substring(F.regexp_replace(F.base64(digest), r"\s", ""), F.lit(1), size))
    drawn = drawn.when(i % 3 == 1, F.substring(F.lower(F.hex(digest)), F.lit(1), size))
    drawn = drawn.otherwise(F.substring(F.upper(F.regexp_replace(F.base64(digest), r"[^A-Za-z0-9]", "")), F.lit(1), size))
    number = F.pmod(h(9), F.lit(10000)).cast("string")
    date = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(h(8), F.lit(9000))), "yyyy-MM-dd")
    named = F.when(i % 6 == 0, F.concat_ws("_", word(1), word(2), word(3), number))
    named = named.when(i % 6 == 1, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)), number))
    named = named.when(i % 6 == 2, F.concat_ws("-", date, word(1), word(2), number))
    named = named.when(i % 6 == 3, F.concat_ws("/", word(1), word(2), number, word(3)))
    named = named.when(i % 6 == 4, F.upper(F.concat_ws("_", word(1), word(2), word(3), number)))
    named = named.otherwise(F.concat(word(1), word(2), word(3), word(4), number))
    ids = spark.range(rows)
    return ids.select(drawn.alias("token"), F.lit(1).alias("label")).unionAll(ids.select(named.alias("token"), F.lit(0).alias("label")))


def train(samples: DataFrame, token: str = "token", label: str = "label") -> list[float]:
    """Log-likelihood ratios of character pairs, random (1) against ordinary (0), as a flat array of (len(ALPHABET) + 1) squared.

    Pairs are counted in Spark; what reaches the driver has a row for each pair and label at most. Add-one smoothing.
    """
    n = len(ALPHABET) + 1  # code 0: any other character, and the start
    coded = F.transform(F.split(F.col(token), ""), lambda c: F.instr(F.lit(ALPHABET), c) * (F.length(c) > 0).cast("int"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice(coded, 1, F.size(coded) - 1)).alias("a"), coded.alias("b"))
    rows = samples.where(F.length(token) > 0).select(F.col(label).cast("int").alias("y"), F.explode(pairs).alias("p"))
    counts = [[1.0] * (n * n), [1.0] * (n * n)]
    for r in rows.where("y IN (0, 1)").groupBy("y", "p.a", "p.b").count().collect():
        counts[r["y"]][r["a"] * n + r["b"]] += r["count"]
    sums = [[sum(c[i * n : (i + 1) * n]) for i in range(n)] for c in counts]
    return [math.log(counts[1][k] / sums[1][k // n]) - math.log(counts[0][k] / sums[0][k // n]) for k in range(n * n)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token: above 0 it is likelier a random string. One walk over its characters."""
    n = len(ALPHABET) + 1
    codes = [0] * 128
    for i, c in enumerate(ALPHABET):
        codes[ord(c)] = i + 1
    table, code_of = F.array(*map(F.lit, model)), F.array(*map(F.lit, codes))
    code = lambda c: F.coalesce(F.get(code_of, F.ascii(c)), F.lit(0))
    coded = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), code)
    terms = F.zip_with(F.concat(F.array(F.lit(0)), coded), coded, lambda a, b: F.coalesce(F.get(table, a * n + b), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value being computed once, also where f uses it in functions of elements."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scanned(values: Column, zero: Column, step: Callable[[Column, Column], Column], part: int = 256) -> Column:
    """What step() has made of the values up to each one; in parts, so that no long array is copied for each element."""

    def cut(v: Column) -> Column:
        begins = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / part).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda i: F.slice(v, i * part + 1, F.lit(part)))

    none = F.slice(F.array(zero), 1, 0)
    grown = lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero), x)))
    first = F.struct(zero.alias("run"), none.alias("out"))
    passed = lambda acc, p: F.struct(step(acc["run"], F.element_at(p, -1)).alias("run"), F.concat(acc["out"], F.array(acc["run"])).alias("out"))
    outer = lambda inner: F.aggregate(inner, first, passed, lambda acc: acc["out"])
    whole = lambda inner: F.flatten(F.zip_with(inner, outer(inner), lambda p, base: F.transform(p, lambda x: step(base, x))))
    return let(F.transform(let(values, cut), lambda p: F.aggregate(p, none, grown)), whole)


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column], own: bool = False) -> Column:
    """Array of (start, kind, end) of the pattern's leftmost non-overlapping matches that keep() accepts; own: and text."""
    gaps = F.split(text, pattern, -1)  # with the end of the text, which no match follows
    zipped = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), 0), lambda g, m: F.struct(m.alias("match"), (F.length(g) + F.length(m)).alias("size")))
    zipped = F.filter(zipped, lambda x: x["match"].isNotNull())
    ends = lambda z: scanned(F.transform(z, lambda x: x["size"]), F.lit(0), lambda a, b: a + b)
    named = lambda x, e: F.struct((e - F.length(x["match"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["match"].alias("match"))
    kept = F.filter(let(zipped, lambda z: F.zip_with(z, ends(z), named)), lambda s: keep(s["match"]))
    kept = kept if own else F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int" + (",match:string>>" if own else ">>"))
    return F.when(F.rlike(text, F.lit(pattern)), kept).otherwise(none)


def apart(tokens: Column, base: Column) -> Column:
    """The tokens (sorted, disjoint) that overlap no base span, by one walk over both in order of their starts."""
    row = lambda s, text: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), text.alias("match"))
    both = F.array_sort(F.concat(F.transform(base, lambda s: row(s, F.lit(""))), tokens))
    far = F.lit(2**31 - 1)

    def bounds(b: Column) -> Column:
        ends = scanned(F.transform(b, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), F.lit(0), F.greatest)
        starts = F.reverse(scanned(F.reverse(F.transform(b, lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(far))), far, F.least))
        return F.zip_with(b, F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    marked = let(both, bounds)
    return F.transform(F.filter(marked, lambda m: (m["x"]["kind"] == 3) & (m["y"]["e"] <= m["x"]["start"]) & (m["y"]["s"] >= m["x"]["end"])), lambda m: m["x"])


def find(docs: DataFrame, model: list[float], text: str = "text", out: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """Adds an array of (start, kind, end), by start and then kind; kind is an index of KINDS."""
    docs = with_text(docs, text)
    t = F.col(text)
    yes = lambda m: F.lit(True)
    value = lambda m: F.regexp_extract(m, ASSIGN, 1)
    base = F.concat(
        _spans(t, ASSIGN, 0, lambda m: F.length(value(m)) >= ASSIGN_LEAST),
        _spans(t, ACCESS, 1, lambda m: F.length(m) >= ACCESS_LEAST),
        _spans(t, HEX, 2, yes),
    )
    mixed = lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]"))
    docs = docs.withColumns({"__base": base, "__tokens": _spans(t, TOKEN, 3, mixed, own=True)})
    judged = F.when(F.size("__tokens") > 0, apart(F.col("__tokens"), F.col("__base"))).otherwise(F.col("__tokens"))
    passed = F.filter(judged, lambda s: ratio(s["match"], model) > threshold)
    more = F.transform(passed, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return docs.withColumn(out, F.array_sort(F.concat("__base", more))).drop("__base", "__tokens")


def listed(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark."""
    before = scanned(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
    before = F.concat(F.array(F.lit(0)), before)  # the end of what comes before each span; the last: of all

    def joined(chars: Column) -> Column:
        cut = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
        piece = lambda s, a: F.when(s.isNull(), cut(a, F.greatest(a, F.size(chars)))).when(s["start"] >= a, F.concat(cut(a, s["start"]), F.lit(mark))).otherwise("")
        return F.array_join(F.zip_with(spans, before, piece), "")

    return F.when(F.size(spans) > 0, let(F.filter(F.split(text, ""), lambda c: c != ""), joined)).otherwise(text)
