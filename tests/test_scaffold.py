"""The scaffold, its borders, segments, anchors of the walk and verse output against plain Python."""

import random
from collections import Counter

import duckdb
import pytest
from textloom.operators import alignment as al
from textloom.operators import kernels, output, scaffold, segments
from textloom.operators.matching import Matcher

WORDS = "and it came to pass that the king of a people went up into land wherefore nevertheless behold another son".split()


def breaks(words, lines, canon):
    return al.merged_breaks(words, lines, canon)


def chain_of(text, target, sizes):
    def single(tokens, n):
        grams = [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
        often = Counter(grams)
        return {g: i for i, g in enumerate(grams) if often[g] == 1}

    chain = []
    for n in sizes:
        there = single(target, n)
        fresh = kernels.increasing(sorted((i, there[g]) for g, i in single(text, n).items() if g in there))
        chain = kernels.increasing(sorted({*chain, *fresh}))
    return chain


def place(i, chain, n, m):
    if not chain:
        t = i * (m / n)
    elif i <= chain[0][0]:
        slope = (chain[1][1] - chain[0][1]) / (chain[1][0] - chain[0][0]) if len(chain) > 1 else 1
        t = chain[0][1] + (i - chain[0][0]) * slope
    elif i >= chain[-1][0]:
        slope = (chain[-1][1] - chain[-2][1]) / (chain[-1][0] - chain[-2][0]) if len(chain) > 1 else 1
        t = chain[-1][1] + (i - chain[-1][0]) * slope
    else:
        k = max(k for k, (s, _) in enumerate(chain) if s <= i)
        (s0, t0), (s1, t1) = chain[k : k + 2]
        t = t0 + (i - s0) / (s1 - s0) * (t1 - t0)
    return int(min(max(t, 0), m - 1) + 0.5)


def plain(words, lines, verses, sizes=(6, 4, 3), least=3):
    """The rules one after another over one version."""
    target = [w for v in verses for w in v]
    owner = [k for k, v in enumerate(verses) for _ in v]
    groups = breaks(words, lines, set(target))
    text = ["".join(words[i] for i in g) for g in groups]
    chain = chain_of(text, target, sizes)
    verse = [owner[place(i, chain, len(text), len(target))] for i in range(len(text))]
    count = Counter(verse)
    good = [v if count[v] >= least else None for v in verse]
    out = []
    for i, v in enumerate(verse):
        before = next((x for x in good[i::-1] if x is not None), None)
        after = next((x for x in good[i:] if x is not None), None)
        out.append(good[i] if good[i] is not None else after if before is None else before if after is None or abs(v - before) <= abs(after - v) else after)
    if None not in out:
        ends = {k: v for k, v in enumerate(verses)}
        out = scaffold.moved(text, out, {k: v[-5:] for k, v in ends.items()}, {k: v[:5] for k, v in ends.items()}, Matcher())
    return {i: v for g, v in zip(groups, out) for i in g if v is not None}


def versions():
    random.seed(11)
    verses = [[random.choice(WORDS) + random.choice(["", "", "x", str(k)]) for _ in range(random.randint(4, 40))] for k in range(40)]
    whole = [w for v in verses for w in v]
    out = {"none": ["zzz"] * 9, "one": whole[5:12], "few": ["q"]}
    for name in range(8):
        text = []
        for _ in range(random.randint(1, 4)):
            a = random.randrange(len(whole) - 60)
            text += whole[a : a + random.randint(20, 300)]
        text = [w for w in text for w in ([w[:2], w[2:]] if random.random() < 0.1 and len(w) > 4 else [w] if random.random() < 0.93 else [])]
        out[f"v{name}"] = text
    out["all"] = whole * 2
    return verses, {k: (v, [i // random.choice([1, 3, 7]) if k != "all" else i // 9 for i in range(len(v))]) for k, v in out.items()}


def test_scaffold_is_the_plain_one(spark):
    verses, made = versions()
    made = {k: (w, sorted(lines)) for k, (w, lines) in made.items()}
    rows = [(k, i, x, n, "extra") for k, (w, lines) in made.items() for i, (x, n) in enumerate(zip(w, lines))]
    words = spark.createDataFrame(rows, "version string, pos long, norm string, line_no long, unit string").drop("unit").repartition(5)
    canon = spark.createDataFrame([(k, f"b{k // 15}", v) for k, v in enumerate(verses)], "ord long, book string, norms array<string>").repartition(3)
    got = {}
    for r in scaffold.scaffolded(words, canon).collect():
        got.setdefault(r["version"], {})[r["pos"]] = r["verse_ord"]
    for name, (w, lines) in made.items():
        assert got.get(name, {}) == plain(w, lines, verses), name
    assert scaffold.scaffolded(words.limit(0), canon).count() == 0


def test_units_are_the_merged_breaks(spark):
    canon = spark.createDataFrame([(0, ["ab", "abc", "cd", "a", "b", "bb"])], "ord long, norms array<string>")
    random.seed(4)
    made = {str(v): ([random.choice(["a", "b", "c", "d", "ab", "bb"]) for _ in range(30)], sorted(random.randrange(20) for _ in range(30))) for v in range(20)}
    rows = [(v, i, w, n) for v, (ws, ns) in made.items() for i, (w, n) in enumerate(zip(ws, ns))]
    out = scaffold.units(spark.createDataFrame(rows, "version string, pos long, norm string, line_no long"), canon).collect()
    for v, (ws, ns) in made.items():
        want = breaks(ws, ns, {"ab", "abc", "cd", "a", "b", "bb"})
        got = {}
        for r in out:
            if r["version"] == v:
                got.setdefault(r["unit"], []).append(r["pos"])
        assert [sorted(got[k]) for k in sorted(got)] == want
        assert {r["unit"]: r["joined"] for r in out if r["version"] == v and r["first"]} == {k: "".join(ws[i] for i in g) for k, g in enumerate(want)}


BORDERS = [
    # words, verses before, verses after, tail, head
    ("father and it came", [0, 0, 1, 1], [0, 1, 1, 1], ["my", "father"], ["and", "it", "came"]),
    ("so never the less it", [0, 0, 0, 1, 1], [0, 1, 1, 1, 1], ["thus", "so"], ["nevertheless", "it"]),
    ("saw an other and he", [0, 0, 1, 1, 1], [0, 0, 0, 1, 1], ["saw", "another"], ["and", "he"]),
    ("saw where for and he", [0, 0, 1, 1, 1], [0, 1, 1, 1, 1], ["saw"], ["wherefore", "and"]),
    ("alpha and beta", [0, 0, 2], [0, 0, 2], ["alpha"], ["and"]),
    ("alpha and beta", [0, 0, 1], [0, 0, 1], ["alpha", "and"], ["and"]),
]


@pytest.mark.parametrize("text,before,after,tail,head", BORDERS)
def test_borders(text, before, after, tail, head):
    assert scaffold.moved(text.split(), before, {0: tail, 1: ["x"]}, {1: head, 2: head}, Matcher()) == after


def test_borders_in_chains_are_those_of_the_whole(spark):
    random.seed(8)
    verses = [[random.choice(WORDS) for _ in range(random.randint(2, 12))] for _ in range(60)]
    canon = spark.createDataFrame([(k, v) for k, v in enumerate(verses)], "ord long, norms array<string>")
    made = {}
    for name in range(12):
        text, verse, k = [], [], random.randrange(5)
        while k < 58:
            n = random.choice([1, 2, 3, 5, 24, 25, 40])
            part = [random.choice(verses[k] + verses[k + 1] + ["an", "other", "never", "the", "less", "where", "for"]) for _ in range(n)]
            text += part
            verse += [k] * n
            k += random.choice([1, 1, 1, 2, 5])
        made[str(name)] = (text, verse)
    rows = [(k, i, w, v) for k, (t, o) in made.items() for i, (w, v) in enumerate(zip(t, o))]
    out = scaffold.refined(spark.createDataFrame(rows, "version string, unit long, joined string, ord long").repartition(4), canon).collect()
    got = {k: [r["ord"] for r in sorted((r for r in out if r["version"] == k), key=lambda r: r["unit"])] for k in made}
    tails, heads = {k: v[-5:] for k, v in enumerate(verses)}, {k: v[:5] for k, v in enumerate(verses)}
    changed = 0
    for k, (t, o) in made.items():
        want = scaffold.moved(t, o, tails, heads, Matcher())
        changed += want != o
        assert got[k] == want
    assert changed


def test_a_border_moves_through_a_long_text_that_repeats_a_word(spark):
    """Words are gathered near borders only, and farther where a border goes farther."""
    canon = spark.createDataFrame([(0, ["so", "aa"]), (1, ["xy", "zz"]), (2, ["end"])], "ord long, norms array<string>")
    words, verse = ["so", "a"] + ["a"] * 500 + ["q"] * 90, [0, 0] + [1] * 590
    rows = [("long", i, w, v) for i, (w, v) in enumerate(zip(words, verse))] + [("short", 0, "so", 0), ("short", 1, "a", 0), ("short", 2, "a", 1), ("short", 3, "b", 1)]
    out = scaffold.refined(spark.createDataFrame(rows, "version string, unit long, joined string, ord long"), canon)
    got = {(r["version"], r["unit"]): r["ord"] for r in out.collect()}
    want = scaffold.moved(words, verse, {0: ["so", "aa"]}, {1: ["xy", "zz"]}, Matcher())
    assert want[500] == 0 and [got["long", i] for i in range(len(words))] == want
    assert [got["short", i] for i in range(4)] == [0, 0, 0, 1]


def test_no_window_of_the_scaffold_looks_ahead_row_by_row(spark, capsys):
    """A frame up to the end of a version is summed anew for each word: quadratic in its length."""
    rows = spark.createDataFrame([("v", k, "w", k // 5, 1) for k in range(20)], "version string, unit long, joined string, ord long, t long")
    chain = spark.createDataFrame([("v", 2, 3), ("v", 7, 9)], "version string, s long, t long")
    placed = scaffold.interpolated(rows.drop("ord", "t"), chain, spark.range(30).withColumnRenamed("id", "t"))
    assert [r["t"] for r in placed.orderBy("unit").limit(9).collect()] == [1, 2, 3, 4, 5, 7, 8, 9, 10]
    for out in (placed, scaffold.kept(rows, 3)):
        out.explain()
        assert "currentrow$(), unboundedfollowing$()" not in capsys.readouterr().out


def common(window, canon, match):
    size = [0] * (len(canon) + 1)
    for w in window:
        now = [0]
        for j, c in enumerate(canon):
            now.append(size[j] + 1 if match(w, c) else max(size[j + 1], now[j]))
        size = now
    return size[-1]


def test_best_start_is_the_plain_search():
    random.seed(2)
    match = Matcher()
    for _ in range(60):
        verses = [("b", [random.choice(WORDS) + random.choice(["", "e"]) for _ in range(random.randint(0, 14))]) for _ in range(random.randint(1, 12))]
        window = [random.choice(WORDS) for _ in range(random.randint(0, 12))]
        low = random.randrange(len(verses))
        high, ahead = random.randint(low, len(verses)), random.randint(0, 4)
        scores = [common(window, [w for _, v in verses[j : min(j + max(1, ahead), high)] for w in v], match) for j in range(low, high)]
        want = low + scores.index(max(scores)) if scores and window else low
        assert al.best_start(window, verses, low, high, match, ahead) == want


def test_walk_with_anchor_search():
    random.seed(6)
    verses = [("a", ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(5)]) for _ in range(30)]
    words = [w for k in (11, 12) for w in verses[k][1]] + ["chapter"] + [w for k in (25, 26) for w in verses[k][1]]
    found = al.walk(words, [0] * 10 + [1] + [2] * 10, {10: None}, verses, al.Walk(anchor_words=8, anchor_ahead=1, ratio=1.0))
    assert found[:10] == [11] * 5 + [12] * 5 and found[-5:] == [26] * 5
    assert al.walk(words, [0] * 21, {10: None}, verses)[0] == 0


BOOKS = ("nephi", "alma", "helaman")


def heading(c):
    from textloom.functions import text as T

    return T.is_chapter_heading(c, BOOKS)


SEGMENTS = [
    (["thus ended the days", "THE BOOK OF ALMA,", "THE SON OF ALMA.", "CHAPTER I.", "The account of", "Now it came"], False, [(1, "the book of alma")]),
    (["thus ended", "THE BOOK OF ALMA,", "THE SON OF ALMA.", "The account", "CHAPTER II.", "And it"], False, [(1, "the book of alma"), (4, "chapter ii")]),
    (["and they were not", "BOOK OF ALMA.", "CHAPTER I.", "AND now I"], False, []),
    (["of the judges And thus ended", "the book of Helaman, according", "man and his sons."], False, [(1, "the book of helaman according")]),
    (["of the judges And thus ended", "the book of Helaman, according", "man and his sons."], True, []),
    (["who are", "THE BOOK OF NEPHI,", "THE SON OF NEPHI, WHO WAS", "OF HELAMAN.", "CHAPTER I.", "And"], True, [(1, "the book of nephi the son of nephi who was of helaman")]),
    (["thus ended", "CHAPTER I.", "And it", "CHAPTER II.", "And again"], False, [(1, "chapter i"), (3, "chapter ii")]),
    (["CHAPTER I.", "And it"], False, []),
]


@pytest.mark.parametrize("capitals", [False, True])
def test_segments(spark, capitals):
    cases = [(str(k), lines, want) for k, (lines, c, want) in enumerate(SEGMENTS) if c == capitals]
    rows = [(v, i, t) for v, lines, _ in cases for i, t in enumerate(lines)]
    out = segments.segments(segments.heading_lines(spark.createDataFrame(rows, "version string, line_no long, text string"), heading, capitals)).collect()
    for v, lines, want in cases:
        own = sorted((r for r in out if r["version"] == v), key=lambda r: r["line_no"])
        assert [(r["line_no"], r["heading"]) for r in own if r["heading"]] == want
        assert [r["segment"] for r in own] == [sum(i >= n for n, _ in want) for i in range(len(lines))]


def test_line_starts(spark):
    words = spark.createDataFrame([("v", i, 1, n) for i, n in enumerate([1, 1, 2, 3, 3])], "version string, pos long, page int, line int")
    assert [r["starts"] for r in segments.line_starts(words).orderBy("pos").collect()] == [True, False, True, True, False]


def written(spark, lines, canon):
    """Lines (page, line, text, markdown, [(words, ord)]) as verse_lines() and joined_lines() write them."""
    rows, infos, pos = [], [], 0
    for page, line, text, markdown, parts in lines:
        infos.append(("v", page, line, text, markdown, "url"))
        at = 0
        for n, verse in parts:
            for w in text.split()[at : at + n]:
                rows.append(("v", pos, w, page, line, at, verse))
                at, pos = at + 1, pos + 1
    words = spark.createDataFrame(rows, "version string, pos long, raw string, page int, line int, word int, ord long")
    info = spark.createDataFrame(infos, "version string, page int, line int, text string, markdown string, source string")
    grid = spark.createDataFrame([(k, "b", 1, k, t) for k, t in canon.items()], "ord long, book string, chapter int, verse int, text string")
    return output.joined_lines(output.verse_lines(words, info), grid), grid


def test_verse_output(spark):
    lines = [
        (7, 10, "& it came that many did per", None, [(7, 5)]),
        (7, 11, "ish in the judg-", None, [(4, 5)]),
        (7, 12, "ment a ship of judgment-", None, [(5, 5)]),
        (7, 13, "seat unto me look & I lookt", None, [(4, 5), (3, 6)]),
        (8, 1, "rney into the wilderness", "rney ~~un~~ into the wilderness", [(4, 6)]),
        (8, 2, "lost words", None, [(2, 99)]),
    ]
    out, grid = written(spark, lines, {5: "many did perish in the judgment a ship of judgment-seat", 6: "and I looked journey into the wilderness"})
    verses = {r["ord"]: r["lines"] for r in output.verses(out, grid).collect()}
    assert [x["text"] for x in verses[5]] == ["& it came that many did per", "ish in the judg", "ment a ship of judgment-", "seat unto me look"]
    assert [x["id"] for x in verses[5]] == ["7:10", "7:11", "7:12", "7:13a"] and verses[6][0]["id"] == "7:13b"
    assert verses[6][0]["text"] == "& I lookt " and verses[6][0]["source"] == "url"
    assert (verses[6][1]["text"], verses[6][1]["markdown"]) == ("rney into the wilderness", "rney ~~un~~ into the wilderness")
    assert 99 not in verses and verses[5][0]["markdown"] is None


def test_joins_by_the_whole_canon(spark):
    lines = [(1, 1, "exceed", None, [(1, 1)]), (1, 2, "ing the", None, [(2, 1)]), (1, 3, "mo re", None, [(2, 1)]), (1, 4, "com", None, [(1, 1)]), (1, 5, "fort", None, [(1, 1)])]
    out, _ = written(spark, lines, {1: "exceedingly", 2: "exceeding more com fort comfort"})
    assert [r["text"] for r in out.orderBy("first").collect()] == ["exceed", "ing the ", "mo re ", "com ", "fort"]


def line(page, number, text, markdown=None, id_=None):
    return (id_ or f"{page}:{number}", page, number, text, markdown, "url")


def test_insertions(spark):
    lines = [line(1, 1, "a b c d ", "a ~~x~~ b c [d] "), line(1, 2, "e f")]
    verses = spark.createDataFrame([("v", 3, "alma", 1, 2, lines), ("w", 4, "alma", 1, 3, lines)], f"version string, ord long, book string, chapter int, verse int, lines array<{output.LINE}>")
    schema = "idx long, ord long, text string, markdown string, before_page int, before_line int, after_page int, after_line int, after_word int"
    n = None
    steps = [
        (1, 3, "first", n, 1, 1, n, n, n),
        (2, 3, "mid", "[mid]", n, n, 1, 1, 1),
        (3, 3, "late", n, n, n, 1, 1, n),  # after the first half, which has the line's number still
        (4, 3, "lost", n, n, n, 9, 9, n),
        (5, 3, "end", n, n, n, n, n, n),
        (6, 3, "whole", n, n, n, 1, 2, 1),  # nothing is left for a second half
        (7, 77, "nowhere", n, n, n, n, n, n),
    ]
    ins = spark.createDataFrame(steps, schema)
    out = {r["version"]: r for r in output.inserted(verses, ins).collect()}
    got = [(x["id"], x["text"], x["markdown"]) for x in out["v"]["lines"]]
    new = "ins:alma-1-2"
    assert got == [
        (new, "first", n), ("1:1:pre", "a b", "a ~~x~~ b"), (new, "late", n), (new, "mid", "[mid]"), ("1:1:post", "c d ", "c [d]"),
        ("1:2:pre", "e f", n), (new, "whole", n), (new, "lost", n), (new, "end", n),
    ]
    assert out["v"]["warnings"] == ["after 9:9 not found, appended"] and out["w"]["warnings"] == []
    assert [x["id"] for x in out["w"]["lines"]] == ["1:1", "1:2"]
    assert [r["idx"] for r in output.unplaced(verses, ins).collect()] == [7]


def test_overrides_by_words(spark):
    words = spark.createDataFrame([("v", i, 1, 1, i, 0) for i in range(5)], "version string, pos long, page int, line int, word int, verse_ord long")
    overrides = spark.createDataFrame([(1, 1, 1, None, None, 9, [1, 3]), (2, 1, 1, 3, 4, 8, None), (3, 5, 5, None, None, 7, None)], "idx long, page int, line int, low int, high int, target long, words array<int>")
    assert [r["verse_ord"] for r in al.with_overrides(words, overrides).orderBy("pos").collect()] == [0, 9, 0, 8, 8]
    assert [r["idx"] for r in al.unmatched_overrides(words, overrides).collect()] == [3]


def test_walk_of_many_versions(spark):
    random.seed(7)
    verses = [["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(3)] for _ in range(20)]
    canon = spark.createDataFrame([(k, "a", v) for k, v in enumerate(verses)], "ord long, book string, norms array<string>")
    rows = [(f"v{v}", i, w, i // 4, None, None) for v in range(30) for i, w in enumerate(w for verse in verses for w in verse)]
    words = spark.createDataFrame(rows, "version string, pos long, norm string, line_no long, heading string, book string").repartition(7)
    out = al.align(words, canon).collect()
    assert len(out) == len(rows) and all(r["verse_ord"] == r["pos"] // 3 for r in out)
    assert al.align(words, canon.limit(0)).count() == 0 and al.align(words.limit(0), canon).count() == 0


def test_borders_of_rows_as_of_words(spark):
    """A version that is a row is refined without a shuffle, and as its words are."""
    random.seed(12)
    made = []
    for k in range(30):
        pool = ["".join(random.choice("abc") for _ in range(random.randint(1, 7))) for _ in range(9)]
        canon = [[random.choice(pool) for _ in range(random.randint(1, 9))] for _ in range(random.randint(1, 6))]
        verse = sorted(random.choices(range(len(canon)), k=random.randint(1, 60)))
        made.append((f"v{k}", [random.choice(pool) for _ in verse], verse, canon))
    rows = spark.createDataFrame(made, "version string, words array<string>, verse array<bigint>, canon array<array<string>>")
    got = scaffold.refined_rows(rows)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([(n, u, w, v) for n, ws, vs, _ in made for u, (w, v) in enumerate(zip(ws, vs))], "version string, unit long, joined string, ord long")
    grid = spark.createDataFrame([(n, i, w) for n, _, _, c in made for i, w in enumerate(c)], "version string, ord long, norms array<string>")
    want = {(r["version"], r["unit"]): r["ord"] for r in scaffold.refined(words, grid, ["version"]).collect()}
    assert {(r["version"], u): v for r in got.collect() for u, v in enumerate(r["verse"])} == want
    assert any(v != r[2][u] for r in made for u in range(len(r[2])) for v in [want[r[0], u]])


def test_verses_are_written_in_proportion_to_the_text(spark, capsys):
    """Pieces are not counted off from the start of a document each, and the canon's words are made once, not for each join."""
    from textloom.plans import chain as plans

    out = plans.verse_outputs(spark, "/root/testdata/sf0.001")
    out.explain()
    plan = capsys.readouterr().out
    assert "substr" not in plan and "documents.parquet" in plan
    assert plan.count("levenshtein") <= 2  # worked out once a line


def test_canon_words_of_odd_verses(spark):
    canon = spark.createDataFrame([(0, "It's  a Ship-wreck\n- Émile 9"), (1, "- 12"), (2, None)], "ord long, text string")
    got = {r["ord"]: (r["spoken"], r["compounds"]) for r in output.canon_index(canon).collect()}
    assert got == {0: ("its a shipwreck mile", ["shipwreck", ""]), 1: ("", [""]), 2: (None, None)}
    lines = [(1, 1, "9", None, [(1, 1)]), (1, 2, "7 ship", None, [(2, 1)]), (1, 3, "wreck", None, [(1, 1)])]
    out, _ = written(spark, lines, {0: "It's  a Ship-wreck", 1: "- 12"})
    assert [r["text"] for r in out.orderBy("first").collect()] == ["9 ", "7 ship", "wreck"]


def test_verses_in_their_document_are_not_shuffled(spark, monkeypatch):
    """Lines are stored once, without a shuffle; a line without words is not numbered; what a verse leaves open asks the canon (F1)."""
    from textloom.plans import chain as plans

    first = []

    def seen(df, keep=output.stored):
        first.append(df)
        return keep(df)

    monkeypatch.setattr(output, "stored", seen)
    text = "the ship came over the sea and was br" + "oken by a great " + "- " * 11 + "the sea " * 20 + "of broken " * 30
    docs = spark.createDataFrame([(7, None, text), (8, "b", ""), (None, "c", "nobody")], "doc_id long, source string, text string")
    monkeypatch.setattr(plans, "table", lambda *_: docs)
    got = plans.verse_outputs(spark, "none").orderBy("ord", "n").collect()
    assert "Exchange" not in first[0]._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 7 AS doc_id, NULL::VARCHAR AS source, ?::VARCHAR AS text", [text])
    want = con.execute(f"SELECT version, ord, n, id, text, markdown FROM ({plans.ORACLES['verse_outputs']}) ORDER BY ord, n").fetchall()
    assert [tuple(r) for r in got] == want and any(r["markdown"] for r in got)


def test_pairs_of_the_canon(spark):
    canon = spark.createDataFrame([(0, "It's a ship, a Ship"), (1, "wreck - and a"), (2, None)], "ord long, text string")
    asked = spark.createDataFrame([("its a",), ("a ship",), ("ship wreck",), ("wreck and",), ("no pair",)], "_pair string")
    assert sorted(r["_pair"] for r in output.said_pairs(canon, asked).collect()) == ["a ship", "its a", "wreck and"]
    assert output.said_pairs(canon, asked.where("false")).count() == 0
