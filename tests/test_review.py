import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import compare, diffing, kernels, markers, review
from textloom.sources import reports


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_parsed_verses(spark):
    rows = ["3-5", " 7 – 7 ", "5,1, 1x,2", "", "0", "9-3", "1-21", "1-20", "a,2", "2,", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(T.parsed_verses(F.col("x"))).collect()]
    assert got == [[3, 4, 5], [7], [1, 2, 5], None, None, None, None, list(range(1, 21)), None, None, None]


def test_markdown_slices(spark):
    def brute(text, md, low, high):
        words, places, struck, i = md.split(), [0], False, 0
        for _ in text.split():
            while i < len(words) and (struck or words[i].startswith("~~")):
                struck = not words[i].endswith("~~") if struck else not (words[i].endswith("~~") and len(words[i]) > 4)
                i += 1
            i = min(i + 1, len(words))
            places.append(i)
        places[-1] = len(words)
        part = " ".join(words[places[low] : places[high + 1]])
        return part if part and part != " ".join(text.split()[low : high + 1]) else None

    for text, md in (("a b c", "a ~~x~~ b [c]"), ("a b c", "~~x y~~ a b c ~~z~~"), ("a b", "a b"), ("a b c", "{{a}} b ~~q r s~~ c"), ("a b c", "a b")):
        for low in range(len(text.split())):
            for high in range(low, len(text.split())):
                got = one(spark, T.markdown_slice(F.lit(md), F.lit(text), F.lit(low), F.lit(high)))[0]
                assert got == brute(text, md, low, high), (text, md, low, high)


def test_labels_pages_and_headings(spark):
    r = one(
        spark, T.verse_label(F.lit(0)), T.verse_label(F.lit(7)), T.client_address(F.lit(None).cast("string"), F.lit("/s"), F.lit(3)), T.client_address(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(3)),
        T.is_canonical_pair(F.lit("pm"), F.lit("2013")), T.is_cacheable(F.lit("GET"), F.lit(200), F.lit(None).cast("string"), F.lit("/bans/x")), T.is_cacheable(F.lit("GET"), F.lit(200), F.lit(None).cast("string"), F.lit("/a")),
        T.is_chapter_heading(F.lit("The Second Book of N."), ["x"]), T.is_chapter_heading(F.lit("and the book of x"), ["x"]), T.book_of_heading(F.lit("The BOOK, of x one"), [("^the book of x one\\b", "x1"), ("^the book of x\\b", "x")]),
        T.is_variant(F.lit("oar"), F.lit("ore")), T.is_variant(F.lit("desipels"), F.lit("disciples")), T.marks(F.array(*map(F.lit, [5, 1, 2, 3, 2]))), T.marks(F.array().cast("array<int>")),
    )
    assert list(r) == ["Intro", "7", "/s", "cid:3", True, False, True, True, False, "x1", True, True, "1-3,5", ""]


def test_hyphens(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    cases = [("di-", "d", ["did"], [], [], "di"), ("judgment-", "seat", ["judgmentseat"], [], ["judgment-seat"], "judgment-"), ("zz-", "q", ["a"], [], [], "zz-"), ("word", "s", ["words"], [], [], "word")]
    for tail, head, words, others, compounds, want in cases:
        assert one(spark, T.without_hyphen(F.lit(tail), F.lit(head), arr(*words), arr(*others), arr(*compounds)))[0] == want


def test_bleeds_split_words_and_resolved_lines(spark):
    canon = {1: "alpha bravo charlie and the dog", 2: "delta epsilon zeta eta theta", 3: "iota kappa lambda"}
    mine = {0: "title", 1: "alpha bravo charlie delta epsilon", 2: "zeta eta the", 3: "ta io"}
    frame = lambda d: spark.createDataFrame([(1, v, t.split(), [t]) for v, t in d.items()], "k int, verse int, words array<string>, lines array<string>")
    found = review.bleeds(frame(mine), frame(canon), ["k"])
    got = sorted((r["verse"], r["into"], r["type"], tuple(r["tokens"])) for r in found.collect())
    assert got == [(1, 2, "trailing-bleed", ("delta", "epsilon"))]
    assert [r["type"] for r in review.top_bleeds(found, ["k"]).collect()] == ["trailing-bleed"]
    split = review.split_words(frame(mine), frame(canon), ["k"]).collect()
    assert [(r["verse"], r["next_verse"], r["joined"]) for r in split] == [(2, 3, "theta")]
    odd = review.boundary_artefacts(frame(mine | {4: "ab word &"}), frame(canon), ["k"], T.transcript_word)
    assert sorted((r["verse"], r["type"]) for r in odd.collect()) == [(3, "leading-fragment"), (4, "leading-fragment"), (4, "trailing-ampersand")]
    lines = spark.createDataFrame([(1, 1, 0, 9, 1, ["alpha", "bravo"]), (1, 1, 1, 9, 2, ["charlie", "delta", "epsilon"])], "k int, verse int, pos int, page int, line int, norms array<string>")
    best = review.resolved_lines(found, lines, ["k"]).first()
    assert (best["page"], best["line"], best["word_range"]) == (9, 2, [1, 2])


def test_chapters_are_diffed_at_once(spark):
    left, right = ["one two", "three four five"], ["one two three", "four six", "seven"]
    tokens = compare.chapter_tokens(left, right)
    for side, texts in (("left", left), ("right", right)):
        for i, t in enumerate(texts, 1):
            assert [x["value"] for x in tokens if x[f"{side}_verse"] == i] == kernels.display(t)
    assert [x["match"] for x in tokens if x["op"] == "eq"] == [1, 2, 3, 4]
    verses = spark.createDataFrame([(v, "b", 1, i, t) for v, texts in (("om", left), ("x", right), ("y", left)) for i, t in enumerate(texts)], "version string, book string, chapter int, pos int, text string")
    whole = compare.compared(verses, "om", "x", "b", 1).where("op = 'eq'").count()
    paired = compare.compared(verses, "x", "y").collect()
    assert whole == 4 and {r["right_verse"] for r in paired if r["op"] != "del"} == {1, 2} and len({r["left_verse"] for r in paired} - {None}) == 3
    assert [r["extant"] for r in compare.side_by_side(verses, "om", "none").collect()] == ["left only"]


def test_markers_move(spark):
    canon = spark.createDataFrame([(1, "b", 1, 0), (2, "b", 1, 1), (3, "b", 1, 2), (4, "b", 2, 1), (5, "c", 1, 1)], "ord int, book string, chapter int, verse int")
    words = [(1, 1, False, 2), (2, 2, True, 3), (3, 2, True, 3), (4, 3, False, 4), (5, 4, True, 4), (6, 5, False, 5), (7, 6, True, 3), (8, 6, True, 4), (9, 7, False, 1), (10, 8, True, 2), (11, 9, False, 2)]
    df = spark.createDataFrame([("v", pos, 1, line, m, o) for pos, line, m, o in words], "version string, pos int, page int, line int, marker boolean, ord int")
    pushed = [r["ord"] for r in markers.push_forward(df, canon).orderBy("pos").collect()]
    assert pushed == [2, 4, 4, 4, 4, 5, 4, 4, 1, 2, 2]
    assert [r["ord"] for r in markers.attach_orphans(df, canon).orderBy("pos").collect()] == [2, 3, 3, 4, 4, 5, 3, 4, 1, 1, 2]


def test_report_files(spark, tmp_path):
    stats = spark.createDataFrame([(2, "b", 10, 5, 2, 9), (1, "a", 1, 3, 1, 4)], "ord int, book string, chapter int, variant_count long, changed_verse_count long, total_verse_count long")
    reports.write_stats(stats, str(tmp_path / "s"), "pm", "2013", "2024-01-01")
    record = json.loads(reports.stats_record(stats, "pm", "2013", "2024-01-01").first()[0])
    assert record["pair"] == {"v1": "pm", "v2": "2013"} and [c["book"] for c in record["chapters"]] == ["a", "b"]
    assert [r["variantCount"] for r in reports.read_stats(spark, str(tmp_path / "s"), "pm", "2013").collect()] == [3, 5]
    assert reports.read_stats(spark, str(tmp_path / "s"), "om", "2013").count() == reports.read_stats(spark, str(tmp_path / "none"), "pm", "2013").count() == 0
    rows = spark.createDataFrame([("pm", "b", 1, 2), ("om", "b", 1, 3)], "version string, book string, chapter int, findings int")
    reports.write_reports(rows, str(tmp_path / "r"))
    assert [r["findings"] for r in reports.read_reports(spark, str(tmp_path / "r"), "findings int", "om").collect()] == [3]
    findings = spark.createDataFrame([("z", 1, 1, "x", None), ("b", 2, 1, "x", "n"), ("b", 1, 3, "y", "m")], "book string, chapter int, verse int, type string, note string")
    reports.write_suggestions(findings, str(tmp_path / "m"), ["b"])
    assert [r[0] for r in reports.suggestion_lines(findings, ["b"]).orderBy("at").select("line").collect()] == ["## b", "- **y** 1:3 m", "- **x** 2:1 n", "## z", "- **x** 1:1 "]
    assert [(r["book"], r["findings"]) for r in review.by_book(findings, ["z"]).collect()] == [("z", 1), ("b", 1), ("b", 1)]
    reports.write_sitemap(spark.createDataFrame([(1, "http://a/?x=1&y", "2024-01-01"), (0, "http://a/", None)], "ord int, url string, date string"), str(tmp_path / "x"))
    xml = [r[0] for r in spark.read.text(str(tmp_path / "x")).collect()]
    assert xml[0].startswith("<?xml") and xml[-1] == "</urlset>" and "<loc>http://a/?x=1&amp;y</loc><lastmod>2024-01-01</lastmod>" in xml[3]
    log = reports.log_lines(spark.createDataFrame([("error", "m"), ("info", "n")], "level string, message string")).collect()
    assert [r["stream"] for r in log] == ["stderr", "stdout"] and json.loads(log[0]["value"])["message"] == "m"
    assert [r["ms"] for r in reports.request_log(spark.createDataFrame([("/", 200, 1.5)], "path string, status int, duration_ms double")).collect()] == [2]
    assert reports.registry([reports.Adapter("a"), reports.Adapter("b")]).keys() == {"a", "b"}
    with pytest.raises(ValueError):
        reports.registry([reports.Adapter("a"), reports.Adapter("a")])


def test_known_words_beyond_a_broadcast(spark):
    docs = spark.createDataFrame([("s", ["a", "b", "a"]), ("s", []), (None, None), ("s", ["a", "b", "a"])], "source string, w array<string>")
    vocabulary = spark.createDataFrame([("a", 1), ("z", 1)], "w string, known int")
    want = [("None", 0, 0), ("s", 0, 0), ("s", 3, 2), ("s", 3, 2)]
    for most in (10, 1):
        out = review.known_words(docs, vocabulary, most=most).collect()
        assert sorted((str(r["source"]), r["tokens"], r["matched"]) for r in out) == want


def test_sides_without_kinds(spark):
    """Sides read back need no kinds of changes: verses of one pass are those of the classified tokens."""
    df = spark.createDataFrame([(["a b", "", "c d e"], ["a x", "c d", "e f", ""]), ([], ["z"]), (None, [None])], "left array<string>, right array<string>")
    tokens, sides = compare.chapter_diff(df).collect(), compare.chapter_verses(df).collect()
    for t, s in zip(tokens, sides):
        for side, at in (("left", "left_verse"), ("right", "right_verse")):
            want = {}
            for x in t["tokens"]:
                if x[at] is not None:
                    want.setdefault(x[at], []).append(x["value"])
            assert want == {x["verse"]: x["values"] for x in s["sides"] if x["side"] == side}
    rows = spark.createDataFrame([("a b c", "a x c"), ("", ""), ("q", "")], "left_text string, right_text string")
    with_, without = (sorted((r["left_text"], [(t["value"], t["op"]) for t in r["tokens"]], any(t["kind"] for t in r["tokens"])) for r in diffing.with_diff(rows, kinds=k).collect()) for k in (True, False))
    assert [x[:2] for x in with_] == [x[:2] for x in without] and any(x[2] for x in with_) and not any(x[2] for x in without)


def test_bleeds_send_ends_only(spark, monkeypatch):
    """Long verses do not travel: what is stored and joined for them is ten words; their middle still counts as vocabulary."""
    kept = []
    plain = review.stored
    monkeypatch.setattr(review, "stored", lambda df: kept.append(plain(df)) or kept[-1])
    long = [f"m{i}" for i in range(500)]
    canon = [("k", 1, ["a1", "a2", *long, "zebra", "end"]), ("k", 2, ["one", "two", "three", "four", *long])]
    mine = [("k", 1, ["a1", "a2", *long]), ("k", 2, ["zebra", "one", "two", "three", "four", *long])]
    schema = "b string, verse int, words array<string>"
    found = review.bleeds(spark.createDataFrame(mine, schema), spark.createDataFrame(canon, schema), ["b"])
    assert sorted((r["verse"], r["type"], r["into"], r["tokens"], r["score"]) for r in found.collect()) == [(2, "leading-bleed", 1, ["zebra"], 1), (2, "leading-bleed", 1, ["zebra"], 4)]
    sizes = [len(v) for df in kept for r in df.collect() for v in r if isinstance(v, list)]
    assert sizes and max(sizes) <= review.K
