import random
import textwrap

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import diffing, limits, sequences
from textloom.plans import texts as texts_plan
from textloom.streaming.limits import limited, step


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_tokens_and_normalisers(spark):
    assert values(spark, T.display_tokens(F.col("t")), [("can't naïve —“ x y",)], "t string") == [["can", "'", "t", "na", "ï", "ve", "—“", "x", "y"]]
    words = [("judgment-seat",), ("été",), ("a~~b~~c",), ("[in]{{x}}&",)]
    assert values(spark, T.transcript_word(F.col("t")), words, "t string") == ["judgmentseat", "t", "ac", "inxand"]
    assert values(spark, T.report_words(F.col("t")), [("Judgment-seat & x",)], "t string") == [["judgment", "seat", "and", "x"]]


def test_match_levels(spark):
    rows = [("haveing", "having"), ("spak", "spake"), ("him", "hum"), ("", "x"), ("same", "same")]
    assert values(spark, T.match_level(F.col("a"), F.col("b")), rows, "a string, b string") == [2, 3, 0, 0, 1]
    assert values(spark, T.match_level(F.col("a"), F.col("b"), F.col("c")), [("yea", "indeed", "indeed")], "a string, b string, c string") == [4]


def test_spacing_marks_and_wrap(spark):
    assert values(spark, T.space_between(F.col("a"), F.col("b")), [("a", "b"), ("a", ","), ("(", "b"), ("x-", "y"), ("", "b")], "a string, b string") == [" ", "", "", "", ""]
    assert values(spark, T.marks(F.col("n")), [([5, 1, 2, 3, 3],), ([],)], "n array<int>") == ["1-3,5", ""]
    assert values(spark, T.parsed_marks(F.col("t")), [("1-3,5",), ("1-2-9",), ("3-1",), ("x",), ("0",), ("0-3",), ("1234567",), ("-5",), ("5-",), ("",), (None,), ("2, 1 - 2",), ("1,",), ("2.0,1e1",), ("1.5",), ("1-999999999",)], "t string") == [
        [1, 2, 3, 5], [1, 2], None, None, None, None, [1234567], None, None, None, None, [1, 2], None, [2, 10], None, None,
    ]
    line = "the quick brown fox jumps over a lazy dog and then some more words follow here"
    assert values(spark, T.wrapped(F.col("t"), 20), [(line,)], "t string") == [textwrap.wrap(line, 20)]


def test_joining_of_lines(spark):
    c = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    ask = lambda words, bigrams, everywhere: T.join_decision(F.col("a"), F.col("b"), c(*words), c(*bigrams), c(*everywhere), c())
    rows = [("wildern", "ess")]
    assert values(spark, ask(["wilderness"], [], []), rows, "a string, b string") == [""]
    assert values(spark, ask([], ["wildern ess"], ["wilderness"]), rows, "a string, b string") == [" "]
    assert values(spark, ask([], [], ["wilderness"]), rows, "a string, b string") == [""]
    assert values(spark, ask([], [], []), rows, "a string, b string") == [" "]


def test_chapter_statistics(spark):
    left = spark.createDataFrame([("b", 1, 1, "alpha bravo charlie delta echo"), ("b", 1, 2, "same"), ("b", 1, 3, "one"), ("b", 2, 1, "x")], "book string, chapter int, verse int, text string")
    right = spark.createDataFrame([("b", 1, 1, "alpha ZULU charlie delta YANKEE"), ("b", 1, 2, "same")], "book string, chapter int, verse int, text string")
    out = diffing.chapter_stats(diffing.pair_positions(left, right, ["book", "chapter"], "verse"), ["book", "chapter"]).collect()
    assert [tuple(r) for r in out] == [("b", 1, 3, 2, 3)]


def test_limits_have_strict_edges(spark):
    events = spark.createDataFrame([("a", i * 61_000) for i in range(40)] + [("b", 0), ("b", 60_000), ("b", 60_001)], "k string, ms long")
    out = {r["k"]: (r["events"], r["allowed"]) for r in limits.allowed(events, "k", "ms", [(60_000, 3), (3_600_000, 30)]).collect()}
    assert out == {"a": (40, 30), "b": (3, 3)}
    assert [r["windows"] for r in limits.hits(events, "k", "ms", 60_000, 10).orderBy("k").collect()] == [40, 2]
    assert step(2, 0, 60_000, 60_000) == (3, 0) and step(2, 0, 60_001, 60_000) == (1, 60_001)


def test_stream_of_limits(spark, tmp_path):
    spark.createDataFrame([("a", 0), ("a", 5), ("b", 1), ("a", 200), ("a", 201)], "k string, ms long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ms long").parquet(str(tmp_path / "in"))
    q = limited(stream, "k", "ms", 100, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("limited").collect()) == [("a", 0, 1, False), ("a", 5, 2, True), ("a", 200, 1, False), ("a", 201, 2, True), ("b", 1, 1, False)]


def test_sequences(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([None, 10, None, 14, None, None])], "k int, p int, t int")
    assert [r["x"] for r in sequences.interpolated(df, ["k"], "p", "t", "x").orderBy("p").collect()] == [8, 10, 12, 14, 16, 18]
    lines = spark.createDataFrame([(1, i, v) for i, v in enumerate("xxyz")] + [(2, 0, "q")], "line int, pos int, verse string")
    assert [r["s"] for r in sequences.lettered(lines, ["line"], ["pos"], ["verse"], "s").orderBy("line", "pos").collect()] == ["a", "a", "b", "c", None]


def test_corpus_files(spark, tmp_path):
    import json

    from textloom.sources import corpus

    for name, records in {
        "v1/b/2.json": [{"book": "b", "chapter": 2, "verse": 1, "text": "flat", "source": "u"}],
        "v2/b/10.json": [{"book": "b", "chapter": 10, "verse": n, "lines": [{"id": "1:1", "page": 1, "line": 1, "text": "one ", "markdown": None}, {"id": "1:2", "page": 1, "line": 2, "text": "two", "markdown": "[two]"}]} for n in (2, 1)],
    }.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps(records))
    v = corpus.verses(spark, str(tmp_path / "in"))
    got = [(r["version"], r["chapter"], r["pos"], r["verse"], r["text"], r["markdown"]) for r in v.orderBy("version", "pos").collect()]
    assert got == [("v1", 2, 1, 1, "flat", None), ("v2", 10, 1, 2, "one two", "one [two]"), ("v2", 10, 2, 1, "one two", "one [two]")]
    assert [r[0] for r in corpus.versions(v, ["v2"]).collect()] == ["v2", "v1"]
    corpus.write_verses(v, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_pairs_cross_bands_of_length(spark):
    random.seed(3)
    opening = "In the beginning was the word, and the word was"
    rows = [(i, opening + "x" * random.choice([1, 2, 3, 49, 50, 51, 400, 5000])) for i in range(60)] + [(60 + i, str(i % 3) * 40 + "y" * i) for i in range(60)]
    rows += [(200, "short"), (201, "short"), (202, "shorter"), (203, None), (204, None), (None, "short"), (205, "z" * 49), (206, "z" * 50)]
    order = sorted((t[:40], len(t), i) for i, t in rows if t is not None and i is not None)
    expected = sorted((a[2], b[2]) for a, b in zip(order, order[1:]) if a[0] == b[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, diffing.near_pairs(df).collect())) == expected
    assert (205, 206) in expected and (200, 201) in expected


def test_wrapped_lines_has_every_line(spark, tmp_path):
    texts = ["one line", "a first line\n" + "many words of verse " * 30 + "\n\nlast", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line"]): (r["lines"], r["n_lines"]) for r in texts_plan.wrapped_lines(spark, str(tmp_path)).collect()}
    expected = {}
    for i, t in enumerate(texts):
        for n, line in enumerate([None] if t is None else t.split("\n"), 1):
            lines = None if line is None else [w.removeprefix("###") for w in textwrap.wrap(line, 43, initial_indent="###")]
            expected[i, n if t is not None else None] = (None, None) if lines is None else ("\n".join(lines[:8]), len(lines))
    assert {k: v if k[1] else (None, None) for k, v in got.items()} == expected
