import random

from textloom.operators import alignment as al


def test_words_cut_by_line_breaks():
    canon = {"wherefore", "in", "to", "into"}
    assert al.merged_breaks(["wher", "efore", "in", "to"], [1, 2, 2, 3], canon) == [[0, 1], [2], [3]]
    assert al.merged_breaks(["wher", "efore"], [1, 1], canon) == [[0], [1]]


def test_table_of_matches():
    import random

    random.seed(3)
    words = ["".join(random.choice("abcde") for _ in range(random.randint(0, 9))) for _ in range(90)]
    match = al.Matcher({words[5]: words[6]})
    table = match.table(words, words[::-1])
    assert all(table[i, j] == match(a, b) for i, a in enumerate(words) for j, b in enumerate(words[::-1]))


def test_earliest_match_and_tail():
    assert al.earliest("and it came to pass and".split(), ["and", "pass"], al.Matcher()) == [0, 4]
    assert al.without_sparse_tail([0, 1, 2, 30], 8) == [0, 1, 2]
    assert al.without_sparse_tail([0, 30], 8) == [0, 30]


def test_walk():
    verses = [("a", "now it came to pass".split()), ("a", "that the king spake".split()), ("b", "behold i say unto you".split())]
    words = "now it came to passe that the king spak behold i say unto you".split()
    assert al.walk(words, [0] * len(words), {}, verses) == [0] * 5 + [1] * 4 + [2] * 5
    words = "now it came to pass chapter behold i say unto you".split()
    assert al.walk(words, [0] * 5 + [1] + [2] * 5, {5: "b"}, verses)[6:] == [2] * 5
    assert al.walk([], [], {}, verses) == []


def test_align_and_lines(spark):
    canon = spark.createDataFrame([(0, "a", ["alpha", "bravo", "charlie"]), (1, "a", ["delta", "echo", "foxtrot"])], "ord long, book string, norms array<string>")
    raw = [("v", i, w, 1, 1 + i // 4, i // 4) for i, w in enumerate("Alpha bravo charlie delta echo foxtrot".split())]
    words = spark.createDataFrame([(*r, r[2].lower(), None, None, i % 4) for i, r in enumerate(raw)], "version string, pos long, raw string, page int, line int, line_no int, norm string, heading string, book string, word int")
    found = words.join(al.align(words, canon), ["version", "pos"])
    assert [r["verse_ord"] for r in found.orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1]
    lines = al.lines_of_verses(found).orderBy("first").collect()
    assert [(r["id"], r["text"]) for r in lines] == [("1:1a", "Alpha bravo charlie"), ("1:1b", "delta"), ("1:2", "echo foxtrot")]
    overrides = spark.createDataFrame([(1, 1, 1, 0, 0, 5), (2, 1, 1, 0, 1, 7)], "idx long, page int, line int, low int, high int, target long")
    assert [r["verse_ord"] for r in al.with_overrides(found, overrides).orderBy("pos").collect()] == [7, 7, 0, 1, 1, 1]


def test_reports(spark):
    aligned = spark.createDataFrame([("v", "b", 1, 1, 1, ["alpha beta gamma delta", "epsilon zeta"]), ("v", "b", 1, 2, 2, ["eta theta iota"])], "version string, book string, chapter int, verse int, pos int, lines array<string>")
    canon = spark.createDataFrame([("b", 1, 1, 1, "alpha beta gamma"), ("b", 1, 2, 2, "delta epsilon zeta eta theta iota")], "book string, chapter int, verse int, pos int, text string")
    reports = al.chapter_reports(aligned, canon)
    first = reports.orderBy("verse").first()
    assert [(f["type"], f["into"], f["tokens"]) for f in first["findings"]] == [("trailing-bleed", 2, ["delta", "epsilon", "zeta"])]
    assert first["histogram"] == {"1": 3, "2": 3} and (first["matched"], first["unmatched"]) == (3, 0)
    s = al.report_summary(reports).first()
    assert (s["total_verses"], s["verses_with_findings"], s["trailing_bleed"], s["chapter_bleed"]) == (2, 1, 1, 0)
    assert al.split_word("the right", "eous ness", {"righteous", "ness"}) == "righteous"
    assert al.split_word("in", "to", {"in", "to", "into"}) is None


def test_markup(spark):
    assert [(t["text"], t["kind"], len(t["segments"] or [])) for t in al.markup("go dow[n] ~~{{x}}~~ y")] == [("go", "normal", 0), ("down", "inserted", 2), ("x", "deleted", 0), ("y", "normal", 0)]
    assert al.markup("a ~~b c")[-1]["kind"] == "deleted"
    out = al.with_markup(spark.createDataFrame([("[a]",), (None,)], "t string"), "t").collect()
    assert out[0]["markup"][0]["kinds"] == ["inserted"] and out[1]["markup"] == []


def test_grid_matches_as_tables_do():
    random.seed(8)
    for _ in range(200):
        words = ["".join(random.choice("abcd") for _ in range(random.randint(1, 8))) for _ in range(8)]
        window, verse = ([random.choice(words) for _ in range(random.randint(a, 80))] for a in (0, 1))
        match = al.Matcher({words[0]: words[1]})
        grid = al.Grid([("b", verse)], match)
        grid.learn(window)
        assert grid.earliest(window, 0) == al.earliest(window, verse, match)


def test_walk_compares_no_letters_twice(monkeypatch):
    """A word is compared with the vocabulary once, not with each verse that the walk passes."""
    pairs = []
    plain = al.kernels.edit_pairs
    monkeypatch.setattr(al.kernels, "edit_pairs", lambda x, y, i, j: pairs.append(len(i)) or plain(x, y, i, j))
    verses = [("b", ["alpha", "bravo", "charlie", "deltas"])] * 50
    al.walk(["alphe", "bravi", "charly", "delto"] * 60, [0] * 240, {}, verses)
    assert 0 < sum(pairs) <= 16
