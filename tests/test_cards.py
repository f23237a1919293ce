"""Cards and rows of a comparison."""

import random

from pyspark.sql import functions as F

from textloom.operators import cards, compare


def test_previews(spark):
    rows = [(1, [(1, "one"), (2, "two"), (5, "five")], [2, 5, 9]), (2, [(1, "x" * 450), (2, "y")], [1, 2]), (3, [(1, "x" * 449), (2, "y")], [1, 2]), (4, [], [1]), (5, [(1, ""), (2, "b")], [1, 2]), (6, [(1, "a")], [])]
    df = spark.createDataFrame(rows, "i int, v array<struct<verse:int,text:string>>, m array<int>").orderBy("i")
    got = [r[0] for r in df.select(cards.preview(F.col("v"), F.col("m"))).collect()]
    assert got == ["two 5 five", "x" * 450 + "…", "x" * 449 + " " + "…", "", "b", ""]


def plain_card(tokens, left, number, numbers):
    """The rules of a card's side, one after another."""
    own = [(v, op) for v, op in tokens if op != ("ins" if left else "del")]
    marks = {next((i for i, (v, _) in enumerate(own) if v == str(n)), None) for n in numbers} - {None}
    segments = []
    for i, (v, op) in enumerate(own):
        before = own[i - 1][0] if i else ""
        space = "" if not i else " " if i in marks else "" if set("<([") & set(before) or before.endswith("-") or not any(c.isascii() and c.isalpha() or c in "&()<" for c in v) else " "
        segments.append([space, v, i not in marks and op != "eq", i in marks])
    lines, now, size = [], [], 0
    for space, v, hit, mark in segments:
        most = (40 if number > 0 else 43) if not lines else 43
        if size == 0 or size + len(space) + len(v) <= most:
            now.append([space, v, hit, mark])
            size += len(space) + len(v)
        else:
            lines.append(now)
            now, size = [["", v, hit, mark]], len(v)
    return (lines + [now] if now else lines)[:8]


def test_lines_of_a_card(spark):
    random.seed(1)
    words = ["and", "(it", "came)", "-", "to-", "7", "12", "pass,", "a" * 50, "&", "é", "x"]
    made = [([(random.choice(words), random.choice(["eq", "eq", "ins", "del"])) for _ in range(random.randint(0, 120))], random.randint(0, 2), [7, 12]) for _ in range(40)]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "i int, tokens array<struct<value:string,op:string>>, number int, numbers array<int>").orderBy("i")
    for absent, left in (("ins", True), ("del", False)):
        lines = cards.wrapped(cards.segments(F.col("tokens"), absent, F.col("numbers")), F.col("number") > 0)
        got = [[[[s["space"], s["text"], s["highlighted"], s["marker"]] for s in line] for line in r[0]] for r in df.select(lines).collect()]
        assert got == [plain_card(t, left, n, m) for t, n, m in made]


def test_cards_of_verses(spark):
    pairs = spark.createDataFrame([("and it's <came> 2 to pass", "and it came 2 to pass", 1, [2]), ("same", "same", 0, [])], "left_text string, right_text string, number int, numbers array<int>")
    out = {r["number"]: (r["left_block"], r["right_block"]) for r in cards.verse_cards(pairs).collect()}
    left, right = out[1]
    assert '>[1]</tspan><tspan y="240" dx="6">and it</tspan>' in left and 'dx="5">[2]</tspan>' in left and "&#39;" in left and "&lt;" in left
    assert right.count(cards.COLOUR) == 0 or "came" in right
    assert out[0][0].replace('x="52"', 'x="624"') == out[0][1]


def test_addresses_of_cards(spark):
    rows = [("alma", "3", "pm", "2013", "2-3"), ("zz", "3", "pm", "2013", "2"), ("alma", "3x", "pm", "2013", None), ("alma", "-3", "pm", "2013", "1"), ("alma", "0", "pm", "xx", "1"), (None, None, None, None, None)]
    df = cards.sanitised(spark.createDataFrame(rows, "book string, chapter string, v1 string, v2 string, mark string"), ["alma"], ["pm", "2013"])
    got = [(r["book"], r["chapter"], r["v1"], r["v2"], r["marks"]) for r in df.collect()]
    assert got == [("alma", "3", "pm", "2013", [2, 3]), ("", "3", "pm", "2013", None), ("alma", "3", "pm", "2013", None), ("alma", "", "pm", "2013", None), ("alma", "", "pm", "", None), ("", "", "", "", None)]


def test_rows_of_equal_and_unequal_chapters(spark):
    same = compare.row_spans(["eq"] * 4, [2, 2], [2, 2])
    assert same == [("left", 1, 1, 1), ("right", 1, 1, 1), ("left", 2, 2, 2), ("right", 2, 2, 2)]
    # the right side has both verses in one: it ends with the left side's second verse
    assert compare.row_spans(["eq"] * 4, [2, 2], [4]) == [("left", 1, 1, 1), ("left", 2, 2, 2), ("right", 1, 1, 1)]
    assert compare.row_spans(["eq", "ins", "ins", "eq"], [2], [2, 2]) == [("right", 1, 1, 1), ("left", 1, 1, 1), ("right", 2, 2, 2)]
    assert compare.row_spans([], [], []) == [] and compare.row_spans(["del"] * 2, [1, 1], [], 4) == [("left", 1, 5, 5), ("left", 2, 6, 6)]
    df = spark.createDataFrame([(1, ["a b", "c"], ["a", "b", "c"]), (2, None, ["x"])], "k int, left array<string>, right array<string>")
    out = {r["k"]: [tuple(x) for x in r["rows"]] for r in compare.chapter_rows(df).collect()}
    assert out[1] == [("right", 1, 1, 1), ("left", 1, 1, 1), ("right", 2, 2, 2), ("left", 2, 2, 2), ("right", 3, 3, 3)]
    assert out[2] == [("right", 1, 1, 1)]
    random.seed(2)
    for _ in range(50):
        sizes = [[random.randint(1, 4) for _ in range(random.randint(1, 6))] for _ in range(2)]
        ops, left = [], [sum(s) for s in sizes]
        while sum(left):
            op = random.choice(["eq", "del", "ins"])
            need = {"eq": (1, 1), "del": (1, 0), "ins": (0, 1)}[op]
            if left[0] >= need[0] and left[1] >= need[1]:
                ops.append(op)
                left = [left[0] - need[0], left[1] - need[1]]
        rows = compare.row_spans(ops, *sizes)
        for k, side in enumerate(("left", "right")):
            own = [r for r in rows if r[0] == side]
            assert [r[1] for r in own] == list(range(1, len(sizes[k]) + 1)) and all(a[2] < b[2] for a, b in zip(own, own[1:]))
