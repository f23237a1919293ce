import random

from textloom.operators import kernels as k


def test_diff_runs_and_order():
    d = k.diff("alpha bravo charlie delta echo".split(), "alpha ZULU charlie delta YANKEE".split())
    assert k.runs([o for _, o in d]) == 2
    assert [o for _, o in d] == ["eq", "del", "ins", "eq", "eq", "del", "ins"]


def test_diff_is_shortest_and_complete():
    random.seed(1)
    for _ in range(300):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 9))] for _ in range(2))
        d = k.diff(a, b)
        assert [v for v, o in d if o != "ins"] == a and [v for v, o in d if o != "del"] == b
        assert sum(o != "eq" for _, o in d) == len(a) + len(b) - 2 * len(k.lcs_latest(a, b))


def test_kinds():
    assert [k.substitution(*p) for p in (("colour", "color"), ("lord", "word"), ("unto", "to"), ("his", ","), ("Lord", "lord"), ("&", "and"))] == ["spelling", "wordChange", "wordChange", "punctuation", "capitalization", "spelling"]
    assert [x[2] for x in k.classified(k.diff(["great", "big", "x"], ["grand", "x"]))] == ["wordChange", "omission", "wordChange", None]
    assert {x[2] for x in k.classified(k.diff(["first", "born"], ["firstborn"]))} == {"spelling"}


def test_chain_is_longest():
    assert k.increasing([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    assert k.increasing([]) == []


def test_edit_table_and_closest_pairs():
    random.seed(4)
    words = ["".join(random.choice("abcé") for _ in range(random.randint(0, 6))) for _ in range(40)]
    assert [[k.edits(a, b) for b in words] for a in words] == k.edit_table(words, words).tolist()
    for _ in range(60):
        tokens = [random.choice(words[:12]) or "a" for _ in range(random.randint(2, 30))]
        cut = random.randint(1, len(tokens) - 1)
        left, free = list(range(cut)), list(range(cut, len(tokens)))
        scored = sorted((k.edits(k.plain(tokens[i]), k.plain(tokens[j])) / (max(len(k.plain(tokens[i])), len(k.plain(tokens[j]))) or 1), i, j) for i in left for j in free)
        want, a, b = [], set(left), set(free)
        for _, i, j in scored:
            if i in a and j in b:
                want.append((i, j))
                a.discard(i)
                b.discard(j)
        assert k._closest(left, free, tokens.__getitem__) == want


def test_diff_by_its_table():
    """Deletions come first where both ways are as short, also in texts of more than 64 words."""
    random.seed(5)
    for size in (5, 40, 150):
        a, b = ([random.choice("abcd") for _ in range(random.randint(size - 4, size))] for _ in range(2))
        common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                common[i][j] = common[i - 1][j - 1] + 1 if x == y else max(common[i - 1][j], common[i][j - 1])
        out, i, j = [], len(a), len(b)
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append((a[i], "eq"))
            elif i and (not j or common[i - 1][j] > common[i][j - 1]):
                i -= 1
                out.append((a[i], "del"))
            else:
                j -= 1
                out.append((b[j], "ins"))
        assert k._middle(a, b) == out[::-1]


def test_edit_table_of_long_words():
    random.seed(6)
    words = ["".join(random.choice("abc\u05d0") for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 90) * 3]
    assert k.edit_table(words, words[:9]).tolist() == [[k.edits(a, b) for b in words[:9]] for a in words]


def test_long_runs_are_classified_by_tables():
    """Whole texts replaced: distinct words are compared once, so 3,000 words on each side need no 9 million comparisons."""
    words = [f"w{i % 40}x" for i in range(3000)]
    tokens = [(w, "del") for w in words] + [(w + "yz", "ins") for w in words]
    calls, plain = [], k.edits
    k.edits = lambda a, b: calls.append(0) or plain(a, b)
    try:
        kinds = [x[2] for x in k.classified(tokens)]
    finally:
        k.edits = plain
    assert set(kinds) <= {"spelling", "wordChange"} and len(calls) <= 3000
