"""An alignment from raw pages of JSON to written verses."""

import json
import random


from textloom.functions import text as T
from textloom.operators import alignment, chain
from textloom.sources import corpus

BOOKS = ["alma", "helaman"]
RULES = ((r"^the book of alma\b", "alma"), (r"^the book of helaman\b", "helaman"))


def made(tmp_path):
    """A canon of two books with a title verse each, an edition that prints them in lines of seven words, and fragments."""
    random.seed(21)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(5, 9)))
    canon = {}
    for book in BOOKS:
        for chapter in (1, 2):
            verses = [(v, " ".join(word() for _ in range(random.randint(9, 16)))) for v in range(1, 7)]
            canon[book, chapter] = ([(0, f"THE BOOK OF {book.upper()}")] if chapter == 1 else []) + verses
            rows = [{"book": book, "chapter": chapter, "verse": v, "text": t, "source": "c"} for v, t in canon[book, chapter]]
            (tmp_path / "canon" / "2013" / book).mkdir(parents=True, exist_ok=True)
            (tmp_path / "canon" / "2013" / book / f"{chapter}.json").write_text(json.dumps(rows))
    lines = []
    for (book, chapter), verses in canon.items():
        if chapter == 1:
            lines.append(f"THE BOOK OF {book.upper()}")
        else:
            lines.append(f"CHAPTER {chapter}.")
        words = " ".join(t for v, t in verses if v).split()
        lines += [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    fragment = " ".join(t for v, t in canon["alma", 2][1:3]).split() + " ".join(t for v, t in canon["helaman", 2][3:]).split()
    pages = {"edition": lines, "pieces": [" ".join(fragment[i : i + 6]) for i in range(0, len(fragment), 6)]}
    for version, text in pages.items():
        (tmp_path / "raw" / version).mkdir(parents=True)
        for page in range(0, len(text), 10):
            rows = [{"text": t, "markdown": t, "chapter": page // 10 + 1, "verse": n, "source": f"{version}/{page}"} for n, t in enumerate(text[page : page + 10], 1)]
            (tmp_path / "raw" / version / f"{page // 10 + 1}.json").write_text(json.dumps(rows))
    return canon, pages


def test_corpus_is_aligned_and_written(spark, tmp_path):
    canon, pages = made(tmp_path)
    edition = chain.Edition(is_heading=lambda c: T.is_chapter_heading(c, BOOKS), book_rules=RULES, capital_titles=True)
    editions = {"edition": edition, "pieces": chain.Edition(fragmentary=True)}
    found = chain.align_corpus(spark, f"{tmp_path}/raw", f"{tmp_path}/canon", f"{tmp_path}/out", BOOKS, "2013", editions)
    out = {(r["version"], r["book"], r["chapter"], r["verse"]): r["lines"] for r in found.collect()}
    for (book, chapter), verses in canon.items():
        for v, text in verses:
            if v:
                assert "".join(x["text"] for x in out["edition", book, chapter, v]).replace("CHAPTER 2. ", "") == text
    covered = {k[1:] for k in out if k[0] == "pieces"}
    assert covered == {("alma", 2, 2), ("alma", 2, 3), ("helaman", 2, 4), ("helaman", 2, 5), ("helaman", 2, 6)}
    text = {k: "".join(x["text"] for x in out["pieces", *k]) for k in covered}
    assert all(text[k] == dict(canon[k[:2]])[k[2]] for k in covered if k not in {("alma", 2, 3), ("helaman", 2, 4)})  # but where the fragments meet
    assert " ".join(text[k] for k in sorted(covered)).split() == [w for k in sorted(covered) for w in dict(canon[k[:2]])[k[2]].split()]
    written = spark.read.json(f"{tmp_path}/out")
    assert written.count() == len(out) and set(written.columns) >= {"version", "book", "chapter", "verse", "lines"}


def test_overrides_and_insertions_by_name(spark, tmp_path):
    canon, _ = made(tmp_path)
    raw = corpus.raw_lines(spark, f"{tmp_path}/raw").where("version = 'pieces'")
    verses = corpus.verses(spark, f"{tmp_path}/canon")
    overrides = spark.createDataFrame([(1, 1, 1, None, None, "alma", 1, 1)], "idx long, page int, line int, low int, high int, book string, chapter int, verse int")
    insertions = spark.createDataFrame([(1, "added", None, "alma", 2, 2)], "idx long, text string, markdown string, book string, chapter int, verse int")
    insertions = insertions.selectExpr("*", *(f"cast(null as int) as {c}" for c in ("before_page", "before_line", "after_page", "after_line", "after_word")))
    edition = chain.Edition(fragmentary=True)
    out = {(r["book"], r["chapter"], r["verse"]): r for r in chain.aligned(raw, verses, BOOKS, edition, overrides, insertions).collect()}
    assert [x["id"] for x in out["alma", 1, 1]["lines"]] == ["1:1"]
    assert [x["id"] for x in out["alma", 2, 2]["lines"]][-1] == "ins:alma-2-2" and out["alma", 2, 2]["warnings"] == []


def test_canon_order(spark):
    rows = [("b", 2, 1, 1, "z"), ("b", 10, 1, 1, "y"), ("a", 1, 1, 1, "x"), ("a", 1, 2, 2, "..."), ("c", 1, 1, 1, "w"), ("a", 1, 3, 3, None)]
    out = chain.canon_of(spark.createDataFrame(rows, "book string, chapter int, pos int, verse int, text string"), ["b", "a"])
    assert [(r["ord"], r["text"]) for r in out.orderBy("ord").collect()] == [(0, "z"), (1, "y"), (2, "x")]


def test_walked_versions_are_those_of_the_plain_walk(spark):
    """The whole chain over conversations gives each word the verse that the walk gives it alone."""
    sf = "/root/testdata/sf0.001"
    from textloom.plans import chain as plans

    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    canon = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    norm = lambda w: "".join(c for c in w.lower().replace("&", "and") if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    verses = [("passages", [n for w in t.split() if (n := norm(w))]) for _, t in canon]
    got = {(r["version"], r["verse"]): r["n_lines"] for r in plans.aligned_verses(spark, sf).collect()}
    want = {}
    for conv in {r["conv_id"] for r in turns}:
        own = sorted(((r["turn"], r["role"], r["text"]) for r in turns if r["conv_id"] == conv))
        words = [(norm(w), k) for k, (_, _, t) in enumerate(own) for w in (t or "").split() if norm(w)]
        found = alignment.walk([w for w, _ in words], [k for _, k in words], {}, verses)
        for (_, k), v in zip(words, found):
            want.setdefault((str(conv), canon[v][0]), set()).add(k)
    assert got == {k: len(v) for k, v in want.items()}


def test_scaffolded_documents_are_the_plain_ones(spark):
    import re

    from test_scaffold import plain
    from textloom.plans import chain as plans

    sf = "/root/testdata/sf0.001"
    canon = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    norm = lambda w: "".join(c for c in w.lower().replace("&", "and") if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    verses = [[n for w in t.split() if (n := norm(w))] for _, t in canon]
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = [(w, k) for k, line in enumerate((r["text"] or "").split("\n")) for w in re.findall("[a-z0-9]+", line.lower())]
        for v in plain([w for w, _ in words], [k for _, k in words], verses).values() if words else ():
            key = (str(r["doc_id"]), v)
            want[key] = want.get(key, 0) + 1
    assert {(r["version"], r["verse_ord"]): r["words"] for r in plans.scaffolded_documents(spark, sf).collect()} == want
