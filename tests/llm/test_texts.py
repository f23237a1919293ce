import base64
import hashlib
import html
import random
import re
import string
import struct
import time
import zlib

import duckdb
import public_tokenizers
import pyarrow.dataset as ds
import pytest
import tiktoken
import tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from textloom.llm import htmltext, quality, secrets, urlfilter

SF = "/root/testdata/sf0.01"


def brute_base(text):
    out = []
    for kind, pattern, keep in (
        (0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        (1, "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (2, "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if keep(m)]
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.default_samples(spark))


def test_secrets(spark, model):
    random.seed(5)
    alphabet = string.ascii_letters + string.digits
    drawn = ["".join(random.choice(alphabet) for _ in range(36)) for _ in range(200)]
    plain = ["/articles/2024-01-15/some-long-title-about-nothing-1234", "user_account_settings_page_2", "thisIsAVeryLongIdentifierName42", "CONFIG_MAX_CONNECTIONS_PER_HOST_64"]
    rows = [r["text"] for r in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()]
    rows += ["", None, 'é😀 token = "abcdef" AKIA' + "A" * 16 + " password=token = x123456 secret:short", "a" * 30 + "1" * 3, *(f"key {x} end" for x in drawn), *(f"see {x} there" for x in plain), "api_key='" + "z" * 9 + "' x " * 50]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("secrets", secrets.F.lit("x"))
    found = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in secrets.find(df, model).collect()}
    for i, t in enumerate(rows):
        assert [s for s in found[i] if s[1] < 3] == brute_base(t or "")
    by_text = {t: found[i] for i, t in enumerate(rows)}
    assert sum(bool(by_text[f"key {x} end"]) for x in drawn) >= 195
    assert not any(by_text[f"see {x} there"] for x in plain)
    out = secrets.find(df, model).select(secrets.redacted(secrets.F.col("text"), secrets.F.col("secrets"))).collect()
    assert not any("AKIAA" in r[0] for r in out)
    assert secrets.find(df.limit(0), model).count() == 0


def test_url_rules(spark):
    rows = [
        (1, "http://WWW.Example.com/en/700?x#y"), (2, "https://a.com/en/1"), (3, "ftp://com/en/"), (4, None), (5, "no scheme"), (6, "http://x.net/de/81"),
        (7, "http://b.example.net/de/81"), (8, "http://x.org/es"), (9, "http://ads.site.info/p"), (10, "http://roads.site.info/p"), (11, "http://notexample.com/fr/"), (12, "http://x.com?/en/"),
    ]
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out == {
        1: ("www.example.com", "/en/700", "example.com/en/7", "allow"), 2: ("a.com", "/en/1", "com/en/", "block"), 3: ("com", "/en/", "com/en/", "block"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("x.net", "/de/81", "net/de/", "block"), 7: ("b.example.net", "/de/81", "example.net/de/8", "block"), 8: ("x.org", "/es", None, "allow"),
        9: ("ads.site.info", "/p", None, "block"), 10: ("roads.site.info", "/p", None, "allow"), 11: ("notexample.com", "/fr/", None, "allow"), 12: ("x.com", "", None, "allow"),
    }


def test_verdict_of_contract(spark):
    """Each site rule gives the verdict that the contract has for it, on hosts and subdomains."""
    verdicts = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [f"http://{sub}{rule}{end}" for rule in verdicts for sub in ("", "www.") for end in ("", "1?x")]
    out = urlfilter.judge(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert len(out) == len(urls) and {r["rule"] for r in out} == set(verdicts)
    assert all(r["verdict"] == verdicts[r["rule"]] for r in out)


def test_html():
    pages = ds.dataset(f"{SF}/pages.parquet").to_table().to_pylist()
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert htmltext.main_text(p["html"]) == "\n\n".join(x for x in blocks if x)
    page = """<body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="layout has-sidebar"><main><article><h1>T &amp; x</h1><p>Para one
 text <b>bold</b>.<p>Para two &lt;i&gt;<br>line<div class="ad-box">buy</div><ul><li>a<li>b</ul><div id="comments"><p>nice post</div></article></main>
 <aside>side</aside></div><div class="cookie-notice">cookies</div><form>go</form><footer>f</footer><script>1<2</script>"""
    assert htmltext.main_text(page) == "T & x\n\nPara one text bold.\n\nPara two <i> line\n\na\n\nb"
    for odd in ("", None, "<<<>>><p", "<article>" + "<div>" * 5000 + "x", "<!-- open", "<script>never closed"):
        htmltext.main_text(odd)


def test_html_column(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>a", "y")], "page_id long, html string, text string")
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(df).orderBy("page_id").collect()] == [(1, "", 0), (2, "a", 1)]


def test_quality_on_held_out_rows(spark):
    scored = entry.queries()["op4_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in scored)
    assert right / len(scored) >= 0.93
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_quality_without_enough_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none).prior == 0.5
    one = quality.train(docs, spark.createDataFrame([(3, 1), (3, 1), (None, 0), (2, 7)], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, one).collect()} == {1.0}


def test_round_trip_query(spark):
    docs = {r["doc_id"]: r["text"] for r in ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table().to_pylist()}
    for r in entry.queries()["op3_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.stored(out)
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] == seen[4] > 0.7 * seen[0]
    assert not docs.where(docs.text.rlike("AKIA[A-Z0-9]{16}")).count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", ["op6_url_filter", "op10_embedding_dups"])
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))


def test_html_without_marking_tags():
    for p in ds.dataset(f"{SF}/pages.parquet").to_table().to_pylist():
        plain = p["html"].replace("article>", "div>").replace("h1>", "p>")
        assert htmltext.main_text(plain) == htmltext.main_text(p["html"])


def test_ids_of_the_query_are_those_of_the_library(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table().to_pylist()}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in entry.queries()["op3_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_pieces_are_those_of_the_library(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table().to_pylist()}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    rows = entry.queries()["op2_packing"](spark, "/root/testdata/sf0.001").collect()
    at, ids = {}, {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in docs.items()}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["doc_id"]][r["start"] : at[r["doc_id"]]]))
    assert at == {k: len(v) for k, v in ids.items()}
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 4096 for s, n in used.items() if s != max(used)) and max(used.values()) <= 4096


def test_secrets_in_long_texts(spark, model):
    random.seed(8)
    drawn = ["".join(random.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(3000)]
    text = " ".join(drawn) + " " + "".join(random.choice(string.ascii_letters + string.digits) for _ in range(200_000))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "y")], "doc_id long, text string, kind string")
    for r in secrets.find(df, model).collect():
        spans = [tuple(s) for s in r["secrets"]]
        assert [s for s in spans if s[1] < 3] == brute_base(text) and len(spans) > 2900 and spans[-1][2] == len(text)


def test_density_finds_the_article_without_lists(monkeypatch):
    """Menus, headers, footers, asides and forms as plain <div> without classes: nearly all articles are still found alone."""
    monkeypatch.setattr(htmltext, "DROPPED", htmltext.DROPPED - {"nav", "header", "footer", "aside", "form"})
    found, n = 0, 0
    for p in ds.dataset(f"{SF}/pages.parquet").to_table().to_pylist():
        bare = re.sub(r"<(/?)(?:nav|header|footer|aside|form|article)\b", r"<\1div", re.sub(r' (?:class|id|role)="[^"]*"', "", p["html"]))
        body = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        n, found = n + 1, found + (htmltext.main_text(bare) == "\n\n".join(x for x in blocks if x))
    assert found >= 0.97 * n


def test_comments_are_no_core():
    comments = "".join(f"<div class='comment'><p>{'a long remark of a reader ' * 9}</p></div>" for _ in range(40))
    page = f"<body><div><h2>Title of it</h2><p>{'text ' * 40}</p><p>{'more ' * 30}</p></div><section id=comments>{comments}</section></body>"
    assert htmltext.main_text(page) == f"Title of it\n\n{('text ' * 40).strip()}\n\n{('more ' * 30).strip()}"
    two = f"<body><div>{'<p>first part of it all</p>' * 9}</div><ul><li><a href=x>link one</a></li></ul><div>{'<p>second part of it all</p>' * 9}</div></body>"
    assert htmltext.main_text(two).count("part of it") == 18 and "link" not in htmltext.main_text(two)


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<!x ", "<a \"'>", "<ul><li>", "<p>x", "<!--", "<div></b>", "<h1>x", "</title ", "<title>x</title "])
def test_broken_pages_take_time_in_proportion(piece):
    page = "<b><article>" + piece * (1_000_000 // len(piece))
    began = time.time()
    htmltext.main_text(page)
    assert time.time() - began < 30


def test_html_of_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", 5)] * 3, "page_id long, html string, n_chars int")
    assert [(r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()] == [("a", 1)] * 3
    assert htmltext.extract(df.limit(0)).count() == 0


def test_quality_takes_whole_rows_within_its_bounds(spark):
    """What marks a label may lie anywhere in a long text; a bound leaves out rows, never parts of one."""
    random.seed(6)
    noise = lambda n: "".join(random.choices("abcdefghij ", k=n))
    rows = [(i, noise(9_000) + ("good sign of quality " if i % 2 else "cheap buy now click ") * 40 + noise(9_000), i % 2) for i in range(24)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, None), (99, None, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (99, 1), (3, 5), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert b"good sign of quality" in model.good and b"cheap buy now" in model.bad
    out = quality.score(docs, model).where("doc_id < 99").collect()
    assert sum((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in out) >= 20
    few = quality.train(docs, labels, most=1)
    assert few.prior == 0.5
    assert quality.train(docs.limit(0), labels).prior == 0.5
    assert quality.score(docs.limit(0), model).count() == 0 and {r["score"] for r in quality.score(docs.where("text is null"), model).collect()} == {model.prior}
