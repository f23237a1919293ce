import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow.dataset as ds

from textloom.llm import components, embeddups, fingerprints, ngramjoin, suffixdedup, suffixsort

import numpy as np
import pytest


def documents(most=1000):
    t = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["doc_id", "text"]).slice(0, most)
    return [(r["doc_id"], r["text"]) for r in t.to_pylist()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where, shared = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for v in where.values():
        shared.update((v[j], v[i]) for i in range(len(v)) for j in range(i))
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows))


def near_copies():
    random.seed(2)
    base = [str(random.randint(0, 99999)) for _ in range(120)]
    return [(i, " ".join(random.choice(base) if random.random() < 0.02 else w for w in base)) for i in range(200)]


EDGES = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A  b"), (6, "a b c d e f"), (6, "a b c d e f"), (0, "A B C D E F")]


@pytest.mark.parametrize(
    "rows, block, salted",
    [(documents(), 4096, 16), (near_copies(), 64, 16), (near_copies(), 4096, 16), (near_copies(), 32, 3), (documents(300), 16, 2), (EDGES, 4096, 16), ([], 4096, 16)],
    ids=["documents", "small blocks", "near copies", "salted", "salted documents", "edges", "empty"],
)
def test_ngram_join_is_exact(spark, rows, block, salted):
    out = ngramjoin.similar(frame(spark, rows), block=block, salted=salted).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, out.collect())) == brute_components(rows)


def test_ngram_join_of_long_texts_nulls_and_other_columns(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[3000:])), (3, " ".join(words[20_000:])), (None, " ".join(words[:-2000])), (4, "x y"), (4, "x y"), (None, "x y"), (5, None)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, node string, grp int")
    out = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngramjoin.similar(df).collect())
    assert out == [(0, 1), (0, 4), (1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 5)]
    kept = ngramjoin.one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5]


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (3, ""), (4, "q w e r t y"), (4, "z x c v b n"), (None, "u"), (None, "u"), (5, "z x c v b n")]
    kept = Counter((r["doc_id"], r["text"] or "") for r in ngramjoin.one_of_each(frame(spark, rows)).collect())
    assert kept == {(1, "a b c d e f"): 1, (3, ""): 1, (4, "q w e r t y"): 1, (4, "z x c v b n"): 1, (None, "u"): 2}


def brute_removal(rows, n=400):
    data, count, out = [(t or "").encode() for _, t in rows], Counter(), []
    for b in data:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    for (k, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((k, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages():
    random.seed(2)
    words = lambda n: " ".join(random.choice(["é", "ab", "xyz", "ß"]) + str(random.randint(0, 9999)) for _ in range(n))
    shared = words(120)
    hot = [(i, words(random.randint(0, 40)) + shared + words(30)) for i in range(60)]
    edges = [(1, "a" * 2000), (2, None), (3, ""), (4, "x" * 399), (5, words(200)), (5, shared), (6, shared[:450] + "q"), (7, shared), (7, shared), (8, "ab" * 900)]
    return hot, edges


@pytest.mark.parametrize("rows, hot", [(documents(400), 4096), (passages()[0], 4096), (passages()[0], 8), (passages()[1], 4096), ([], 4096)], ids=["documents", "passage", "counted", "edges", "empty"])
def test_suffix_dedup_is_exact(spark, rows, hot):
    assert sorted(map(tuple, suffixdedup.summary(frame(spark, rows), hot=hot).collect())) == brute_removal(rows)


@pytest.mark.parametrize("hot", [4096, 8])
def test_suffix_dedup_of_null_ids_is_exact(spark, hot):
    many, edges = passages()
    rows = [(None if i % 3 == 0 else i, t) for i, t in many] + [(None, edges[5][1]), (None, edges[5][1]), (None, None), (None, "x" * 399)]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    plain = brute_removal([(-1 if i is None else i, t) for i, t in rows])
    got = sorted(map(tuple, suffixdedup.summary(frame(spark, rows), hot=hot).collect()), key=order)
    assert got == sorted(((None if r[0] == -1 else r[0], *r[1:]) for r in plain), key=order)
    left = {r["text"] for r in suffixdedup.remove(frame(spark, rows), hot=hot).where("doc_id IS NULL").collect()}
    assert edges[5][1] not in left and "x" * 399 in left


def test_removed_passages_leave_columns_alone(spark):
    rows = [(i, t, "th", i) for i, t in passages()[0][:9]]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, spans long")
    out = suffixdedup.remove(df)
    assert out.columns == df.columns and out.count() == 9
    assert all(len(r["text"]) < len(t) for r, (_, t, _, _) in zip(out.orderBy("doc_id").collect(), rows))


def test_pipeline_removes_passages_of_51_words(spark):
    random.seed(6)
    words = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, short, wide = words(51), words(40), words(1) * 90
    rows = [(i, words(60) + "\n" + (long, short, wide, "")[i % 4] + "\n" + words(60)) for i in range(12)] + [(None, words(9) + " " + long), (20, None), (21, "")]
    n, count, want = corpus_pipeline.LENGTH, Counter(), []
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    for (k, t), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        for m in re.finditer(b"\1+", bytes(gone)):
            if m.end() - m.start() < 400 and len(b[m.start() : m.end()].split()) < 51:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        want.append((str(k), None if t is None else bytes(x for x, g in zip(b, gone) if not g).decode()))
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_chars int")
    out = corpus_pipeline.remove_passages(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out) == sorted((k, t or "") for k, t in want)
    left = " ".join(r["text"] or "" for r in out)
    assert long not in left and short in left and wide not in left


def test_suffix_arrays_and_prefixes():
    random.seed(0)
    for _ in range(600):
        n, k = random.randint(1, 60), random.choice([1, 2, 3, 250])
        t = np.array([random.randrange(k) for _ in range(n)], np.uint8)
        b = t.tobytes()
        order = suffixsort.suffix_array(t)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        shared = suffixsort.common_prefixes(t, order)
        for i, j in zip(order[1:], order[:-1]):
            x = 0
            while max(i, j) + x < n and b[i + x] == b[j + x]:
                x += 1
            assert shared[i] == x


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, few):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    out = {r["node"]: r["component"] for r in components.components(edges, few=few).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_embeddings(spark):
    random.seed(4)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 16))
    rows = np.concatenate([base, base[:200] + rng.normal(size=(200, 16)) * 0.12, np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.01])
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 3, [float("inf")] * 16]
    data = [(i, x.tolist(), 0) for i, x in enumerate(rows)] + [(5000 + i, x, 0) for i, x in enumerate(odd)] + [(None, rows[1].tolist(), 1)]
    out = embeddups.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links int"), cell=100, block=64).collect()
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    hit = unit @ np.concatenate([unit, unit[1:2]]).T >= 0.9
    want = hit.sum(axis=1) - 1
    got = {r["vec_id"]: r for r in out}
    assert len(out) == len(data)
    recall = sum(got[i]["n_links"] for i in range(len(rows))) / want.sum()
    assert 0.99 <= recall <= 1.0
    assert all(got[i]["n_links"] <= want[i] for i in range(len(rows)))
    assert all(got[5000 + i]["n_links"] == 0 and got[5000 + i]["component_id"] == 5000 + i and got[5000 + i]["kept"] for i in range(len(odd)))
    assert all(got[900 + i]["component_id"] == 0 for i in range(30))
    assert embeddups.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_several_lengths(spark):
    """Each length is searched, and no vector links with one of another length."""
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=n) for n in (2, 3, 8) for _ in range(60)] + [np.array([1.0, 0.0]), np.array([1.0, 0.0, 0.0]), np.array([2.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    unit = [v / np.linalg.norm(v) for v in vectors]
    want = [sum(len(a) == len(b) and i != j and a @ b >= 0.9 for j, b in enumerate(unit)) for i, a in enumerate(unit)]
    got = {r["vec_id"]: r["n_links"] for r in embeddups.near_duplicates(df, cell=10, block=16, probes=None).collect()}
    assert [got[i] for i in range(len(vectors))] == want and want[-1] >= 1


def test_embeddings_link_through_null_ids(spark):
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    data = [(None, at(0)), (7, at(1)), (3, at(2)), (9, at(25)), (None, at(60)), (8, at(80)), (6, at(40)), (None, at(120)), (4, at(180)), (4, at(240)), (5, at(242))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").coalesce(1)
    got = {(r["vec_id"], r["component_id"], r["kept"]) for r in embeddups.near_duplicates(df).collect()}
    assert got == {(None, None, None), (4, 4, True), (5, 4, False)} | {(i, 3, i == 3) for i in (3, 6, 7, 8, 9)}


@pytest.mark.parametrize("block", [4096, 64])
def test_embeddings_of_low_dimension_miss_nothing(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1000, 6))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    rows = np.concatenate([base, 0.91 * base + np.sqrt(1 - 0.91**2) * aside]) @ np.linalg.qr(rng.normal(size=(64, 6)))[0].T
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    want = (rows @ rows.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddups.near_duplicates(df, cell=10, block=block, probes=None).collect()}
    assert [got[i] for i in range(len(rows))] == want.tolist()


def test_fingerprints(spark):
    rows = [(1, "a b c d e f g"), (1, "a b"), (2, None), (None, "x y z"), (5, ""), (None, "x y z"), (1, "a b")] + documents(300)
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (k, t) in enumerate(ordered):
        following, cut = ordered[(i + 1) % len(ordered)][1], len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        own, other = (fingerprints.text_of(x) for x in fingerprints.sketch([t, edited]))
        want.append(str((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other)))
    out = fingerprints.with_edits(frame(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"])) for r in out) == sorted(want)
    assert fingerprints.with_edits(frame(spark, [])).count() == 0
    assert fingerprints.with_edits(frame(spark, [(3, "one two")])).first()["near_next"] == 1.0


def test_sketches_estimate_and_merge():
    words = [f"w{i}" for i in range(3000)]
    a, b, both = fingerprints.sketch([" ".join(words[:2000]), " ".join(words[1000:]), " ".join(words)])
    assert abs(fingerprints.resemblance(a, b) - 1 / 3) < 0.13
    assert abs(fingerprints.containment(a, b) - 1 / 2) < 0.2
    assert abs(fingerprints.distinct(a) / 1996 - 1) < 0.3
    assert (fingerprints.merge(a, b) == both).all()
    few = fingerprints.sketch(["a b c d e f", "a b c d e g"])
    assert fingerprints.distinct(few[0]) == 2 and abs(fingerprints.resemblance(*few) - 1 / 3) < 1e-9


def test_words_are_hashed_together():
    """Distinct words are hashed by array operations, not one call each (op9, F1); places, lengths and slices count."""
    import numpy as np
    import pyarrow as pa
    from textloom.llm import words as w

    made = pa.array(sorted({b"", b"a", b"b", b"ab", b"ba", b"aab", b"aba", *(c * k for c in (b"x", b"\xc3\xa9") for k in (3, 31, 32, 63, 64, 65, 200))}), pa.binary())
    h = w.word_hashes(made)
    assert len(np.unique(h)) == len(made) and (w.word_hashes(made.slice(3, 5)) == h[3:8]).all() and len(w.word_hashes(made.slice(0, 0))) == 0
    texts = pa.array(["a b c d e f", None, " ", "a b", "c", "B  a\nb c d e", "a b c d e"], pa.string())
    values, at = w.shingles(*w.data_of(texts), 5, w.word_hashes)
    assert at.tolist() == [0, 2, 2, 2, 3, 4, 6, 7] and values[0] == values[5] == values[6] and len(np.unique(values)) == 5


def test_levels_tell_shared_shingles_from_others_of_their_buckets(spark):
    """A shingle of 60 documents stands out where each bucket holds some 70 others (op9, disk at 30 GB)."""
    random.seed(4)
    passage = "here is one passage that sixty of the documents hold"
    rows = [(i, " ".join(str(random.randrange(10**9)) for _ in range(110)) + (" " + passage) * (i < 60)) for i in range(700)]
    levels = ngramjoin.shingle_levels(frame(spark, rows), "text", 5, bits=10)
    import pyarrow as pa

    shared = ngramjoin.sets_of(pa.chunked_array([[passage]]), 5)[0]
    assert len(levels) == 1024 and np.median(levels[(shared >> np.uint64(54)).astype(np.int64)]) > np.percentile(levels, 95)


def test_ngram_join_in_rounds(spark):
    """The shingles are dealt to rounds, none twice and none to no round, and the links stay (op9, disk at 30 GB)."""
    rows = near_copies() + [(1000 + i, t) for i, t in documents(200)]
    levels = ngramjoin.shingle_levels(frame(spark, rows), "text", 5)
    known = ngramjoin.stored(ngramjoin._documents(frame(spark, rows), "doc_id", "text", levels, 5, 80))
    every = Counter(map(tuple, ngramjoin._tokens(known, levels, 16).collect()))
    shares = [Counter(map(tuple, ngramjoin._tokens(known, levels, 16, k, 4).collect())) for k in range(4)]
    assert sum(shares, Counter()) == every and max(x.total() for x in shares) < 0.3 * every.total()
    out = ngramjoin.similar(frame(spark, rows), block=32, salted=3, round_bytes=1).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, out.collect())) == brute_components(rows)
