"""Collocations, mixing and whitening against plain Python."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import collocations, mixing, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mined(rows, least, covered=80, top=2000):
    """The contract's rules, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * around[p] < covered * a or not around[p]:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus():
    random.seed(5)
    words = ["a", "B", "çé", "the", "of", "x" * 3000, "日本", "\x1c", "it's"]
    made = ["".join(random.choice(words) + random.choice("      \t.,\n") for _ in range(random.randint(0, 60))) for _ in range(150)]
    rows = [(random.choice(["en", "fr", None, "und"]), t) for t in made]
    return rows + [("en", None), ("en", ""), (None, " . "), ("en", "a a a a a a a"), ("de", "the of " * 20_000)] + [("en", "hot phrase here")] * 60


@pytest.mark.parametrize("least", [3, 200])
def test_collocations(spark, least):
    rows = corpus()
    df = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase int").repartition(5)
    got = sorted(map(tuple, collocations.mine(df, least=least, top=25).collect()))
    assert got == mined(rows, least, top=25) and got


def test_automata_of_bounded_size(monkeypatch):
    text, patterns = " a b a b a \n b a a ", ["a", "b", "a b", "b a", "a b a", "a a", "c"]
    whole = collocations.matches(text, patterns).tolist()
    monkeypatch.setattr(collocations, "PATTERN_CHARS", 4)
    assert collocations.matches(text, patterns).tolist() == whole == [5, 3, 2, 3, 2, 1, 0]


def test_collocations_do_not_need_a_wide_sketch(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_CELLS", 64)
    monkeypatch.setattr(collocations, "SLAB", 64)  # every cell is full: all phrases are candidates
    df = spark.createDataFrame(corpus(), "lang string, text string").repartition(3)
    assert sorted(map(tuple, collocations.mine(df, least=3).collect())) == mined(corpus(), 3)
    assert collocations.mine(df.limit(0)).count() == 0


def test_numbers_beyond_64_bits(spark):
    """2,000,000 * a passes 64 bits from some 4.6 * 10^12 occurrences on; the expressions take decimals."""
    df = spark.createDataFrame([(9 * 10**18, 9 * 10**18, 9 * 10**18)], "a long, l long, r long")
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    df = df.withColumn("doubled", wide("a") * F.lit(2_000_000)).withColumn("both", wide("l") + wide("r"))
    assert df.selectExpr("doubled div both as s").first()["s"] == 1_000_000


def water(sizes, weights, total, most=2):
    """Targets by the contract's words: the excess of what is above goes to the others by weight, again and again."""
    held = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = total - sum(most * sizes[i] for i in held)
        out = [Fraction(most * sizes[i]) if i in held else rest * weights[i] / sum(weights[j] for j in free) for i in range(len(sizes))]
        above = {i for i in free if out[i] > most * sizes[i]}
        if not above:
            return out
        held |= above


def documents():
    random.seed(2)
    rows = [(i, random.choice(["src0", "src0", "src0", "b", "é", "Z", None]), "w " * int(random.lognormvariate(4, 1))) for i in range(1500)]
    rows += [(None, "src0", "one two"), (None, "src0", "one two"), (7, "b", None), (8, "tiny", "x"), (9, "void", ""), (9, "void", None)]
    return rows + [(5000 + i, "copies", "same words here") for i in range(900)]


def test_mixing(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, size string").repartition(7)
    out = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((i, s, len((t or "").split())) for i, s, t in rows)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    wanted = dict(zip(names, water([sizes[s] for s in names], [[3, 1, 2][i % 3] for i in range(len(names))], Fraction(3 * sum(sizes.values()), 2))))
    taken, largest = Counter(), Counter()
    for r in out:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(wanted[r["source"]]), rel=1e-12)
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - wanted[s]) <= largest[s]
    order = lambda rows: sorted(map(str, rows))
    assert order(mixing.mix(df.repartition(2)).collect()) == order(out)
    assert order(mixing.mix(df, seed=14).collect()) != order(out)


def test_mixing_of_little(spark):
    df = spark.createDataFrame([(1, None, "a b"), (2, None, None)], "doc_id long, source string, text string")
    assert {(r["doc_id"], r["target"]) for r in mixing.mix(df).collect()} == {(1, 3.0), (2, 3.0)}
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r["target"] for r in mixing.mix(df.where("doc_id = 2")).collect()} == {0.0}
    again = mixing.mixed(df, seed=1).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in again} == {r["doc_id"]: r["copies"] for r in mixing.mix(df, seed=1).collect() if r["copies"]}


def test_running_totals_of_a_group_in_many_ranges(spark):
    df = spark.range(3000).selectExpr("'k' as g", "id", "id % 5 as v").repartition(6)
    out = mixing.running_totals(df, ["g"], [F.col("id")], "v", "before").collect()
    at = np.concatenate([[0], np.cumsum(np.arange(3000) % 5)])
    assert all(r["before"] == at[r["id"]] for r in out) and len(out) == 3000


def test_whitening(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) + 50
    x[::7] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(-1, None), (-2, [1.0] * 11 + [None]), (-3, [1.0] * 11 + [float("nan")]), (-4, [1.0] * 11 + [float("inf")])]
    df = spark.createDataFrame([(*r, 0) for r in rows + bad + [(None, x[1].tolist())]], "vec_id long, embedding array<double>, n int").repartition(4)
    out = whitening.whiten(df).collect()
    x = np.floor(1024 * np.vstack([x, x[1:2]])).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    white = centred @ axes[:, ::-1] / np.sqrt(values[::-1])
    got = np.full((n, 8), np.nan)
    for r in out:
        i = n - 1 if r["vec_id"] is None else r["vec_id"]
        got[i, r["component"] - 1] = r["whitened"]
        off = n * x[i].astype(object) - sums.astype(object)
        assert r["n"] == n and r["deviation"] == int((off * off).sum()) == int(r["deviation_exact"])
        assert r["explained"] == pytest.approx(values[::-1][r["component"] - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
    assert len(out) == 8 * n
    sign = np.sign((got * white[:, :8]).sum(axis=0))
    assert np.abs(got - white[:, :8] * sign).max() < 1e-8


def test_whitening_of_odd_vectors(spark):
    huge = [1e300, -1e300, 3.4e38]
    rows = [(1, huge), (2, [0.0, 0.0, 0.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0]), (5, []), (6, [2.0]), (7, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    assert sorted(out) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (4, 1), (4, 2), (6, 1), (7, 1)]
    assert out[3, 1]["whitened"] is None and out[3, 1]["explained"] == 0 and out[3, 1]["deviation"] == 0
    assert abs(out[6, 1]["whitened"]) == 1 and out[6, 1]["n"] == 2
    assert out[1, 1]["deviation"] is None and out[2, 1]["whitened"] == pytest.approx(-out[1, 1]["whitened"])
    assert whitening.whiten(df.limit(0)).count() == 0
    floats = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.25, 7.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(floats).count() == 4
