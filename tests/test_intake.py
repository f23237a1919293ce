"""Bans and the intake of reports: checks, folds of sorted keys, and streams with restarts against the batch forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import bans, folds, intake
from textloom.streaming import bans as ban_stream
from textloom.streaming import intake as intake_stream

VERSIONS, CHAPTERS = ["pm", "2013"], {"alma": 63, "moro": 10}
GOOD = {"version": "pm", "comparedWith": "2013", "book": "alma", "chapter": 3, "verses": [4, 2, 4], "errorType": "typo", "selectedText": "a\nb", "expectedText": None, "description": "", "url": "https://x.test/a"}
CHECKS = [
    (GOOD, None), ("{", "invalid json"), ("null", "payload must be an object"), ("3", "payload must be an object"), ("[]", "unknown version"), ({**GOOD, "version": "xx"}, "unknown version"), ({**GOOD, "version": 5}, "unknown version"),
    ({**GOOD, "comparedWith": None}, "unknown comparedWith version"), ({**GOOD, "book": "constructor"}, "unknown book"), ({**GOOD, "chapter": "3"}, "chapter out of range"), ({**GOOD, "chapter": 3.5}, "chapter out of range"),
    ({**GOOD, "chapter": 3.0}, None), ({**GOOD, "chapter": 0}, "chapter out of range"), ({**GOOD, "chapter": 64}, "chapter out of range"), ({**GOOD, "verses": []}, "invalid verses"), ({**GOOD, "verses": [1] * 20}, None), ({**GOOD, "verses": [1] * 21}, "invalid verses"),
    ({**GOOD, "verses": [301]}, "invalid verses"), ({**GOOD, "verses": [1, "2"]}, "invalid verses"), ({**GOOD, "verses": "1"}, "invalid verses"), ({**GOOD, "verses": [None]}, "invalid verses"), ({**GOOD, "errorType": "bug"}, "unknown errorType"), ({**GOOD, "selectedText": "x" * 501}, "selectedText too long"),
    ({**GOOD, "selectedText": "😀" * 251}, "selectedText too long"), ({**GOOD, "selectedText": 7}, "selectedText too long"), ({**GOOD, "expectedText": "x" * 501}, "expectedText too long"), ({**GOOD, "description": "x" * 2001}, "description too long"), ({**GOOD, "description": "x" * 2000}, None),
    ({**GOOD, "url": "https://" + "x" * 500}, "url too long"), ({**GOOD, "url": "javascript:alert(1)"}, "invalid url"), ({**GOOD, "url": "https://a b"}, "invalid url"), ({k: v for k, v in GOOD.items() if k != "url"}, None),
]


def test_checks(spark):
    rows = [(i, x if isinstance(x, str) else json.dumps(x)) for i, (x, _) in enumerate(CHECKS)] + [(len(CHECKS), None)]
    out = intake.checked(spark.createDataFrame(rows, "i int, payload string"), VERSIONS, CHAPTERS).orderBy("i").collect()
    assert [r["error"] for r in out] == [e for _, e in CHECKS] + ["invalid json"]
    r = out[0]["report"]
    assert (r["verses"], r["expectedText"], r["chapter"]) == ([2, 4], "", 3) and out[5]["report"] is None


def test_issues_are_read_back(spark):
    rows = [(json.dumps(GOOD),), (json.dumps({**GOOD, "verses": [7], "selectedText": '"x" ```json {"version": "pm"} ```'}),)]
    done = intake.checked(spark.createDataFrame(rows, "payload string"), VERSIONS, CHAPTERS)
    names = {"alma": "Alma"}
    out = intake.reports_of(done.select("report", intake.issue_title(F.col("report"), names).alias("title"), intake.issue_body(F.col("report"), names, {"pm": "Printer's"}).alias("body")).withColumnRenamed("report", "was"), VERSIONS, CHAPTERS).collect()
    assert all(r["report"] == r["was"] for r in out)
    assert [r["title"] for r in out] == ["[correction] pm — Alma 3:2–4", "[correction] pm — Alma 3:7"]
    assert "**Reported text:**\n> a\n> b\n\n**Page:** https://x.test/a" in out[0]["body"] and "**Compared with:** 2013" in out[0]["body"]
    assert intake.reports_of(spark.createDataFrame([("none",), (None,)], "body string"), VERSIONS, CHAPTERS).where("report IS NOT NULL").count() == 0


PROBED = [("/.env", True), ("/%2Eenv", True), ("/a/.git/x", True), ("/CONFIG", True), ("/api/x", True), ("/x/api/", False), ("/API/", False), ("/wp-login", True), ("/%zz", False), ("/%zz/.ssh", True), ("/a+b", False), ("/alma/3", False)]


def test_probes(spark):
    out = spark.createDataFrame(PROBED + [(None, None)], "path string, want boolean").select("want", bans.is_probe(F.col("path")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in out)


def test_a_ban_needs_ten_missing_pages_within_the_window():
    def run(times, status=404):
        state, out = bans.start(), []
        for t in times:
            state, values = bans.step(state, "request", False, status, t)
            out.append(values)
        return out

    assert [o[1] for o in run(range(0, 12_000, 1000))] == [None] * 9 + ["rate_limit_404"] + ["ip_banned"] * 2
    assert not any(o[2] for o in run([0, *(700_000 + i for i in range(9))]))
    assert not any(o[2] for o in run(range(50), 200))


def events():
    random.seed(9)
    kinds = [("request", "/alma/1", 404)] * 6 + [("request", "/alma/1", 200)] * 3 + [("request", "/.env", 200), ("unban", None, None)]
    rows = [(random.choice(["hot", "hot", "a", "b", None]), random.randrange(2000) * 100, i, *random.choice(kinds)) for i in range(3000)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


SCHEMA = "client string, ms long, seq long, kind string, path string, status int"


def plain(rows, window, threshold):
    states, out = {}, {}
    for client, ms, seq, kind, path, status in rows:
        states[client], out[seq] = bans.step(states.get(client, bans.start()), kind, path == "/.env", status, ms, window, threshold)
    return out, {c for c, s in states.items() if s[0]}


def test_bans_by_batch(spark):
    rows = events()
    want, banned = plain(rows, 5000, 4)
    random.shuffle(rows)
    out = bans.decided(spark.createDataFrame(rows, SCHEMA).repartition(6), 5000, 4)
    assert {r["seq"]: (r["outcome"], r["reason"], r["banned"]) for r in out.collect()} == want
    assert {r["client"] for r in bans.bans(out).collect()} == banned
    assert bans.decided(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bans_by_stream_with_a_restart(spark, tmp_path):
    rows = [r for r in events() if r[0] is not None]
    want, _ = plain(rows, 5000, 4)
    source = spark.readStream.schema(SCHEMA)
    for k, part in enumerate((rows[:1000], rows[1000:1700], rows[1700:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = ban_stream.decided(source.parquet(f"{tmp_path}/in/*"), 5000, 4).writeStream.option("checkpointLocation", f"{tmp_path}/c").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        stream.awaitTermination()
    got = {r["seq"]: (r["outcome"], r["reason"], r["banned"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want


def reports():
    random.seed(3)
    rows = []
    for i in range(400):
        report = {**GOOD, "chapter": random.randint(1, 2), "verses": [random.randint(1, 40), random.randint(1, 40)], "version": random.choice(VERSIONS)}
        payload = random.choice([json.dumps(report)] * 8 + ["{", json.dumps({**report, "website": "x"}), json.dumps({**report, "book": "z"})])
        rows.append((random.choice(["hot", "hot", "a", "b", "c"]), i * 4000 + random.randrange(3000), i, payload))
    return rows


def test_reports_by_stream_with_a_restart_are_those_of_a_batch(spark, tmp_path):
    rows, schema = reports(), "client string, ms long, seq long, payload string"
    first = spark.createDataFrame([("gh1", "pm", "alma", 1, [3, 4])], intake_stream.ISSUES)
    batch = intake.outcomes(intake.limited(intake.checked(spark.createDataFrame(rows, schema).repartition(4), VERSIONS, CHAPTERS)), first)
    want = {r["seq"]: (r["outcome"], r["duplicate_of"]) for r in batch.collect()}
    assert {o for o, _ in want.values()} == {"created", "duplicate", "rate limited", "ignored", "invalid json", "unknown book"}
    first.write.parquet(f"{tmp_path}/issues/batch=-1")
    for k, part in enumerate((rows[:150], rows[150:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = intake_stream.take_in(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), VERSIONS, CHAPTERS, f"{tmp_path}/issues", f"{tmp_path}/out", f"{tmp_path}/c")
        stream.processAllAvailable()
        stream.stop()
    got = {r["seq"]: (r["outcome"], r["duplicate_of"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want
    created = sum(o == "created" for o, _ in want.values())
    assert intake_stream.open_issues(spark, f"{tmp_path}/issues").count() == created + 1
    assert intake_stream.open_issues(spark, f"{tmp_path}/issues", -1).count() == created


@pytest.mark.parametrize("parts", [1, 7])
def test_folds(spark, parts):
    rows = [(k, i, i % 3) for i in range(500) for k in ("hot", None)] + [("x", 0, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(parts)
    out = folds.folded(df, ["k"], ["i"], ["v"], "total long, seen int", lambda: (0, 0), lambda s, v: ((s[0] + v, s[1] + 1), (s[0] + v, s[1] + 1))).collect()
    assert len(out) == 1001
    for r in out:
        assert r["seen"] == r["i"] + 1 and (r["k"] == "x" or r["total"] == sum(j % 3 for j in range(r["i"] + 1)))
