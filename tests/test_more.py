"""Operators without a SQL twin against plain versions, and that inputs of the twins meet every branch."""

import random
from urllib import robotparser

import pytest
from pyspark.sql import functions as F

from pagemill.functions import scope, text, urls
from pagemill.operators import runs, telemetry
from pagemill.plans import catalog

DATA = "/root/testdata/sf0.01"


def test_scope_inputs_meet_every_rule(spark):
    found = {r["reason"] for r in catalog.queries()["detail_scope"](spark, DATA).select("reason").distinct().collect()}
    assert found == {None, "same_page", "pagination", "navigation", "utility", "other_listing", "root_seed", "other_profile", "sibling"}


@pytest.mark.parametrize("seed, link, wanted", [
    ("/somesubject", "/somesubject", False), ("/somesubject", "/somesubject/Photos", True), ("/somesubject", "/othermodel", False), ("/somesubject", "/2257", False),
    ("/somesubject", "/random/medias", False), ("/somesubject", "/somesubject/1/full/img_001.webp", True), ("/somesubject", "/models/l/a/la-other", False),
    ("/search?q=somesubject", "/a/4711", True), ("/search?q=somesubject", "/other", False), ("/search?q=somesubject", "/s/faq", False), ("/search?q=somesubject", "/user/somesubject", True),
    ("/start", "/opaque/1", True), ("/", "/opaque/1", False), ("/", "/x/somesubject-2", True), ("/start", "/tag/other", False), ("/start", "/list/page/2", False), ("/start", "/x?p=3", False),
])
def test_detail_pages(spark, seed, link, wanted):
    row = spark.createDataFrame([(f"https://example.com{link}", f"https://example.com{seed}")], "link string, seed string")
    reason = row.select(scope.detail_reason(F.col("link"), F.col("seed"), "somesubject", ("somesubject",)).alias("r")).first()["r"]
    assert (reason is None) == wanted, reason


def test_without_a_subject_only_the_seed_counts(spark):
    row = spark.createDataFrame([("https://e.com/models/x", "https://e.com/")], "link string, seed string")
    assert row.select(scope.detail_reason(F.col("link"), F.col("seed")).alias("r")).first()["r"] is None


def test_chunks_pack_sentences():
    rng = random.Random(1)
    for _ in range(300):
        words = ["".join(rng.choices("abcdé", k=rng.randint(1, 12))) + rng.choice(["", "", ".", "!", "?"]) for _ in range(rng.randint(0, 60))]
        body, size, overlap = rng.choice([" ", "\n ", "\t"]).join(words), rng.randint(5, 60), rng.randint(0, 4)
        whole = " ".join(body.split())
        got = text.packed(body, size, overlap)
        assert all(0 < len(x) <= size for x in got)
        want, held = [], ""  # as one would write it down
        for s in __import__("re").split(r"(?<=[.!?])\s+", whole) if len(whole) > size else ([whole] if whole else []):
            if len(f"{held} {s}".strip()) <= size:
                held = f"{held} {s}".strip()
                continue
            want += [held] if held else []
            held = s if len(s) <= size else ""
            want += [s[k : k + size] for k in range(0, len(s), size - overlap)] if len(s) > size else []
        assert got == want + ([held] if held else [])
    assert text.packed(None, 5, 0) is None


def test_throttled_against_a_plain_bucket(spark):
    rng, rows = random.Random(2), []
    for host in "ab":
        ts = 0.0
        for k in range(200):
            ts += rng.random()
            rows.append((host, k, ts, rng.choice([0, 10, 400, 3000])))
    got = {(r["host"], r["seq"]): r["pause"] for r in telemetry.throttled(spark.createDataFrame(rows, "host string, seq long, ts double, bytes long"), 500.0).collect()}
    for host in "ab":
        tokens, last, moved = 250.0, next(r[2] for r in rows if r[0] == host), 0.0
        for _, k, ts, size in (r for r in rows if r[0] == host):
            now, pause = ts + moved, 0.0
            if size:
                tokens = min(250.0, tokens + (now - last) * 500) - size
                last = now
                if tokens < 0:
                    pause = min(5.0, max(0.001, -tokens / 500))
                    last, moved, tokens = now + pause, moved + pause, 0.0
            assert got[host, k] == pytest.approx(pause)


def test_robots(spark):
    body = "User-agent: *\nDisallow: /no\nAllow: /no/but\n\nUser-agent: bad\nDisallow: /"
    links = [f"https://a.com{p}" for p in ("/", "/no", "/no/x", "/yes?x=/no")] + ["https://b.com/no", None]
    rows = telemetry.robots_allowed(spark.createDataFrame([(x,) for x in links], "url string"), spark.createDataFrame([("a.com", body), ("c.com", "")], "host string, body string")).collect()
    parser = robotparser.RobotFileParser()
    parser.parse(body.splitlines())
    assert {r["url"]: r["allowed"] for r in rows} == {x: True if x is None or "b.com" in x else parser.can_fetch("*", x) for x in links}


def test_log_lines_and_progress(spark):
    raw = spark.createDataFrame([("Fetching pages: 40%|##  | 4/10 [00:03<00:05]\r 50%| 5/10 [00:04] 2024-01-02 03:04:05 INFO Downloaded 2 images\n",), ("plain",), (" ",)], "value string")
    rows = [(r["bar"], r["line"]) for r in telemetry.log_lines(raw).collect()]
    assert rows == [("Fetching pages: 40%|##  | 4/10 [00:03<00:05]", ""), ("50%| 5/10 [00:04]", "2024-01-02 03:04:05 INFO Downloaded 2 images"), ("", "plain")]
    bar = telemetry.log_lines(raw).select(telemetry.progress(F.col("bar")).alias("p")).collect()[0]["p"]
    assert (bar["percent"], bar["current"], bar["total"], bar["time"]) == (40, 4, 10, "00:03<00:05")
    lines = spark.createDataFrame([(k, f"l{k}") for k in range(5)], "seq long, line string")
    assert [telemetry.lines_from(lines, n).count() for n in (0, 3, 5, 6)] == [5, 2, 0, 5]


def test_training_export_against_one_pass(spark):
    rng = random.Random(3)
    rows = [(f"d/{k:03d}.png", rng.choice([None, 100, 500]), rng.choice([100, 500]), rng.choice([None, rng.getrandbits(4), rng.getrandbits(60)]), rng.random() * 10, ["A b"]) for k in range(150)]
    got = {r["path"] for r in runs.training_export(spark.createDataFrame(rows, "path string, width int, height int, dhash long, score double, tags array<string>"), 300, 4.0).collect()}
    want, seen = set(), []
    for path, w, h, bits, score, _ in rows:
        if w is not None and w < 300 and h < 300:
            continue
        if bits is not None:
            if any((bits ^ x).bit_count() <= 4 for x in seen):
                continue
            seen.append(bits)
        if score >= 4.0:
            want.add(path)
    assert got == want


def test_normal_forms(spark):
    cases = {
        " http://e.com/a b?utm_source=1&x=1#f ": "http://e.com/a%20b?x=1", "http://e.com/%E9x/?q=a%20b": "http://e.com/%EF%BF%BDx/?q=a%2Bb",
        "http://e.com/p?REF=1&Lang=de": "http://e.com/p", "http://E.com/P/?a=&b": "http://E.com/P/?a=&b=", "http://[": "http://[", "": "", None: None,
    }
    rows = spark.createDataFrame([(x,) for x in cases], "url string").select("url", urls.normalized(F.col("url")).alias("n")).collect()
    assert {r["url"]: r["n"] for r in rows} == cases
    base = spark.createDataFrame([("http://e.com/a/b", "../c"), ("http://e.com/a/b", ""), ("http://e.com/a", "//x.org/y"), ("http://e.com/a", None)], "b string, l string")
    assert [r[0] for r in base.select(urls.absolute(F.col("b"), F.col("l"))).collect()] == ["http://e.com/c", "http://e.com/a/b", "http://x.org/y", "http://e.com/a"]
