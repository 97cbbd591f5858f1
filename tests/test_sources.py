"""Manifests, page extraction, payloads, state and sinks."""

import base64
import datetime

from pagemill.operators import extract, payloads
from pagemill.sources import manifest, sinks
from pagemill.sources.state import StateStore

TEXT = """# Subject: Red Panda / Firefox
# ---
# type: image  |  crawl: direct
# [CDN] s{NNN}.example.com
# depth: 2
# Rate-limit: 0.5 req/s
# min-image-size: 640x480
# Password: secret
https://a.example.com/videos/red_panda
https://a.example.com/other

# disabled
https://b.example.com/x
https://a.example.com/videos/red_panda
"""


def test_parse(spark):
    m = manifest.parse(TEXT)
    assert m.subject == "Red Panda / Firefox" and m.entity_tokens == ["red panda", "red", "panda", "firefox"]
    a, b = m.profiles
    assert (a.domain, a.media_type, a.crawl_strategy, a.effective_depth, a.rate_limit, a.min_image_size) == ("a.example.com", "image", "direct", 2, 0.5, (640, 480))
    assert a.cdn_hosts == ["example.com"] and a.subject_aliases == ["red_panda", "other"] and len(a.seed_urls) == 2
    assert not any("secret" in n for n in a.notes)
    assert b.disabled and b.media_type == "mixed" and b.effective_depth == 1
    assert manifest.profiles(spark, m).where("disabled").count() == 1


def test_validate():
    assert manifest.validate("https://a.example.com/x") == [(0, "no '# Subject: <name>' header")]
    assert len(manifest.validate("# Subject: x\n# typ: image\n# dept: 2\n# ratelimit: 3\nhttps://a.example.com/x")) == 3
    assert [n for n, _ in manifest.validate(TEXT)] == [14]
    assert manifest.validate(" ") == [(0, "the manifest is empty")]


PAGE = """<html><head><title> A  page </title><meta property="og:image" content="/og.png">
<script type="application/ld+json">{"@type":"VideoObject","contentUrl":"https://v.example.com/c.mp4","thumbnailUrl":"/t.jpg"}</script></head><body>
<nav><a href="/menu">Menu</a><img src="/logo.png"></nav>
<img srcset="/s.jpg 300w, /l.jpg 900w" alt="Big" width="900" height="600"><img data-src="/lazy-thumb.jpg" src="/x.gif">
<div style="background-image:url('/bg.webp')"></div><a href="/highres.jpg">High Res Link</a><a href="/About">About us</a><a href="https://other.example.org/z">z</a>
<video controls loop><source src="/clip.mp4"></video><a href="http://example.com/demo.mp4">demo</a>
<p>see https://www.youtube.com/watch?v=abc123</p><iframe src="/embed?q=%s"></iframe></body></html>"""


def test_extract(spark):
    hidden = base64.b64encode(b'<video><source src="https://v.example.com/hidden.mp4"></video>').decode()
    rows = [(1, "https://example.com/p", PAGE % hidden), (2, "https://example.com/q", None), (3, "https://example.com/j", '{"a":["/i.png","/v.webm","text"]}')]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {k: [r["url"] for r in got if r["page_id"] == 1 and r["kind"] == k] for k in ("image", "video", "link")}
    base = "https://example.com"
    assert by["image"] == [f"{base}/og.png", f"{base}/t.jpg", f"{base}/l.jpg", f"{base}/lazy.jpg", f"{base}/bg.webp", f"{base}/highres.jpg"]
    assert by["video"] == ["https://v.example.com/c.mp4", f"{base}/clip.mp4", "http://example.com/demo.mp4", "https://www.youtube.com/watch?v=abc123", "https://v.example.com/hidden.mp4"]
    assert {r["title"] for r in got if r["page_id"] == 1} == {"A page"}
    assert [(r["kind"], r["url"]) for r in got if r["page_id"] == 3] == [("image", f"{base}/i.png"), ("video", f"{base}/v.webm")]
    edges = extract.page_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["target"], r["text"]) for r in edges if "About" in r["target"]] == [(f"{base}/About", "about us")]
    assert not any("menu" in r["target"] or "other" in r["target"] for r in edges)


def test_sources_of_a_set():
    assert extract.best_source("/a.jpg 1x, /b.jpg 2x") == "/b.jpg"
    assert extract.best_source("/a.jpg, /b.jpg") == "/a.jpg"
    assert extract.best_source("") is None


def test_payloads(spark):
    tweet = '{"media_extended":[{"type":"video","variants":[{"url":"a.mp4","bitrate":1},{"url":"b.mp4","bitrate":5},{"url":"c.mp4","bitrate":5}]},{"type":"image","url":"https://p/x.jpg?name=small"}]}'
    rows = [("https://x.com/u/status/1", tweet), ("https://safebooru.org/p", '[{"file_url":"z.webm"},{"large_file_url":"y.png"}]'), ("https://e.com/a", "{}"), ("https://x.com/u/status/2", "broken"), ("https://x.com/u/status/3", None)]
    got = [(r["kind"], r["url"]) for r in payloads.extract(spark.createDataFrame(rows, "url string, body string")).collect()]
    assert sorted(got) == sorted([("video", "b.mp4"), ("image", "https://p/x.jpg?name=large"), ("video", "z.webm"), ("image", "y.png")])


def test_state(spark, tmp_path):
    store, day = StateStore(spark, str(tmp_path / "state")), datetime.datetime
    rows = lambda *x: spark.createDataFrame(x, "url_hash string, url string, ts timestamp")
    store.upsert("processed_urls", rows(("a", "https://e.com/a", day(2024, 1, 1)), ("b", "https://f.com/b", day(2024, 2, 1))))
    store.upsert("processed_urls", rows(("a", "https://e.com/a2", day(2024, 3, 1))))
    assert {r["url"] for r in store.load("processed_urls").collect()} == {"https://e.com/a2", "https://f.com/b"}
    assert {r["url_hash"]: r["known"] for r in store.known("processed_urls", rows(("a", "", day(2024, 1, 1)), ("c", "", day(2024, 1, 1)))).collect()} == {"a": True, "c": False}
    assert store.prune("processed_urls", day(2024, 2, 15)) == 1 and store.stats()["processed_urls"] == 1
    hashes = lambda *x: spark.createDataFrame(x, "dhash long, subject string, ts timestamp")
    store.insert_absent("hashes", hashes((1, "s", day(2024, 1, 1))))
    store.insert_absent("hashes", hashes((1, "t", day(2024, 1, 2)), (2, "t", day(2024, 1, 2))))
    assert {(r["dhash"], r["subject"]) for r in store.load("hashes").collect()} == {(1, "s"), (2, "t")}
    store.flush_hashes("s")
    store.clear_domain("e.com")
    assert store.stats() == {"processed_urls": 0, "dead_urls": 0, "hashes": 1}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("image", "u", "s", "low_score", 1)], "kind string, url string, source_page string, reason string, score int")
    sinks.csv(rows, "rejected", str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == list(sinks.CSV_COLUMNS["rejected"])
    sinks.dataset(spark.createDataFrame([(" ", ["a", "b"])], "prompt string, tags array<string>"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["caption"] == "a, b"
    report = sinks.domain_report(spark.createDataFrame([("h", None), ("h", "x"), ("h", "x")], "host string, reason string")).first()
    assert (report["kept"], report["rejected"], report["reasons"]) == (1, 2, {"x": 2})
