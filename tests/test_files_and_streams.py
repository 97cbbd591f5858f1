"""Files, sinks, extraction fallbacks and streams on small inputs."""

import datetime
import json
import os
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from pagemill.operators import extract, images, media
from pagemill.sources import files, manifest, sinks
from pagemill.streaming import machines, queue


def png(w, h):
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def jpeg(w, h, metadata):
    parts = [b"\xff\xe1" + struct.pack(">H", 65535) + b"x" * 65533 for _ in range(metadata)]
    return b"\xff\xd8" + b"".join(parts) + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9 + b"\xff\xd9"


def test_images_of_a_folder(spark, tmp_path):
    (tmp_path / "below").mkdir()
    (tmp_path / "a_cat-red.png").write_bytes(png(2000, 800))
    (tmp_path / "below" / "b.JPG").write_bytes(jpeg(640, 900, 5))
    (tmp_path / "c.txt").write_text("no picture")
    rows = images.scanned(spark, str(tmp_path))
    sized = images.with_dimensions(rows)
    assert {(os.path.basename(r["path"]), r["width"], r["height"]) for r in sized.collect()} == {("a_cat-red.png", 2000, 800), ("b.JPG", 640, 900)}
    assert images.scanned(spark, str(tmp_path), below=False).count() == 1
    assert images.crop_plan(sized, 512, 512).count() == 2
    tags = {os.path.basename(r["path"]): r["tags"] for r in images.tagged(sized, "trig", "subject").collect()}
    assert tags["a_cat-red.png"][:3] == ["trig", "cat", "red"] and {"subject", "landscape", "highres"} <= set(tags["a_cat-red.png"])


def test_both_hashes_have_opposite_bits(spark):
    rng = np.random.default_rng(1)
    grey = rng.permutation(72 * 5).reshape(5, 8, 9)
    both = [(images.dhash(x) ^ int(y)) & (2**64 - 1) for x, y in zip(grey, images.dhash_batch(grey))]
    assert both == [2**64 - 1] * 5
    rows = spark.createDataFrame([(k, [int(v) for v in x.ravel()]) for k, x in enumerate(grey)] + [(9, [1]), (8, None)], "k int, pixels array<int>")
    got = {r["k"]: r["dhash"] for r in images.hashed(rows).collect()}
    assert [got[k] for k in range(5)] == images.dhash_batch(grey).tolist() and got[9] is None and got[8] is None


def test_download_gates(spark):
    good = png(500, 400) + b"x" * 20_000
    cases = [
        ("http://e.com/a.png", len(good), good, 500, 400, "image", False, None, None), ("http://e.com/b.png", len(good), good, 500, 400, "image", True, None, "dead_url"),
        ("http://e.com/c.png", 99, good, 500, 400, "image", False, None, "too_small"), ("http://e.com/d.mp4", len(good), good, None, None, "video", False, None, "signature_mismatch"),
        ("http://e.com/e.m3u8?x", 9, b"#EXTM3U", None, None, "video", False, None, None), ("http://e.com/f.png", len(good), good, None, 400, "image", None, None, "unknown_dimensions"),
        ("http://e.com/g.png", len(good), good, 399, 400, "image", False, None, "low_resolution"), ("http://e.com/h.png", len(good), good, 500, 400, "image", False, 600, "low_resolution"),
    ]
    df = spark.createDataFrame(cases, "url string, size long, content binary, w int, h int, kind string, dead boolean, least int, want string")
    reason = media.content_reason(*(F.col(c) for c in ("url", "size", "content", "w", "h", "kind", "dead", "least")))
    assert df.withColumn("got", reason).where("not (got <=> want)").count() == 0


def test_extraction_fallbacks(spark):
    kinds = lambda html, **k: [(r["kind"], r["url"], r["place"]) for r in extract.media_of("http://e.com/p/", html, **k)[1]]
    assert kinds("<div data-full='a.jpg' title='t' alt='x.png'></div>") == [("image", "http://e.com/p/a.jpg", "attribute")]
    assert kinds("<img src=b.png><div data-full='a.jpg'></div>") == [("image", "http://e.com/p/b.png", "img")]
    assert kinds("<div data-clip='v.mp4'></div>") == [] and kinds("<div data-clip='v.mp4'></div>", videos_too=True) == [("video", "http://e.com/p/v.mp4", "attribute")]
    assert kinds("<a data-fslightbox href='v.mp4'>x</a><a href='w.webm'>y</a>") == [("video", "http://e.com/p/v.mp4", "lightbox"), ("video", "http://e.com/p/w.webm", "anchor")]
    assert kinds("<video controls loop><source src='https://vimeo.com/video/12'></video><video controls><source src='https://vimeo.com/video/13'></video>") == [("video", "https://vimeo.com/video/12", "video")]
    assert ("link", "http://e.com/next", "link") in kinds("<link rel=next href=/next>")
    pages = spark.createDataFrame([(1, "http://e.com/x", "<meta property='og:url' content='http://e.com/login?n=1'><img src=a.png>")], "page_id long, url string, html string")
    assert [(r["kind"], r["url"]) for r in extract.extract(pages).collect()] == [("login_wall", "http://e.com/x")]


def test_manifest_lint():
    text = "# Subject: some one\nhttps://a.com/x\nhttps://a.com/y\nhttps://b.com/\nhttps://a.com/z\n"
    assert manifest.lint(text) == (False, [(5, "duplicate domain a.com")])
    assert manifest.lint("# Subject: some one\nhttps://a.com/x\n") == (True, [])


def test_files(spark, tmp_path):
    rules = {"rules": [{"pattern": "a", "replacement": "b"}, {"pattern": ""}]}
    (tmp_path / "r.json").write_text(json.dumps(rules))
    assert files.rewrite_rules(files.rules(spark, str(tmp_path / "r.json"))) == [("a", "b")] and files.rules(spark, str(tmp_path / "none.json")) == {}
    folder = tmp_path / "t"
    folder.mkdir()
    for name in ("some_one.txt", "b.txt", "c.md"):
        (folder / name).write_text("x")
    assert [r["name"] for r in files.targets(spark, str(folder)).collect()] == ["b", "some one"]
    later = datetime.datetime.now() + datetime.timedelta(seconds=1800)
    assert files.cached(spark, str(folder), later).count() == 3
    assert files.cached(spark, str(folder), later + datetime.timedelta(days=1)).count() == 0
    before = spark.createDataFrame([("a", later), ("b", later)], "path string, modificationTime timestamp")
    after = spark.createDataFrame([("a", later), ("b", later + datetime.timedelta(1)), ("c", later)], "path string, modificationTime timestamp")
    assert {r["path"] for r in queue.changed(before, after).collect()} == {"b", "c"}


def test_summary_archive_and_report(spark, tmp_path):
    overall = spark.createDataFrame([(3, 5)], "pages long, images long")
    hosts = spark.createDataFrame([("b.com", 1), ("a.com", 2)], "host string, pages long")
    reasons = spark.createDataFrame([(f"r{k}", k) for k in range(12)], "reason string, n long")
    sinks.run_summary(overall, hosts, reasons, str(tmp_path / "s"))
    doc = json.loads(next((tmp_path / "s").glob("*.json")).read_text())
    assert doc["pages"] == 3 and [h["host"] for h in doc["hosts"]] == ["a.com", "b.com"] and len(doc["top_reasons"]) == 10
    rows = spark.createDataFrame([("1_x/b.png", bytearray(b"B")), ("1_x/a.png", bytearray(b"A"))], "name string, content binary")
    assert sinks.archive(rows, str(tmp_path / "z.zip")) == 2
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.namelist() == ["1_x/a.png", "1_x/b.png", "metadata.json"] and z.read("1_x/b.png") == b"B"
    assert sinks.console_report(hosts, spark.createDataFrame([("u",)], "url string")) == "host | pages\na.com | 2\nb.com | 1\ndead: u"


def test_media_queue_takes_each_key_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(3):
        rows = [{"seq": 10 * k + j, "url": f"http://e.com/{(k + j) % 4}.png?v={k}"} for j in range(3)]
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):  # started again, it goes on where it was
        stream = queue.media_batches(spark, str(source), "seq long, url string", files_a_trigger=1)
        queue.deduplicated_sink(stream, out, str(tmp_path / "ck")).awaitTermination()
    keys = [r["media_key"] for r in spark.read.parquet(out).collect()]
    assert sorted(keys) == [f"https://e.com/{k}.png" for k in range(4)]


def test_cooldowns_in_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    statuses = [429, 500, 429, 200, 429, 429, 429, 429, 429, 429, 429, 429, 429]
    rows = [(h, k, s) for h in ("a", "b") for k, s in enumerate(statuses if h == "a" else [200, 429, 429])]
    for n in range(3):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"host": h, "seq": k, "status": s}) for h, k, s in rows if k // 5 == n))
        os.utime(source / f"{n}.json", (1_000_000 + n, 1_000_000 + n))  # the order they are read in
    log = spark.readStream.schema("host string, seq long, status int").option("maxFilesPerTrigger", 1).json(str(source))
    query = machines.cooldown_stream(log).writeStream.format("memory").queryName("cooled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("cooled").collect()))
    want = sorted(map(tuple, machines.cooldowns(spark.createDataFrame(rows, "host string, seq long, status int")).collect()))
    assert got == want and len(got) == 4


def test_watch_cycle():
    pruned, found = [], {"a": [0, 0, 3], "b": [0, 1, 0]}
    out = queue.watch_cycle(["a", "b"], lambda t: found[t].pop(0), lambda: pruned.append(1), 6)
    assert [x["target"] for x in out] == list("ababab") and len(pruned) == 1 and [x["pause"] for x in out] == [2.0, 4.0, 8.0, 1.0, 1.0, 2.0]
    assert queue.watch_cycle([], lambda t: 0, lambda: None, 3) == []
