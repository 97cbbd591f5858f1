"""Hand-made cases of the URL, text and image functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as t, urls as u
from pagemill.operators import images, media
from pagemill.streaming import machines


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function,url,expected",
    [
        (u.media_key, "http://example.com/image.jpg?w=100&h=200", "https://example.com/image.jpg"),
        (u.media_key, "https://example.com/Video.MP4?token=abc", "https://example.com/video.mp4"),
        (u.media_key, "https://Example.com/a+b%20c/", "https://example.com/a+b c"),
        (u.canonical, "https://example.com/media/0338?hl=ru&page=2", "https://example.com/media/0338?page=2"),
        (u.canonical, "https://example.com/page?foo=bar", "https://example.com/page?foo=bar"),
        (u.canonical, "https://example.com/page?utm_source=x#top", "https://example.com/page"),
        (u.has_small_path, "https://e.com/img-150x150.jpg", True),
        (u.has_small_path, "https://e.com/resize/150/150/img.jpg", True),
        (u.has_small_path, "https://e.com/w_100,h_200/img.jpg", True),
        (u.has_small_path, "https://e.com/toy_150x.jpg", True),
        (u.has_small_path, "https://e.com/toy_x150.png", True),
        (u.has_small_path, "https://e.com/img-800x600.jpg", False),
        (u.has_small_path, "https://e.com/toy_800x.jpg", False),
        (u.has_small_path, "https://e.com/model-10x-multiplier.jpg", False),
        (u.is_thumbnail, "https://e.com/photo_thumb.jpg", True),
        (u.is_thumbnail, "https://e.com/thumbnails/photo.jpg", True),
        (u.is_thumbnail, "https://e.com/photo-150x150.jpg", True),
        (u.is_thumbnail, "https://e.com/img/photo.jpg", False),
        (u.is_thumbnail, "https://e.com/images/subject_hq.jpg", False),
        (u.high_resolution, "https://e.com/thumbs/a-150x150.jpg?name=small", "https://e.com/images/a.jpg?name=large"),
        (u.high_resolution, "https://e.com/a.jpg", "https://e.com/a.jpg"),
        (u.video_lines, "https://e.com/a_720p.mp4", 720),
        (u.background_image, 'background: transparent url("https://example.com/2.jpg") no-repeat', "https://example.com/2.jpg"),
        (u.unwrapped, "https://s.example/l/?uddg=https%3A%2F%2Fe.com%2Fa", "https://e.com/a"),
        (u.unwrapped, "https://s.example/ck?u=a1aHR0cHM6Ly9lLmNvbS9i", "https://e.com/b"),
        (u.is_image, "https://e.com/a b.jpg", False),
        (u.is_detail, "https://e.com/a/b", True),
        (u.is_detail, "https://e.com/a?page=2", False),
    ],
)
def test_urls(spark, function, url, expected):
    assert one(spark, function(F.col("url")), url=url) == expected


def test_nulls_stay_null(spark):
    rows = spark.createDataFrame([(None,)], "url string")
    row = rows.select(u.media_key(F.col("url")).alias("a"), u.canonical(F.col("url")).alias("b"), u.host(F.col("url")).alias("c")).first()
    assert row["a"] is None and row["b"] is None and row["c"] is None


def test_subject(spark):
    words = t.subject_tokens("Sci-Fi city", ("night",))
    assert words == ["scifi", "city", "night"]
    assert one(spark, t.subject_score(F.col("x"), words), x="a city at night") == 4
    assert one(spark, t.preview_penalty(F.col("x")), x="thumbnail of a gallery") == 0


def test_tags(spark):
    tags = one(spark, t.tag_tokens("cyberpunk", F.col("stem"), F.col("alt"), F.col("s")), stem="futuristic_city_view_01a", alt="A glowing metropolis at night", s="Sci-Fi")
    assert tags[0] == "cyberpunk" and {"futuristic", "city", "glowing", "sci-fi"} <= set(tags)


def test_chunks(spark):
    text = "One sentence here. " * 4 + "x" * 250 + ". Last one."
    chunks = one(spark, t.chunks(F.col("x"), 100, 20), x=text)
    assert len(chunks) >= 4 and all(0 < len(c) <= 100 for c in chunks)
    assert one(spark, t.chunks(F.col("x"), 100, 20), x="  ") == []
    with pytest.raises(ValueError):
        t.windows(F.col("x"), 10, 10)


def test_dimensions():
    assert images.dimensions(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (800).to_bytes(4, "big") + (600).to_bytes(4, "big")) == (800, 600)
    assert images.dimensions(b"GIF89a" + (5).to_bytes(2, "little") + (7).to_bytes(2, "little")) == (5, 7)
    assert images.dimensions(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (600).to_bytes(2, "big") + (800).to_bytes(2, "big") + b"\0" * 9) == (800, 600)
    assert images.dimensions(b"nothing") is None


def test_dhash_is_signed():
    falling = np.tile(np.arange(9, 0, -1), (8, 1))
    assert images.dhash(falling) == -1 and images.dhash(falling[:, ::-1]) == 0


def test_near_pairs_against_all(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    values = [int(x) for x in base] + [int(x ^ (1 << k)) if k < 63 else int(x) for k, x in enumerate(base)]
    rows = list(enumerate(values))
    got = {(r["a_id"], r["b_id"]) for r in media.near_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", 4).collect()}
    assert got == {(i, j) for i, a in rows for j, b in rows if i < j and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}


def test_greedy_unique_against_a_pass(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 60, (90, 2)) if p[0] != p[1]})
    kept: list[int] = []
    for i in range(60):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    rows = spark.range(60).withColumnRenamed("id", "k")
    got = images.greedy_unique(spark.createDataFrame(pairs, "a_id long, b_id long"), rows, "k")
    assert sorted(r["k"] for r in got.collect()) == kept


def test_cooldowns(spark):
    log = [("h", i, 429) for i in range(12)] + [("g", 0, 429), ("g", 1, 429), ("g", 2, 200), ("g", 3, 429)]
    got = machines.cooldowns(spark.createDataFrame(log, "host string, seq long, status int")).orderBy("seq").collect()
    assert [(r["event"], r["pause_s"]) for r in got] == [("cooldown", 30), ("cooldown", 120), ("cooldown", 600), ("blacklisted", 36000)]


def test_backoff():
    assert machines.backoff([10, 0, 0, 5], 60, 3600) == [60, 120, 240, 60]
    assert machines.backoff([0, 0], 100, 300) == [200, 300]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2024-01-01 0{i}:10:00", 429 if i % 2 else 200) for i in range(6)], "host string, t string, status int").selectExpr("host", "cast(t as timestamp) ts", "status")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = machines.pressure(stream).writeStream.outputMode("complete").format("memory").queryName("pressure").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("pressure").collect())) == sorted(map(tuple, machines.pressure(rows).collect()))


def test_layout_ends_after_many_open_elements():
    from pagemill.operators import extract

    after = '</{0}><p><a href="/story">Story</a><img src="/a.jpg"></p><video src="/v.mp4"></video>'
    for tag, inner in (("nav", "<ul>" + "<li>x" * 300 + "</ul>"), ("nav", "<ul>" + "<li>x" * 300), ("footer", "<p>x" * 300), ("aside", "<table>" + "<tr><td>x<td>y" * 200), ("header", "<dl>" + "<dt>x<dd>y" * 200), ("nav", "<b>" * 3000)):
        _, rows, _ = extract.media_of("http://h/", f'<{tag}><img src="/menu.jpg">{inner}' + after.format(tag))
        assert [(r["kind"], r["url"], r["in_layout"]) for r in rows] == [("link", "http://h/story", False), ("image", "http://h/a.jpg", False), ("video", "http://h/v.mp4", False)]
    _, rows, _ = extract.media_of("http://h/", "<i>" * 2500 + '<nav><img src="/menu.jpg"></nav><img src="/a.jpg">')
    assert [r["url"] for r in rows] == ["http://h/a.jpg"]
    page = extract.Page("http://h/")
    page.feed("<ul>" + '<li class="menu"><ul><li>x</ul>' + "<li>y" * 50 + '<img src="/a.jpg">')
    assert len(page.stack) == 2 and [r["url"] for r in page.rows] == ["http://h/a.jpg"]
