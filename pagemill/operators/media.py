"""Relevance scores and ordered rejection of media candidates, de-duplication and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagemill.functions import text as t, urls as u, vocab as v


def with_profiles(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds what the profiles say of an item's source host, and of its own host where the source has no pattern.

    Profiles are a dimension of the manifest, one row per host.
    """
    host = u.host(F.col("source_page"))
    p = profiles.select(F.col("host").alias("__p"), F.col("media_type").alias("expected"), F.col("thumb_pattern").alias("pattern"))
    own = profiles.select(F.col("host").alias("__o"), F.col("thumb_pattern").alias("own_pattern"))
    return items.join(p, host == F.col("__p"), "left").join(own, u.host(F.col("url")) == F.col("__o"), "left").drop("__p", "__o")


def judged(items: DataFrame, words: list[str], cdn_hosts=()) -> DataFrame:
    """Adds score and reason (the first rule that rejects an item; null keeps it) to images and videos with profiles.

    Texts, flags and penalties that several rules share are made once, stage by stage, as columns. Items without a
    column in_layout stand in no layout container.
    """
    url, image = F.col("url"), F.col("kind") == "image"
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    layout = F.coalesce("in_layout", F.lit(False)) if "in_layout" in items.columns else F.lit(False)
    rows = items.withColumns({"__type": F.coalesce(u.video_type(url), F.lit("")), "__layout": layout})
    rows = rows.withColumns({
        "__text": F.lower(F.concat_ws(" ", url, "source_page", F.when(image, F.col("alt_text")).otherwise(F.col("__type")), "page_title")),
        "__own": F.lower(F.when(image, F.concat_ws(" ", url, "alt_text")).otherwise(url)),
        "__high": u.high_resolution(url),
    })
    listed = u.is_archive(F.col("source_page"), F.col("page_title"))
    rows = rows.withColumns({
        "__penalty": t.preview_penalty(F.when(image, F.col("__text")).otherwise(F.lower(url))),
        "__subject": t.has_subject(F.col("__text"), words),
        "__placeholder": u.any_of(F.col("__text"), v.PLACEHOLDER_TERMS),
        "__off": listed & ~u.in_hosts(u.host(url), cdn_hosts) & ~t.has_subject(F.col("__own"), words),  # on a listing page, without the subject
    })
    text, penalty = F.col("__text"), F.col("__penalty")
    small = url.rlike(r"(?i)(?:^|[?&])(width|height|w|h)=\d{1,3}(?:$|&)")
    both = t.subject_score(text, words) + points(F.col("page_title") != "", 1) - penalty - points(F.col("__layout"), 20) - points(F.col("__off"), 15)
    of_image = (
        points(F.col("alt_text") != "", 1)
        - points(u.any_of(text, v.GENERIC_TERMS), 3)
        - points(F.col("__placeholder"), 4)
        + points(u.any_of(text, v.IMAGE_WORDS), 1)
        + points(u.is_image(url), 2)
        - points(small, 3)
        - points(F.col("width") < 300, 20)
        - points(F.col("height") < 300, 20)
        + points(F.col("expected") == "image", 3)
    )
    of_video = (
        points(F.col("__type").isin(*v.VIDEO_TYPES), 2)
        + points(u.any_of(text, v.VIDEO_WORDS), 1)
        + points(u.is_video(url), 2)
        - points(t.preview_penalty(F.lower(F.concat_ws(" ", "source_page", "page_title"))) >= 4, 2)
        + points(F.col("expected") == "video", 3)
    )
    rows = rows.withColumn("score", both + F.when(image, of_image).otherwise(of_video))
    matches = lambda pattern: F.coalesce(F.expr(f"regexp_like(url, {pattern})"), F.lit(False))
    reason = (
        F.when(image & (matches("pattern") | matches("own_pattern")), "preview_or_thumbnail")
        .when(F.col("expected") == F.when(image, "video").otherwise("image"), "wrong_media_type_for_domain")
        .when(F.col("__layout"), "layout_decoration")
        .when(image & ((F.col("width") < 300) | (F.col("height") < 300)), "low_resolution")
        .when(F.col("__off") & (~image | (F.col("__high") == url)), "low_subject_relevance")
        .when(image & u.any_of(text, v.UTILITY_TERMS), "generic_asset")
        .when(F.col("__placeholder"), "placeholder_asset")
        .when(penalty >= 6, "preview_or_thumbnail")
        .when(image & (u.has_small_parameter(url, 300) | u.has_small_path(url, 300, 250)), "low_resolution_hint")
        .when(~F.col("__subject"), "low_subject_relevance")
        .when(F.col("score") < 1, "low_score")
    )
    return rows.withColumn("reason", reason).select(*items.columns, "score", "reason")


def first_per_key(rows: DataFrame, key: Column | str, seq: str = "seq") -> DataFrame:
    """The row with the smallest seq of each key: an aggregation that combines before the shuffle, so hot keys do no harm."""
    key = F.col(key) if isinstance(key, str) else key
    whole = F.struct(F.col(seq).alias("__seq"), *[F.col(c) for c in rows.columns])
    return rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rows.columns), F.struct(F.col(seq), F.xxhash64(whole))).alias("row")).select("row.*")


def upgraded(rows: DataFrame) -> DataFrame:
    """One row per media key with the best variant's URL (D1, D2); rows and position are those of the first.

    Images: a full picture before a thumbnail, then a URL with a query. Videos: more lines, then a query. Of equal
    ones the first. Order-dependent upgrades of a single pass become one comparison, so the result doesn't depend on
    how rows are dealt.
    """
    url = F.col("url")
    has_query = F.when(u.query(url) != "", 1).otherwise(0)
    rank = F.when(F.col("kind") == "video", u.video_lines(url)).otherwise(F.when(u.is_thumbnail(url), 0).otherwise(1))
    best = F.max_by("url", F.struct(rank.alias("a"), has_query.alias("b"), (-F.col("seq")).alias("c")))
    keyed = rows.groupBy(u.media_key(url).alias("media_key"))
    return keyed.agg(F.min("seq").alias("seq"), F.min_by("kind", "seq").alias("kind"), best.alias("url"), F.count("*").alias("variants"))


def ranked(rows: DataFrame, score: str, subject: str, partition: str, seq: str = "seq") -> DataFrame:
    w = W.partitionBy(partition).orderBy(F.desc(score), F.desc(subject), F.asc(seq))
    return rows.withColumn("rank", F.row_number().over(w))


def bytes_reason(width: Column, height: Column, size: Column, kind: Column) -> Column:
    least = F.when(kind == "video", v.MIN_VIDEO_BYTES).otherwise(v.MIN_IMAGE_BYTES)
    return F.when(size < least, "too_small").when((kind == "image") & (width.isNull() | height.isNull()), "unknown_dimensions").when((kind == "image") & ((width < v.MIN_WIDTH) | (height < v.MIN_HEIGHT)), "low_resolution")


def content_reason(url: Column, size: Column, content: Column, width: Column, height: Column, kind: Column, dead: Column, least_width: Column | None = None, least_height: Column | None = None) -> Column:
    """First gate that a download fails; null lets it pass.

    Known dead addresses, then size, then what the first bytes say it is (a stream manifest has none), then dimensions
    below the usual least or that of the host's profile, whichever is larger.
    """
    found = signature(content)
    expected = F.when(kind == "video", found.isin("mp4", "webm", "ogg", "avi")).otherwise(found.isin("jpeg", "png", "gif", "webp", "avif"))
    wide, high = (F.greatest(F.lit(n), F.coalesce(own, F.lit(n)) if own is not None else F.lit(n)) for n, own in ((v.MIN_WIDTH, least_width), (v.MIN_HEIGHT, least_height)))
    least = F.when(kind == "video", v.MIN_VIDEO_BYTES).otherwise(v.MIN_IMAGE_BYTES)
    return (
        F.when(F.coalesce(dead, F.lit(False)), "dead_url")
        .when(u.is_stream_manifest(url), F.lit(None).cast("string"))
        .when(size < least, "too_small")
        .when(~F.coalesce(expected, F.lit(False)), "signature_mismatch")
        .when((kind == "image") & (width.isNull() | height.isNull()), "unknown_dimensions")
        .when((kind == "image") & ((width < wide) | (height < high)), "low_resolution")
    )


def signature(content: Column) -> Column:
    """File type by its first bytes (fixed values)."""
    h = F.hex(F.substring(content, 1, 16))
    return (
        F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("47494638"), "gif")
        .when(h.rlike("^52494646.{8}57454250"), "webp").when(h.rlike("^.{8}6674797061766966"), "avif").when(h.rlike("^.{8}66747970"), "mp4")
        .when(h.startswith("1A45DFA3"), "webm").when(h.startswith("4F676753"), "ogg").when(h.rlike("^52494646.{8}41564920"), "avi")
    )


def near_pairs(hashes: DataFrame, key: str, bits: str, distance: int = 4) -> DataFrame:
    """Pairs of 64-bit hashes that differ in `distance` bits or fewer: bands of bits by the pigeonhole, then the exact test."""
    n = distance + 1
    edges = [64 * k // n for k in range(n + 1)]
    bands = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(F.shiftleft(F.col(bits), 64 - edges[k + 1]), 64 - edges[k + 1] + edges[k]).alias("value")) for k in range(n)]
    rows = hashes.select(F.col(key).alias("id"), F.col(bits).alias("bits"), F.explode(F.array(*bands)).alias("b")).select("id", "bits", "b.band", "b.value")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.id") < F.col("b.id"))
    apart = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits")))
    return a.join(b, same).where(apart <= distance).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), apart.alias("distance")).distinct()
