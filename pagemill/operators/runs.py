"""Summaries within and across runs, targets, and joins of files with what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result documents (one JSON object a file) of all runs that a path pattern names, with run_path."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("run_path", F.col("_metadata.file_path"))


def totals(runs: DataFrame) -> DataFrame:
    """One row: runs, images, videos and pages of (run_id, images, videos, pages)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("images", "videos", "pages")]
    return runs.agg(F.count_distinct("run_id").alias("runs"), *sums)


def latest(runs: DataFrame, by: str = "subject") -> DataFrame:
    """The figures of each subject's last run, by run_id; an aggregation that combines before the shuffle."""
    names = [c for c in runs.columns if c not in (by, "run_id")]
    last = F.max_by(F.struct(*names), "run_id")
    return runs.groupBy(by).agg(F.max("run_id").alias("run_id"), last.alias("x")).select(by, "run_id", "x.*")


def harvest(runs: DataFrame, least: int) -> DataFrame:
    """Runs with their harvest, and whether it reaches the threshold."""
    n = F.coalesce("images", F.lit(0)) + F.coalesce("videos", F.lit(0))
    return runs.select("run_id", n.cast("long").alias("harvest"), (n >= least).alias("enough"))


def runtime_split(total: Column, crawl: Column, download: Column) -> Column:
    """Seconds that neither crawl nor download accounts for, never below none."""
    return F.greatest(F.lit(0.0), total - crawl - download)


def domain_yield(reports: DataFrame, host: str = "host") -> DataFrame:
    """kept for each page of a host; hosts with over 20 pages and under a fiftieth kept are deprioritised."""
    rows = reports.groupBy(host).agg(F.sum("kept").cast("long").alias("kept"), F.sum("pages").cast("long").alias("pages"))
    ratio = F.when(F.col("pages") > 0, F.col("kept") / F.col("pages"))
    return rows.withColumn("ratio", ratio).withColumn("low", F.coalesce((F.col("pages") > 20) & (ratio < 0.02), F.lit(False)))


def expected_types(profiles: DataFrame) -> DataFrame:
    """One row: the media types that profiles ask for, sorted, and what they amount to (mixed if both)."""
    rows = profiles.agg(F.array_sort(F.collect_set("media_type")).alias("types"))  # of three values
    has = lambda x: F.array_contains("types", x)
    kind = F.when(has("mixed") | (has("image") & has("video")), "mixed").when(has("image"), "image").when(has("video"), "video")
    return rows.withColumn("expected", kind)


def target_met(images: Column, videos: Column, pages: Column, most: int, expected: Column | None = None) -> Column:
    """Whether a run has what it was after: `most` of each expected kind (0: no target).

    Where profiles don't say (expected null), both kinds are, but one will do when three pages held none of the other.
    """
    if most <= 0:
        return F.lit(False)
    enough_images, enough_videos = images >= most, videos >= most
    open_ = (enough_images & enough_videos) | ((pages >= 3) & ((enough_images & (videos == 0)) | (enough_videos & (images == 0))))
    if expected is None:
        return open_
    by_kind = ((expected == "video") | enough_images) & ((expected == "image") | enough_videos)
    return F.when(expected.isNull(), open_).otherwise(by_kind)


def duplicate_skips(rejects: DataFrame, host: str = "host") -> DataFrame:
    return rejects.groupBy(host).agg(F.count_if(F.contains(F.lower("reason"), F.lit("duplicate"))).alias("duplicates"))


def dead_downloads(items: DataFrame) -> DataFrame:
    """Items whose failure says that the file cannot be had."""
    why = F.coalesce("failure_reason", F.lit(""))
    return items.where(why.startswith("download_failed") | why.startswith("download_error") | F.contains(why, F.lit("exception")))


def seed_stats(seeds: DataFrame) -> DataFrame:
    """file, urls, hosts and the sorted distinct hosts of seed files (file, host)."""
    once = seeds.groupBy("file", "host").agg(F.count("*").alias("n"))
    return once.groupBy("file").agg(F.sum("n").cast("long").alias("urls"), F.count("*").alias("hosts"), F.array_sort(F.collect_list("host")).alias("names"))


def aesthetic_breakdown(scored: DataFrame, least: float) -> DataFrame:
    """One row: files, and those that pass and fail the least score (M6 keeps those that pass)."""
    return scored.agg(F.count("*").alias("total"), F.count_if(F.col("score") >= least).alias("passed"), F.count_if(F.col("score") < least).alias("rejected"))


def folder_size(files: DataFrame, folder: Column) -> DataFrame:
    return files.groupBy(folder.alias("folder")).agg(F.sum("length").cast("long").alias("bytes"))


def with_metadata(files: DataFrame, metadata: DataFrame, key: str = "file_name") -> DataFrame:
    """Files with their metadata; those without keep nulls."""
    return files.join(metadata, key, "left")


def exported(files: DataFrame, results: DataFrame) -> DataFrame:
    """Exported files (path) with the domain of the result they came from; else the name of the folder they lie in."""
    known = results.select(F.col("file_path").alias("path"), F.col("source_domain").alias("__domain"))
    parent = F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    return files.join(known, "path", "left").select(*files.columns, F.coalesce("__domain", parent).alias("source_domain"))


def flagged_seeds(items: DataFrame, seeds: DataFrame, page: str = "source_page") -> DataFrame:
    """Items with is_seeded: whether their page is a seed."""
    known = seeds.select(F.col("url").alias("__seed")).distinct()
    return items.join(known, F.col(page) == F.col("__seed"), "left").select(*items.columns, F.col("__seed").isNotNull().alias("is_seeded"))


def first_results(results: DataFrame, most: int, order: tuple[str, ...] = ("provider", "rank"), key: str = "url") -> DataFrame:
    """Results of several providers as one list: each URL at its first place, the first `most` of them (0: all)."""
    once = results.groupBy(key).agg(F.min(F.struct(*order)).alias("place")).select(key, "place.*").orderBy(*order, key)
    return once.limit(most) if most > 0 else once


def frontier_order(frontier: DataFrame) -> DataFrame:
    """The frontier in the order it is worked off: depth, retries, then arrival."""
    return frontier.orderBy("depth", "retry", "seq")


def dead_rejects(frontier: DataFrame, dead: DataFrame) -> DataFrame:
    """Frontier entries that are known dead, as rejects."""
    return frontier.join(dead.select("url").distinct(), "url", "left_semi").select("url", F.lit("404_negative_cache").alias("reason"))


def less(urls: DataFrame, *others: DataFrame, key: str = "url") -> DataFrame:
    """The URLs in none of the others."""
    for other in others:
        urls = urls.join(other.select(key), key, "left_anti")
    return urls


def common(urls: DataFrame, other: DataFrame, key: str = "url") -> DataFrame:
    """The distinct URLs in both."""
    return urls.select(key).intersect(other.select(key))


def training_export(images: DataFrame, least_side: int, least_score: float, distance: int = 4, folder: str = "1_concept") -> DataFrame:
    """Images (path, width, height, dhash, score, tags) for a training set, in the order the filters have.

    Small ones go first (both sides below the least), then, in order of path, those near an earlier kept one, then those
    below the score: a poor picture still stands for its near copies. Pictures without a hash are near nothing. Adds
    where each one goes in the archive and its caption.
    """
    from .images import greedy_unique
    from .media import near_pairs

    wide = images.where(~((F.col("width") < least_side) & (F.col("height") < least_side)) | F.col("width").isNull() | F.col("height").isNull())
    hashed = wide.where("dhash is not null").select("path", "dhash")
    kept = greedy_unique(near_pairs(hashed, "path", "dhash", distance), hashed, "path").select("path")
    unique = wide.join(kept, "path", "left_semi").unionByName(wide.where("dhash is null"))
    good = unique.where(F.col("score") >= least_score) if least_score > 0 else unique
    name = F.regexp_extract("path", "([^/]*)$", 1)
    caption = F.array_join(F.transform("tags", lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("_"))), ", ")
    return good.select("path", F.concat(F.lit(f"{folder}/"), name).alias("archive_path"), F.concat(F.lit(f"{folder}/"), F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".txt")).alias("caption_path"), caption.alias("caption"))
