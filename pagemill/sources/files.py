"""Rule files, caches, target lists and log streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def rules(spark: SparkSession, path: str) -> dict:
    """A JSON rule file (small, one object); a missing or broken one has no rules."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True).collect()
        value = json.loads(rows[0]["value"]) if rows else {}
    except (AnalysisException, ValueError):
        return {}
    return value if isinstance(value, dict) else {}


def rewrite_rules(value: dict) -> list[tuple[str, str]]:
    """(pattern, replacement) pairs of a rule file, in order; those without a pattern are left out."""
    return [(r["pattern"], r.get("replacement", "")) for r in value.get("rules", ()) if r.get("pattern")]


def cached(spark: SparkSession, folder: str, now, seconds: int = 3600) -> DataFrame:
    """key (the file's name, the SHA-256 of its URL), modificationTime and body of a page cache's fresh entries."""
    files = spark.read.format("binaryFile").load(folder)
    fresh = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("modificationTime") <= seconds
    return files.where(fresh).select(F.regexp_extract("path", "([^/]*)$", 1).alias("key"), "modificationTime", F.col("content").cast("string").alias("body"))


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """name and path of the target lists (*.txt) of a folder, by path; underscores in a name stand for spaces."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.replace(F.regexp_extract("path", r"([^/]*)\.txt$", 1), F.lit("_"), F.lit(" ")).alias("name"), "path").orderBy("path")


def log_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """value: the lines of a folder's files as a stream, so many files a trigger."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder)
