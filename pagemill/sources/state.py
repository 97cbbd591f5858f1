"""State kept between runs (processed and dead URLs, picture hashes) as Parquet in any store that Spark writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMAS = {
    "processed_urls": "url_hash string, url string, ts timestamp",
    "dead_urls": "url_hash string, url string, status int, ts timestamp",
    "hashes": "dhash bigint, subject string, ts timestamp",
}
_KEYS = {"processed_urls": "url_hash", "dead_urls": "url_hash", "hashes": "dhash"}


class StateStore:
    """Tables under one folder. A change writes a new version and then a pointer to it: readers see a whole version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _current(self, table: str) -> str | None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/current")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.text(path.toString()).first()["value"] if fs.exists(path) else None

    def load(self, table: str) -> DataFrame:
        version = self._current(table)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}/{version}")

    def _replace(self, table: str, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{table}/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{table}/current")

    def upsert(self, table: str, rows: DataFrame) -> None:
        """The latest row of each key stays."""
        rows = self.load(table).unionByName(rows)
        columns = rows.columns
        latest = rows.groupBy(_KEYS[table]).agg(F.max_by(F.struct(*columns), F.struct("ts", F.xxhash64(*columns))).alias("r"))
        self._replace(table, latest.select("r.*"))

    def insert_absent(self, table: str, rows: DataFrame) -> None:
        """Keys already there keep their row, whatever the other columns say."""
        key = _KEYS[table]
        old = self.load(table)
        first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), "ts").alias("r")).select("r.*")
        self._replace(table, old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns)))

    def known(self, table: str, rows: DataFrame) -> DataFrame:
        """rows with `known`: whether their key is in the table."""
        key = _KEYS[table]
        there = self.load(table).select(F.col(key).alias("__key")).distinct()
        return rows.join(there, F.col(key) == F.col("__key"), "left").withColumn("known", F.col("__key").isNotNull()).drop("__key")

    def prune(self, table: str, before) -> int:
        """Drops rows older than a time; how many there were."""
        rows = self.load(table)
        old = rows.where(F.col("ts") < F.lit(before)).count()
        if old:
            self._replace(table, rows.where(F.col("ts") >= F.lit(before)))
        return old

    def clear_domain(self, domain: str) -> None:
        """Forgets every URL that holds the domain's name."""
        for table in ("processed_urls", "dead_urls"):
            self._replace(table, self.load(table).where(~F.contains(F.lower("url"), F.lit(domain.lower()))))

    def flush(self) -> None:
        """Forgets processed and dead URLs; picture hashes stay."""
        for table in ("processed_urls", "dead_urls"):
            self._replace(table, self.load(table).limit(0))

    def flush_hashes(self, subject: str) -> None:
        self._replace("hashes", self.load("hashes").where(F.col("subject") != subject))

    def stats(self) -> dict[str, int]:
        return {table: self.load(table).count() for table in SCHEMAS}
