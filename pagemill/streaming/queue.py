"""Queues of media and downloads as micro-batches, and the watch cycle over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions import urls as u
from pagemill.operators.media import first_per_key


def media_batches(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 1000) -> DataFrame:
    """A folder of JSON records as a stream; the files a trigger takes are the queue's bound."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def deduplicated_sink(stream: DataFrame, out: str, checkpoint: str, key: str = "url", once: bool = True) -> StreamingQuery:
    """Appends to a Parquet table the rows whose media key (of `key`) it doesn't hold yet; the first of a batch by seq.

    A batch that comes again after a failure replaces its own folder, so each row is there once.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = first_per_key(batch, u.media_key(F.col(key))).withColumn("media_key", u.media_key(F.col(key)))
        try:
            known = spark.read.parquet(out).where(F.col("batch") < number).select("media_key")
            new = new.join(known, "media_key", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch_cycle(targets: list[str], run: Callable[[str], int], prune: Callable[[], None], cycles: int, start: int = 0, every: int = 5, least: float = 1.0, most: float = 60.0) -> list[dict]:
    """Cycles over targets in turn: run one, prune every few, and the pause that the yields ask for before the next.

    The pause is returned, not slept: the trigger of the caller's stream or scheduler keeps time.
    """
    from .machines import backoff

    out, yields = [], []
    for k in range(start, start + cycles if targets else start):
        target = targets[k % len(targets)]
        yields.append(run(target))
        if (k + 1) % every == 0:
            prune()
        out.append({"cycle": k, "target": target, "found": yields[-1], "pruned": (k + 1) % every == 0, "pause": backoff(yields, least, most)[-1]})
    return out


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, modificationTime) that are new or newer than before: what a hot reload reads again."""
    old = before.select("path", F.col("modificationTime").alias("__before"))
    rows = after.join(old, "path", "left").where("__before is null or modificationTime > __before")
    return rows.drop("__before")
