"""What a session needs before the engine's Python functions run on its executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, late ones included; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_pagemill", None) is None:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="pagemill-")) / "pagemill.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
        context._pagemill = str(target)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where the session names none, a local folder is made if all runs on this machine (as in tests); a cluster is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", named)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one operator, written in a folder of the shared one and read again; all are gone when the `with` ends.

    One job makes a table, where a checkpoint makes its rows twice. A read takes the columns that are needed, in as many
    tasks as the bytes ask for, and joins know the table's size, so a small one is broadcast at once. Neither the order
    of the rows nor their partitions are kept; where these matter, or for rows that outlive the operator, take `checkpointed`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.named = spark, f"{shared_dir(spark)}/pagemill-scratch-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.folder)

    def __call__(self, rows: DataFrame, name: str | None = None) -> DataFrame:
        """The rows as a table; it takes the place of an earlier one of this name, which goes."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        if name:
            if old := self.named.get(name):
                delete(self.spark, old)
            self.named[name] = path
        return self.spark.read.schema(rows.schema).parquet(path)


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows with their lineage ended by a reliable checkpoint in the shared folder.

    A checkpoint keeps the optimizer's size estimate of the plan behind it, and joins multiply such estimates: over the
    rounds of an iteration they grow to numbers of millions of digits, which cost the driver more than all else. So the
    checkpoint's rows are taken up as a new source without an estimate.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    done = rows.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)
