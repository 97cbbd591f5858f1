"""Shared plumbing of the training-data operators: table access, lineage cuts and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagemill.session import Scratch, checkpointed as cut, delete, shared_dir, ship

#: Stands in for a null document id where ids are compared: such rows come after every other.
NO_ID = 2**63 - 1

__all__ = ["NO_ID", "Scratch", "cut", "delete", "shards", "shared_dir", "slices", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession) -> int:
    """How many shards the keyed exchanges use: what the cluster's owner sized the shuffles for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string or binary Arrow column as UTF-8 bytes per row."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about `limit` bytes of `column`; a longer row is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
