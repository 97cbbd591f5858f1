"""Exchange of window hashes between document shards and key shards.

Documents are dealt once to document shards by a hash of the row. A document shard folds what it holds of a key (a
window's hash) into one entry before anything is sent, so a key that stands in a third of all documents costs one
entry a shard. Entries go to key shards as packed arrays, sorted by key, and the answers come back as bit masks and
values in the same order: the document shard makes the same sorted arrays again, so no key travels twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, shards

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= _K3
    x ^= x >> np.uint64(29)
    return x


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of a window from the hashes of its two halves, which may overlap."""
    return mix(a * _K1 + b * _K2 + np.uint64(salt * 0x5851F42D4C957F2D & (2**64 - 1)))


def slid(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every `width` neighbours, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a = pick(a[:-step], a[step:])
        reach += step
    return a


def minimizers(h: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, chosen): the lowest of h in each window of `width` positions (0: not valid), and which positions are one.

    Equal windows choose equal hashes at equal places, ties included.
    """
    lowest = np.where(valid, slid(h, width, np.minimum), np.uint64(0))
    gap = np.zeros(width - 1, np.uint64)
    return lowest, slid(np.concatenate([gap, lowest, gap]), width, np.maximum) == h


def folded(keys: np.ndarray, ids: np.ndarray, check: np.ndarray | None = None):
    """Distinct keys (with check) in order, and each one's smallest id and whether it has several ids."""
    order = np.argsort(keys, kind="stable") if check is None else np.lexsort((check, keys))
    keys, ids = keys[order], ids[order]
    if len(keys) == 0:
        return keys, check, ids, np.empty(0, bool)
    new = keys[1:] != keys[:-1]
    if check is not None:
        check = check[order]
        new |= check[1:] != check[:-1]
    starts = np.flatnonzero(np.concatenate([[True], new]))
    low, high = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
    return keys[starts], None if check is None else check[starts], low, low != high


def bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each key shard's share of the sorted keys starts; one more than there are shards."""
    edges = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def dealt(docs: DataFrame, key: str, text: str, fine: int = 1) -> tuple[DataFrame, int]:
    """(shard, id, text) dealt to document shards, and how many there are.

    `fine` times as many shards as shuffle partitions. Packed arrays go from every document shard to every key
    shard, as in any shuffle, so their number grows with the square: more shards than partitions cost more than they
    even out. A
    null id becomes the largest one.
    """
    spark = docs.sparkSession
    n = fine * shards(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    return rows.repartition(shards(spark), "shard"), n


def rows_of(table: pa.Table, limit: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts) of runs of rows of about `limit` bytes; null texts are empty."""
    ids = table.column("id").to_numpy()
    at, held, out = 0, 0, []
    for chunk in table.column("text").chunks:
        for x in chunk:
            out.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
            held += len(out[-1])
            if held >= limit:
                yield ids[at : at + len(out)], out
                at, held, out = at + len(out), 0, []
    if out:
        yield ids[at:], out
