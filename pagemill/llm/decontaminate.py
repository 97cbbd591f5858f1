"""Benchmark decontamination with SimHash windows of the items' sizes.

A document is compared with an item by windows of the item's length in words. A window can only reach the similarity
if it holds a certain number of the item's shingles, so where a document has an item's shingles is looked up first, and
only windows with that many of them are candidates of the item; no other can be alike. Each such window gets a SimHash
fingerprint from its shingles, repeats counted. A multi-index has RADIUS + 1 blocks of bits: two fingerprints that
differ in RADIUS bits or fewer agree in one block at least, so a candidate goes on if a block agrees and the distance is
within the radius. It is verified by the exact similarity of the two multisets of shingles (sum of the smaller counts
over sum of the larger). Shingles are hashed with XXH64, so fingerprints and distances are the same in every process.

The similarity of 0.8 asks for 8 / 9 of the shingles in common where both have equally many; fingerprints then differ
in 10 bits of 64 on average, with a deviation of 3, so the radius of 28 is six deviations away.

The items are the stated query set: they are taken in blocks of at most BLOCK_BYTES of text, each sent to all
executors, so what is broadcast doesn't grow with the benchmark. The documents are read once a block, not shuffled; with
several blocks the rows are checkpointed after each, so one block is held at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from .common import cut, slices
from .shards import mix

WORDS, SIMILARITY, RADIUS = 5, 0.8, 28
BLOCK_BYTES = 16 << 20
_WORD = re.compile(r"\w+")
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(64)], np.uint64)
_LEAKS = "array<struct<item_id:bigint,similarity:double,distance:int,start:int,end:int>>"


def tokens(text: str) -> list[str]:
    """Words as they are compared: without case and punctuation."""
    return _WORD.findall(text.casefold())


def shingles(words: list[str], size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += mix(h[k : k + n] + np.uint64(k)) * _FACTORS[k]
    return mix(out)


def fingerprints(h: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every window of `width` neighbouring shingles."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits((sums[width:] - sums[:-width]) * 2 > width, axis=1).view(">u8").ravel().astype(np.uint64)


@dataclass
class Item:
    item_id: int
    words: int
    counts: Counter
    fingerprint: int


class Items:
    """The items of a block by shingle, and the blocks of bits of the multi-index."""

    def __init__(self, rows: list[tuple[int, str]], size: int, radius: int):
        self.size, self.radius = size, radius
        self.items: list[Item] = []
        h, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for item_id, text in rows:
            words = tokens(text)
            if words:
                s = shingles(words, size)
                h.append(s)
                owner.append(np.full(len(s), len(self.items)))
                self.items.append(Item(item_id, len(words), Counter(s.tolist()), int(fingerprints(s, len(s))[0])))
        h, owner = np.concatenate(h), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        self.h, self.owner = h[order], owner[order]
        self.short = min((x.words for x in self.items if x.words < size), default=0)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.h >> np.uint64(44)).astype(np.int64)] = True
        self.lengths = np.array([x.words for x in self.items], np.int64)
        self.totals = np.array([x.counts.total() for x in self.items], np.int64)
        parts = np.array_split(np.arange(64), radius + 1)
        self.blocks = np.array([sum(1 << int(bit) for bit in part) for part in parts], np.uint64)

    def near(self, i: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which fingerprints agree with item i in a block and lie within the radius, and all distances."""
        apart = prints ^ np.uint64(self.items[i].fingerprint)
        distance = np.bitwise_count(apart)
        return ((apart[:, None] & self.blocks[None, :]) == 0).any(axis=1) & (distance <= self.radius), distance

    def leaks(self, text: str, least: float) -> list[dict]:
        """For each item that a window of the text is similar to: its best window, the first of equal ones."""
        words = tokens(text)
        if not words or not self.items:
            return []
        best: dict[int, tuple[float, int, int, int]] = {}
        for size in {self.size, *(int(x) for x in self.lengths if x < self.size)}:
            h = shingles(words, size)
            at = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
            if len(at) == 0:
                continue
            left, right = np.searchsorted(self.h, h[at]), np.searchsorted(self.h, h[at], side="right")
            hit = right > left
            at, left, right = at[hit], left[hit], right[hit]
            if len(at) == 0:
                continue
            owners = self.owner[np.concatenate([np.arange(a, b) for a, b in zip(left, right, strict=True)])]
            where = np.repeat(at, right - left)
            for i, at in self._asked(owners, where, size, len(h), least):
                self._windows(h, at, i, size, least, best)
        return [{"item_id": self.items[i].item_id, "similarity": s, "distance": d, "start": a, "end": min(b, len(words))} for i, (s, d, a, b) in sorted(best.items())]

    def _width(self, i, size: int, n: int):
        """Shingles of a window for item i, in a text of n of them."""
        return np.minimum(np.maximum(1, self.lengths[i] - size + 1), n)

    def _asked(self, owners: np.ndarray, where: np.ndarray, size: int, n: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """(item, starts of windows that hold as many of its shingles as the similarity asks for)."""
        fits = (self.lengths[owners] >= self.size) if size == self.size else self.lengths[owners] == size
        owners, where = owners[fits], where[fits]
        order = np.lexsort((where, owners))
        owners, where = owners[order], where[order]
        if len(owners) == 0:
            return
        width = self._width(owners, size, n)
        # shared / (width + total - shared) >= least; a little below, so that rounding loses nothing
        need = np.maximum(1, np.ceil(least * (width + self.totals[owners]) / (1 + least) - 1e-9)).astype(np.int64)
        last = np.arange(len(owners)) + need - 1
        hit = np.flatnonzero(last < len(owners))
        hit = hit[(owners[last[hit]] == owners[hit]) & (where[last[hit]] - where[hit] < width[hit])]
        for i in np.unique(owners[hit]).tolist():
            own = hit[owners[hit] == i]
            w = int(width[own[0]])
            low, high = np.clip(where[last[own]] - w + 1, 0, n - w), np.clip(where[own], 0, n - w)
            size_of = high - low + 1
            starts = np.repeat(low - (np.cumsum(size_of) - size_of), size_of) + np.arange(size_of.sum())
            yield i, np.unique(starts)

    def _windows(self, h: np.ndarray, at: np.ndarray, i: int, size: int, least: float, best: dict) -> None:
        item, width = self.items[i], int(self._width(i, size, len(h)))
        for group in np.split(at, np.flatnonzero(np.diff(at) > width) + 1):
            for k in range(0, len(group), 65536):
                part = group[k : k + 65536]
                prints = fingerprints(h[part[0] : part[-1] + width], width)[part - part[0]]
                near, distance = self.near(i, prints)
                for a, d in zip(part[near].tolist(), distance[near].tolist(), strict=True):
                    own = Counter(h[a : a + width].tolist())
                    shared = sum(min(n, item.counts[x]) for x, n in own.items() if x in item.counts)
                    similarity = shared / (own.total() + item.counts.total() - shared)
                    if similarity >= least and (i not in best or similarity > best[i][0]):
                        best[i] = (similarity, d, a, a + item.words)


@lru_cache(maxsize=2)
def _items(rows: tuple, size: int, radius: int) -> Items:
    return Items(list(rows), size, radius)


def flag(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """The input with `leaks` added: an array of (item_id, similarity, distance in bits, start and end word), by item.

    Clean documents, and null and empty texts, have an empty array. Items without words, or with a null id, match
    nothing; repeated items are reported each. A text shorter than an item is one window. An input column named leaks
    is replaced.
    """
    source = docs.drop("leaks") if "leaks" in docs.columns else docs
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (BLOCK_BYTES // 2)))
    out = source.withColumn("leaks", F.expr(f"cast(array() as {_LEAKS})"))
    at = source.columns.index(text)
    schema = StructType([*source.schema.fields, StructField("leaks", out.schema["leaks"].dataType)])
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted((r["item_id"], r["t"]) for r in rows)))
        out = out.mapInArrow(_run(shared, at, similarity, words, radius), schema)
        if k < blocks - 1:
            out = cut(out)
            shared.unpersist()
    return out


def _run(shared, at: int, similarity: float, words: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared.value, words, radius)
        for batch in batches:
            for part in slices(batch, batch.schema.names[at], 4 << 20):
                found = [old + items.leaks(x or "", similarity) for x, old in zip(part.column(at).to_pylist(), part.column(len(part.columns) - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, part.schema.types[-1])], names=part.schema.names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document row and leaked item: `key`, item_id, similarity, distance, start, end."""
    flagged = flag(docs.select(key, F.col(options.get("text", "text"))), benchmark, **options)
    return flagged.select(key, F.explode("leaks").alias("leak")).select(key, "leak.*")
