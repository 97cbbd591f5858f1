"""Substring dedup of word windows by level-wise doubling.

A window of `window` words is removed from a document if the same words also start in a document with a smaller id.
Whether a window is repeated is settled level by level: windows of half the length first, and only those that
are repeated in another document are extended to twice that length. Of the half-length windows only the
minimizers (the lowest hash in each full window) are asked about: equal full windows have equal minimizers, so a full
window whose minimizer is not repeated cannot be either. A level's hashes come from the last level's by pairing a
window with the one that follows it (or overlaps it, where the target is no power of two).

These hashes only decide what is extended. A full window is known by the 128 bits of the XXH3 digest of its words'
bytes, so windows count as equal if their words are.

The levels end at `window`: a longer repeat is covered by its windows of that length, so extending further would
remove no other word. A level without survivors sends nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID
from .shards import bounds, dealt, folded, minimizers, mix, pair, rows_of

#: Text bytes hashed at a time.
SLICE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Keeps the first bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ENTRIES = "key int, shard int, kind int, keys binary, checks binary, ids binary, several binary"
_ANSWERS = "shard int, key int, kind int, mask binary, ids binary"


class Words:
    """The words of some documents and the hashes of their windows of half the length."""

    def __init__(self, texts: list[bytes], window: int):
        self.raw = b" ".join([b"", *texts, b" " * 16])
        data = np.frombuffer(self.raw, np.uint8)
        space = _SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = starts, ends = edges[::2], edges[1::2]
        self.n = len(starts)
        self.first = np.searchsorted(starts, np.cumsum([1, *(len(x) + 1 for x in texts)]))  # each document's first word
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.odd = np.cumsum(np.concatenate([[0], (starts[1:] - ends[:-1] != 1) | (data[ends[:-1]] != 32)]))  # gaps but one space
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        size = ends - starts
        h = pair(eight[starts] & _FIRST[np.minimum(size, 8)], eight[starts + 8 - (size < 8) * 8] & _FIRST[np.clip(size - 8, 0, 8)])
        h = mix(h + size.astype(np.uint64))
        long = np.flatnonzero(size > 16)
        h[long] = [xxhash.xxh3_64_intdigest(self.raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        self.window, half = window, (window + 1) // 2
        length = 1
        while length < half:  # doubling, the last step overlapping
            step = min(length, half - length)
            h = pair(h[: max(0, len(h) - step)], h[step:], length + step)
            length += step
        self.half = h
        full = max(0, self.n - window + 1)
        self.valid = self.doc[:full] == self.doc[self.n - full :]
        step = window - half
        if full:
            lowest, chosen = minimizers(h, self.valid, step + 1)
            # a minimizer is a low hash: mixed again, its keys are spread evenly over the key shards
            self.lowest, self.asked = mix(lowest), np.flatnonzero(chosen)
        else:
            self.lowest, self.asked = np.empty(0, np.uint64), np.empty(0, np.int64)

    def extended(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of the full windows at the given positions, in two halves."""
        last, raw = at + self.window - 1, self.raw
        plain = self.odd[last] == self.odd[at]
        cut = zip(self.starts[at].tolist(), self.ends[last].tolist(), plain.tolist(), strict=True)
        digests = b"".join([xxhash.xxh3_128_digest(raw[a:b] if one else b" ".join(raw[a:b].split())) for a, b, one in cut])
        halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        return halves[:, 0].copy(), halves[:, 1].copy()


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


_ENTRY_SCHEMA = pa.schema([("key", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary()), ("several", pa.binary())])
_ANSWER_SCHEMA = pa.schema([("shard", pa.int32()), ("key", pa.int32()), ("kind", pa.int32()), ("mask", pa.binary()), ("ids", pa.binary())])


def _first_level(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct minimizers of a document shard, in order, and whether each is in several of its documents."""
    keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for ids, texts in rows_of(table, SLICE):
        w = Words(texts, window)
        keys.append(mix(w.half[w.asked]))
        owners.append(ids[w.doc[w.asked]])
    keys, _, _, several = folded(np.concatenate(keys), np.concatenate(owners))
    return keys, several


def _alive_windows(table: pa.Table, window: int, keys: np.ndarray, alive: np.ndarray) -> Iterator[tuple]:
    """By slice of a document shard: places and digests of the full windows whose minimizer is alive, and their owners."""
    for ids, texts in rows_of(table, SLICE):
        w = Words(texts, window)
        at = _candidates(w, keys, alive)
        yield at, *w.extended(at), ids[w.doc[at]]


def _second_level(windows: list[tuple]):
    """Distinct full windows with check, smallest id and whether several documents have it."""
    found = np.concatenate([np.empty(0, np.uint64), *(x[1] for x in windows)])
    checks = np.concatenate([np.empty(0, np.uint64), *(x[2] for x in windows)])
    return folded(found, np.concatenate([np.empty(0, np.int64), *(x[3] for x in windows)]), checks)


def _candidates(w: Words, keys: np.ndarray, alive: np.ndarray) -> np.ndarray:
    if len(keys) == 0 or len(w.lowest) == 0:
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, w.lowest), len(keys) - 1)
    return np.flatnonzero(w.valid & alive[at] & (keys[at] == w.lowest))


def _entries(shard: int, kind: int, parts: int, keys: np.ndarray, checks, low, several) -> pa.Table:
    edges = bounds(keys, parts)
    some = np.flatnonzero(np.diff(edges))
    cut = [(edges[p], edges[p + 1]) for p in some]
    columns = [
        pa.array(some.astype(np.int32)),
        pa.array(np.full(len(some), shard, np.int32)),
        pa.array(np.full(len(some), kind, np.int32)),
        # the first level is a filter, so half of the bits (and the shard, which other bits choose) are enough
        pa.array([(keys[a:b] if kind == 2 else keys[a:b].astype(np.uint32)).tobytes() for a, b in cut], pa.binary()),
        pa.array([b"" if checks is None else checks[a:b].tobytes() for a, b in cut], pa.binary()),
        pa.array([b"" if low is None else low[a:b].tobytes() for a, b in cut], pa.binary()),
        pa.array([np.packbits(several[a:b]).tobytes() for a, b in cut], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, schema=_ENTRY_SCHEMA)


def _unpacked(mask: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)


def _repeated(table: pa.Table) -> pa.Table:
    """Key shard, first level: which entries' keys are in more than one document."""
    if table.num_rows == 0:
        return _empty(_ANSWER_SCHEMA)
    blobs = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    sizes = [len(x) for x in blobs]
    several = np.concatenate([_unpacked(x, n) for x, n in zip(table["several"].to_pylist(), sizes, strict=True)])
    keys = np.concatenate(blobs)
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts > 1
    again[at[several]] = True
    masks = [np.packbits(x).tobytes() for x in np.split(again[at], np.cumsum(sizes)[:-1])]
    n = table.num_rows
    return pa.Table.from_arrays([table["shard"].combine_chunks(), table["key"].combine_chunks(), pa.array(np.ones(n, np.int32)), pa.array(masks, pa.binary()), pa.array([b""] * n, pa.binary())], schema=_ANSWER_SCHEMA)


def _owners(table: pa.Table) -> pa.Table:
    """Key shard, second level: for entries whose key has a smaller id in another shard, that id."""
    if table.num_rows == 0:
        return _empty(_ANSWER_SCHEMA)
    blobs = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
    sizes = [len(x) for x in blobs]
    keys = np.concatenate(blobs)
    checks = np.frombuffer(b"".join(table["checks"].to_pylist()), np.uint64)
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
    order = np.lexsort((checks, keys))
    new = np.concatenate([[True], (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)])
    starts = np.flatnonzero(new)
    lowest = np.empty_like(ids)
    lowest[order] = np.minimum.reduceat(ids[order], starts)[np.cumsum(new) - 1]
    out = []
    ends = np.cumsum(sizes)
    for shard, key, a, b in zip(table["shard"].to_pylist(), table["key"].to_pylist(), ends - sizes, ends, strict=True):
        other = lowest[a:b] < ids[a:b]
        if other.any():
            out.append((shard, key, 2, np.packbits(other).tobytes(), lowest[a:b][other].tobytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ANSWER_SCHEMA.types, strict=True)], schema=_ANSWER_SCHEMA) if out else _empty(_ANSWER_SCHEMA)


def _alive(answers: pa.Table, keys: np.ndarray, parts: int) -> np.ndarray:
    alive = np.zeros(len(keys), bool)
    edges = bounds(keys, parts)
    for key, kind, mask in zip(answers["key"].to_pylist(), answers["kind"].to_pylist(), answers["mask"].to_pylist(), strict=True):
        if kind == 1:
            a, b = edges[key], edges[key + 1]
            alive[a:b] = _unpacked(mask, b - a)
    return alive


def deduplicate(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_words, n_removed, spans (removed runs of words, [start, end)), kept_text; one row per input row.

    Words are maximal runs of other bytes than the ASCII white space; a null text has none. Windows are judged on the
    input. Rows that share an id are one document to each other: they take nothing from one another. Rows with a null
    id come after all others, and share an id. Other columns are ignored.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    rows, parts = dealt(docs, key, text)

    def ask(table: pa.Table) -> pa.Table:
        keys, several = _first_level(table, window)
        return _entries(table["shard"][0].as_py(), 1, parts, keys, None, None, several)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _empty(_ENTRY_SCHEMA)
        keys, _ = _first_level(left, window)
        found, checks, low, several = _second_level(list(_alive_windows(left, window, keys, _alive(right, keys, parts))))
        return _entries(left["shard"][0].as_py(), 2, parts, found, checks, low, several)

    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _empty(schema)
        keys, _ = _first_level(left, window)
        windows = list(_alive_windows(left, window, keys, _alive(right, keys, parts)))
        found, checks, low, _ = _second_level(windows)
        low, edges = low.copy(), bounds(found, parts)
        for at, kind, mask, ids in zip(*(right[c].to_pylist() for c in ("key", "kind", "mask", "ids")), strict=True):
            if kind == 2:
                a, b = edges[at], edges[at + 1]
                low[a:b][_unpacked(mask, b - a)] = np.frombuffer(ids, np.int64)
        named = np.rec.fromarrays([found, checks], names="a,b") if len(np.unique(found)) < len(found) else None
        out = list(_removed(left, window, windows, found, low, named))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    masks = rows.groupBy("shard").applyInArrow(ask, _ENTRIES).groupBy("key").applyInArrow(_repeated, _ANSWERS)
    owners = rows.groupBy("shard").cogroup(masks.groupBy("shard")).applyInArrow(extend, _ENTRIES).groupBy("key").applyInArrow(_owners, _ANSWERS)
    answers = masks.unionByName(owners)
    out = rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(remove, "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(key), "n_words", "n_removed", "spans", "kept_text")


def _removed(table: pa.Table, window: int, windows: list[tuple], found, low, named) -> Iterator[tuple]:
    for (ids, texts), (at, a, b, owners) in zip(rows_of(table, SLICE), windows, strict=True):
        split = [x.split() for x in texts]
        first = np.cumsum([0, *map(len, split)])
        gone = np.zeros(first[-1] + 1, np.int64)
        if len(at):
            if named is None:
                place = np.searchsorted(found, a)
            else:  # two windows share the first half
                place = np.searchsorted(named, np.rec.fromarrays([a, b], names="a,b"))
            hit = at[low[place] < owners]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        kept = np.cumsum(gone[:-1]) == 0
        for i, words in enumerate(split):
            mask = kept[first[i] : first[i + 1]]
            spans = []
            if not mask.all():
                edges = np.flatnonzero(np.diff(np.concatenate([[True], mask, [True]]).astype(np.int8)))
                spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                words = [words[j] for j in np.flatnonzero(mask)]
            yield int(ids[i]), len(mask), int(len(mask) - mask.sum()), spans, b" ".join(words).decode()
