"""Removal of byte strings repeated across documents, by suffix sorting of key shards.

A string of `length` bytes is removed from a document where it also starts in a document with a smaller id. A
suffix array of the whole corpus on one machine is not needed for this. Each window of `length` bytes has a minimizer
(the lowest hash of the strings of SEED bytes in it); neighbouring windows with the same one form a segment. Only
segments whose minimizer stands in more than one document can hold a repeat: they go, each distinct one once per
document shard with its smallest document, to the shard of their minimizer, so equal strings meet. There the
distinct segments are sorted by external induced suffix sorting, and the windows that share a common prefix of
`length` bytes get the smallest document among them. A minimizer with a single distinct segment has nothing to sort.
Segments of different minimizers share no window, so a key shard is sorted some whole minimizers at a time (about SORTED
bytes), whatever its size; only the segments of one minimizer always stay together.
What a document must remove comes back by segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID
from .shards import bounds, dealt, folded, mix, pair, rows_of, slid
from .substrings import _ANSWERS, _ENTRIES, _ENTRY_SCHEMA, _alive, _empty, _entries, _repeated

SEED = 24
SLICE = 1 << 18
#: Memory of the sorting queues before they go to disk, and about how many bytes of segments are sorted at once.
MEMORY, SORTED = 128 << 20, 4 << 20

_REPLY_SCHEMA = pa.schema([("shard", pa.int32()), ("key", pa.int32()), ("kind", pa.int32()), ("mask", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary())])
_REPLIES = _ANSWERS + ", counts binary, sizes binary"


class Slice:
    """Segments of some documents: windows start..last of one document with the same minimizer."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int):
        self.ids, self.texts = ids, texts
        self.data = b"\xff".join([*texts, b"\xff" * (length + 8)])
        lengths = np.array([len(x) for x in texts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(texts)]
        n = len(self.data) - length - 8  # windows start before this
        view = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        count = n + length - SEED
        h = pair(pair(view[:count], view[8 : 8 + count]), view[16 : 16 + count])
        lowest = slid(h, length - SEED + 1, np.minimum)[:n]
        valid = np.zeros(n + 1, np.int8)
        long = lengths >= length
        valid[self.offset[long]] += 1
        valid[self.offset[long] + lengths[long] - length + 1] -= 1
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = np.ones(n, bool)
        new[1:] = (lowest[1:] != lowest[:-1]) | (valid[1:] != valid[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        real = valid[starts]
        self.start, self.end = starts[real], ends[real]
        self.h = mix(lowest[self.start])  # low hashes; mixed again they are spread evenly over the key shards
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1


def _slices(table: pa.Table, length: int) -> list[Slice]:
    return [Slice(ids, texts, length) for ids, texts in rows_of(table, SLICE)]


def _minimizers(parts: list[Slice]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.empty(0, np.uint64), *(s.h for s in parts)])
    owners = np.concatenate([np.empty(0, np.int64), *(s.ids[s.doc] for s in parts)])
    keys, _, _, several = folded(keys, owners)
    return keys, several


def _living(s: Slice, keys: np.ndarray, alive: np.ndarray) -> np.ndarray:
    if len(keys) == 0 or len(s.h) == 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(alive[np.searchsorted(keys, s.h)])


class Segments:
    """Distinct living segments of a document shard, in an order that any reading of the shard gives again."""

    def __init__(self, parts: list[Slice], keys: np.ndarray, alive: np.ndarray, length: int):
        place: dict[bytes, int] = {}
        h: list[int] = []
        low: list[int] = []
        self.found: list[list[tuple[int, int, int, int]]] = []  # by slice: document, start, bytes, place
        for s in parts:
            at = _living(s, keys, alive)
            data, out = s.data, []
            owners = s.ids[s.doc[at]].tolist()
            for d, a, b, key, own in zip(s.doc[at].tolist(), s.start[at].tolist(), s.end[at].tolist(), s.h[at].tolist(), owners, strict=True):
                segment = data[a : b + length - 1]
                i = place.get(segment)
                if i is None:
                    i = place[segment] = len(h)
                    h.append(key)
                    low.append(own)
                elif own < low[i]:
                    low[i] = own
                out.append((d, a, len(segment), i))
            self.found.append(out)
        segments = list(place)
        h, digest = np.array(h, np.uint64), np.array([xxhash.xxh3_64_intdigest(x) for x in segments], np.uint64)
        order = np.lexsort((digest, h))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.h, self.low = h[order], np.array(low, np.int64)[order]
        self.segments = [segments[i] for i in order.tolist()]


def _sent(shard: int, parts: int, s: Segments) -> pa.Table:
    edges = bounds(s.h, parts)
    some = np.flatnonzero(np.diff(edges))
    cut = [(int(edges[p]), int(edges[p + 1])) for p in some]
    columns = [
        pa.array(some.astype(np.int32)),
        pa.array(np.full(len(some), shard, np.int32)),
        pa.array(np.full(len(some), 2, np.int32)),
        pa.array([s.h[a:b].tobytes() for a, b in cut], pa.binary()),
        pa.array([np.array([len(x) for x in s.segments[a:b]], np.uint32).tobytes() for a, b in cut], pa.binary()),
        pa.array([s.low[a:b].tobytes() for a, b in cut], pa.binary()),
        pa.array([b"".join(s.segments[a:b]) for a, b in cut], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, schema=_ENTRY_SCHEMA)


def _sorted(table: pa.Table, length: int) -> pa.Table:
    """Key shard: for each segment of each document shard the smallest document of its windows, as runs."""
    from .suffixes import encoded, smallest_owner

    if table.num_rows == 0:
        return _empty(_REPLY_SCHEMA)
    place: dict[bytes, int] = {}
    low: list[int] = []
    seed: list[int] = []
    entries = []
    for keys, sizes, ids, data in zip(*(table[c].to_pylist() for c in ("keys", "checks", "ids", "several")), strict=True):
        at, own, mine = 0, [], np.frombuffer(ids, np.int64)
        for key, n, doc in zip(np.frombuffer(keys, np.uint64).tolist(), np.frombuffer(sizes, np.uint32).tolist(), mine.tolist(), strict=True):
            segment = data[at : at + n]
            at += n
            i = place.get(segment)
            if i is None:
                i = place[segment] = len(low)
                low.append(doc)
                seed.append(key)
            elif doc < low[i]:
                low[i] = doc
            own.append(i)
        entries.append((np.array(own, np.int64), mine))
    segments, low_of = list(place), np.array(low, np.int64)
    del place
    windows = np.array([len(x) - length + 1 for x in segments], np.int64)
    _, at, counts = np.unique(np.array(seed, np.uint64), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts[at] > 1)  # other segments have the same minimizer
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    least = low_of.copy()
    shared = shared[np.argsort(at[shared], kind="stable")]
    group, size = at[shared], windows[shared] + length
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(shared) else np.empty(0, np.int64)
    before = np.cumsum(size) - size
    portion = before[heads] // SORTED  # of each minimizer, by where it starts
    cuts = heads[np.flatnonzero(np.diff(portion, prepend=-1))] if len(heads) else heads
    for part in np.split(shared, cuts[1:]) if len(shared) else ():
        text = encoded([segments[i] for i in part])
        sizes = windows[part] + length
        owner = np.append(np.repeat(low_of[part], sizes), NO_ID)
        owners = smallest_owner(text, owner, length, MEMORY)
        starts = np.cumsum(sizes) - sizes
        for i, a in zip(part.tolist(), starts.tolist(), strict=True):
            own = owners[a : a + windows[i]]
            edges = np.flatnonzero(own[1:] != own[:-1])
            if len(edges) or own[0] != low_of[i]:
                edges = np.concatenate([[0], edges + 1, [len(own)]])
                runs[i] = np.diff(edges).astype(np.uint32), own[edges[:-1]]
                least[i] = own.min()
    out = []
    for shard, key, (own, mine) in zip(table["shard"].to_pylist(), table["key"].to_pylist(), entries, strict=True):
        tell = least[own] < mine
        if not tell.any():
            continue
        told = [runs.get(i) or (windows[i : i + 1].astype(np.uint32), low_of[i : i + 1]) for i in own[tell].tolist()]
        counts = np.array([len(x) for x, _ in told], np.uint32)
        out.append((shard, key, 2, np.packbits(tell).tobytes(), np.concatenate([y for _, y in told]).tobytes(), counts.tobytes(), np.concatenate([x for x, _ in told]).tobytes()))
    if not out:
        return _empty(_REPLY_SCHEMA)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _REPLY_SCHEMA.types, strict=True)], schema=_REPLY_SCHEMA)


def _replies(table: pa.Table, s: Segments, parts: int) -> dict[int, list[tuple[int, int, int]]]:
    """By segment in order: its runs of windows as (first, end, smallest document)."""
    edges = bounds(s.h, parts)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for key, kind, mask, ids, counts, sizes in zip(*(table[c].to_pylist() for c in ("key", "kind", "mask", "ids", "counts", "sizes")), strict=True):
        if kind != 2:
            continue
        a, n = int(edges[key]), int(edges[key + 1] - edges[key])
        told = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n)) + a
        ids, sizes = np.frombuffer(ids, np.int64).tolist(), np.frombuffer(sizes, np.uint32).tolist()
        k = 0
        for i, count in zip(told.tolist(), np.frombuffer(counts, np.uint32).tolist(), strict=True):
            start, runs = 0, []
            for _ in range(count):
                runs.append((start, start + sizes[k], ids[k]))
                start += sizes[k]
                k += 1
            out[i] = runs
    return out


def deduplicate(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_bytes, n_removed, spans (removed runs of bytes, [start, end)), kept (binary); one row per input row.

    Texts are taken as UTF-8, a null one as empty; strings never cross documents and are judged on the input, so cut
    bytes need not be whole characters. Rows that share an id are one document to each other: they take nothing from
    one another. Rows with a null id come after all others, and share an id. Other columns are ignored. `length` is
    between 32 and 255 bytes.
    """
    if not SEED + 8 <= length <= 255:
        raise ValueError("length must be 32 to 255 bytes")
    rows, parts = dealt(docs, key, text)

    def ask(table: pa.Table) -> pa.Table:
        keys, several = _minimizers(_slices(table, length))
        return _entries(table["shard"][0].as_py(), 1, parts, keys, None, None, several)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _empty(_ENTRY_SCHEMA)
        own = _slices(left, length)
        keys, _ = _minimizers(own)
        return _sent(left["shard"][0].as_py(), parts, Segments(own, keys, _alive(right, keys, parts), length))

    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _empty(schema)
        own = _slices(left, length)
        keys, _ = _minimizers(own)
        s = Segments(own, keys, _alive(right, keys, parts), length)
        replies, rank, low = _replies(right, s, parts), s.rank.tolist(), s.low.tolist()
        out = [row for part, found in zip(own, s.found, strict=True) for row in _removed(part, found, rank, low, replies, length)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    masks = rows.groupBy("shard").applyInArrow(ask, _ENTRIES).groupBy("key").applyInArrow(_repeated, _ANSWERS)
    sent = rows.groupBy("shard").cogroup(masks.groupBy("shard")).applyInArrow(send, _ENTRIES)
    replies = sent.groupBy("key").applyInArrow(lambda t: _sorted(t, length), _REPLIES)
    both = masks.withColumns({"counts": F.lit(None).cast("binary"), "sizes": F.lit(None).cast("binary")}).unionByName(replies)
    out = rows.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(remove, "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(key), "n_bytes", "n_removed", "spans", "kept")


def _removed(part: Slice, found: list[tuple[int, int, int, int]], rank: list[int], low: list[int], replies: dict, length: int) -> Iterator[tuple]:
    cover: dict[int, list[tuple[int, int]]] = {}
    ids, offset = part.ids.tolist(), part.offset.tolist()
    for d, at, size, i in found:
        i, own, base = rank[i], ids[d], at - offset[d]
        # no reply: the shard's own smallest document is the smallest of every window
        for a, b, first in replies.get(i) or ((0, size - length + 1, low[i]),):
            if first < own:
                cover.setdefault(d, []).append((base + a, base + b + length - 1))
    for d, x in enumerate(part.texts):
        spans: list[list[int]] = []
        for a, b in cover.get(d, ()):  # in order of their start
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        kept, end = [], 0
        for a, b in spans:
            kept.append(x[end:a])
            end = b
        kept.append(x[end:])
        yield ids[d], len(x), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], b"".join(kept)
