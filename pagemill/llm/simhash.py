"""SimHash near-duplicates found with pigeonring filtering.

Fingerprints of 64 bits lie on a ring of 16 segments of 4 bits. If two differ in at most 3 bits, then by the
pigeonring principle there is a segment from which every chain of l consecutive segments differs in at most
l * 3 / 16 bits. The first five segments of that chain must be equal (budget 15 / 16), so the 20 bits at each of
the 16 starts are the join keys; the longer chains (at most 1 bit in 10 segments, 2 in 15) prune a candidate before
the full Hamming distance is taken, of those alone that they leave. No pair is lost.

Equal fingerprints are one node, found by an aggregation that combines before the shuffle, so groups of copies
never meet in a task. Within a key bucket the links are reduced to a spanning forest of them at once: what leaves a
task is never more than its rows, and each is a pair within the distance. A bucket that is large is split again by blocks of its other bits, of which a pair
within the distance agrees in one at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import Scratch, cut, shards, slices, utf8
from .graph import components

BITS, SEGMENTS, KEY = 64, 16, 20
SEED = 42
#: Rows compared each with each in one block, and the rows of a bucket above which it is split by further bits.
BLOCK, DIRECT = 1024, 16384


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the shingles of `words` words, repeats included; of A-Z lower-cased UTF-8 text. No words: 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    n = max(1, len(tokens) - words + 1)
    return _majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n))


def _majority(h: np.ndarray) -> int:
    """The fingerprint of hashes, as a signed number: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(h), 65536):
        raw = h[start : start + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `fp` (the fingerprint as a signed long); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                fp = [fingerprint(x or b"", words) for x in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("__text"))
    return source.mapInArrow(run, "id bigint, fp bigint").withColumnRenamed("id", key)


def _rotated(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(BITS - by))


def _chained(x: np.ndarray, distance: int) -> np.ndarray:
    """Positions of the differences that hold every chain's budget, in a flat array of those of a bucket, rotated so that
    the chain starts at the top bit.

    The chain grows from the bucket's key, and what a length rules out is not looked at again. The last length is the
    ring: the Hamming distance of what the chains left.
    """
    at, step = np.arange(len(x)), BITS // SEGMENTS
    for length in range(KEY // step + 1, SEGMENTS + 1):
        budget = length * distance // SEGMENTS
        if length == SEGMENTS or (length + 1) * distance // SEGMENTS > budget:  # the longest chain with this budget implies the shorter
            ok = np.flatnonzero(np.bitwise_count(x >> np.uint64(BITS - step * length)) <= budget)
            x, at = x[ok], at[ok]
    return at


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of links a-b that span what all of them connect of n nodes."""
    root, at, kept = np.arange(n), np.flatnonzero(a != b), [np.empty(0, np.int64)]
    while len(at):
        one, two = root[a[at]], root[b[at]]
        high, low = np.maximum(one, two), np.minimum(one, two)
        np.minimum.at(root, high, low)  # the larger root hangs below the smallest that it meets
        pick, hung = np.full(n, -1), root[high] == low
        pick[high[hung]] = at[hung]
        kept.append(pick[pick >= 0])
        while not np.array_equal(jumped := root[root], root):
            root = jumped
        at = at[root[a[at]] != root[b[at]]]
    return np.concatenate(kept)


def _links(fp: np.ndarray, rows: np.ndarray, free: list[int], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links among the given rows, which differ in the bits `free` at most."""
    n = len(rows)
    if n <= DIRECT or len(free) <= distance:
        for start in range(0, n, BLOCK):
            one = rows[start : start + BLOCK]
            for other in range(start, n, BLOCK):
                two = rows[other : other + BLOCK]
                i, j = np.divmod(_chained((fp[one][:, None] ^ fp[two][None, :]).ravel(), distance), len(two))
                a, b = one[i], two[j]
                keep = a < b
                if keep.any():
                    a, b = a[keep], b[keep]
                    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                    some = _forest(len(ids), *np.split(at, 2))
                    yield a[some], b[some]
        return
    for part in np.array_split(np.array(free), distance + 1):
        mask = np.uint64(sum(1 << int(bit) for bit in part))
        value = fp[rows] & mask
        order = np.argsort(value, kind="stable")
        rest = [bit for bit in free if bit not in set(part.tolist())]
        for group in np.split(rows[order], np.flatnonzero(np.diff(value[order])) + 1):
            if len(group) > 1:
                yield from _links(fp, np.sort(group), rest, distance)


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Spanning links `u`, `v` among distinct fingerprints (column fp), each a pair at `distance` differing bits or fewer.

    Two fingerprints are in one component of the links if and only if they are in one of all such pairs.
    """
    step = BITS // SEGMENTS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for s in range(SEGMENTS):
                turned = _rotated(fp, s * step)
                key = (turned >> np.uint64(BITS - KEY)).astype(np.int64) | (s << KEY)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(turned.view(np.int64))], names=["bucket", "turned"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in _then_none(batches):
            if batch is not None:
                held_key = np.concatenate([held_key, batch.column(0).to_numpy()])
                held_fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
                if len(held_key) == 0 or held_key[0] == held_key[-1]:
                    continue
                end = np.searchsorted(held_key, held_key[-1])  # the last bucket may go on in the next batch
            else:
                end = len(held_key)
            if end:
                yield from _bucket_links(held_key[:end], held_fp[:end], distance, step)
            held_key, held_fp = held_key[end:], held_fp[end:]

    spark = prints.sparkSession
    rows = prints.select("fp").distinct().mapInArrow(spread, "bucket bigint, turned bigint")
    rows = rows.repartition(shards(spark), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(join, "u bigint, v bigint").distinct()


def _then_none(batches):
    yield from batches
    yield None


def _bucket_links(key: np.ndarray, fp: np.ndarray, distance: int, step: int) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    sizes = np.diff(np.append(starts, len(key)))
    a, b = [], []
    few = np.repeat(sizes <= 32, sizes)
    group = np.repeat(np.arange(len(starts)), sizes)
    for gap in range(1, 32):
        i = np.flatnonzero(few[:-gap] & (group[:-gap] == group[gap:])) if gap < len(key) else np.empty(0, np.int64)
        if len(i) == 0:
            break
        hit = i[_chained(fp[i] ^ fp[i + gap], distance)]
        a.append(hit)
        b.append(hit + gap)
    for g in np.flatnonzero(sizes > 32):
        for x, y in _links(fp, np.arange(starts[g], starts[g] + sizes[g]), list(range(BITS - KEY)), distance):
            a.append(x)
            b.append(y)
    if not a:
        return
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a) == 0:
        return
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    # the same fingerprint stands in several buckets with other turns: turn back, then one forest for the batch
    by = (key[ids] >> KEY) * step
    plain = np.empty(len(ids), np.uint64)
    for s in np.unique(by):
        plain[by == s] = _rotated(fp[ids[by == s]], int((BITS - s) % BITS))
    values, name = np.unique(plain, return_inverse=True)
    one, two = np.split(name[at], 2)
    some = _forest(len(values), one, two)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(values[x[some]].view(np.int64)) for x in (one, two)], names=["u", "v"])


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `fingerprint` (16 hex digits), `component_id`: the smallest id reachable by links, its own included.

    One row per input row. A null or empty text has fingerprint zero and links like any other. Rows with a null
    id take part in linking but never name a component that has an id. Other columns are ignored.
    """
    prints = cut(fingerprints(docs, words, key, text))
    nodes = prints.groupBy("fp").agg(F.min(key).alias("first"))
    joined = components(links(nodes, distance))
    nodes = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = nodes.join(smallest, "component").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(named, prints["fp"] == named["__fp"]).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Documents alike by their shingles: pigeonring links come first, prefix filtering finds every candidate that they leave,
# the sets themselves decide.

#: Shingles of about FREQUENT documents or more are put last in the order; one text in SAMPLE is read to find them.
SAMPLE, FREQUENT, HOT = 64, 256, 200_000
#: The least bits of a parity sketch, and the rows of a bucket above which pairs are made by blocks.
PARITY, FEW = 512, 64
#: Cells of the map of rows whose sets are asked for.
MAP = 1 << 24


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of `words` words; of A-Z lower-cased UTF-8 text. Fewer words: one shingle."""
    tokens = text.lower().split()
    parts = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=max(1, len(tokens) - words + 1)))


def _name(h: np.ndarray) -> int:
    """A set's name, which no two sets share but by chance of 2 ** -64 a pair."""
    return int(np.array(xxhash.xxh3_64_intdigest(h.tobytes()), np.uint64).view(np.int64))


_NODE = StructType([StructField("node", LongType()), StructField("n", IntegerType()), StructField("low", IntegerType()), StructField("high", IntegerType()), StructField("fp", LongType()), StructField("prefix", BinaryType()), StructField("sketch", BinaryType())])
_ROW = "bucket bigint, node bigint, n int, low int, high int, place int"


class _Rule:
    """Jaccard similarity of at least `similarity`, in whole numbers."""

    def __init__(self, similarity: float):
        self.num, self.den = Fraction(str(similarity)).as_integer_ratio()

    def overlap(self, a, b):
        """The least number of common shingles of sets of a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """So many first shingles, in any order common to all sets, hold one of every set that is alike."""
        return n + (-self.num * n // self.den) + 1

    def possible(self, n, m, i, j):
        """Whether sets of n <= m shingles with a common one at places i and j of their orders, and none before, can be alike."""
        return (n * self.den >= m * self.num) & (np.minimum(n - i, m - j) >= self.overlap(n, m))


def _ringed(nodes: DataFrame, keep: Scratch, distance: int = 3) -> DataFrame:
    """u, v: spanning pairs of sets with fingerprints at `distance` differing bits or fewer, by the pigeonring. Of sets
    with one fingerprint each meets the first, which stands for all of them in the ring."""
    first = keep(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    pairs = keep(links(first, distance))
    for end in "uv":
        pairs = pairs.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
    equal = nodes.select("node", "fp").join(first, "fp").where("node <> first")
    return pairs.select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v")).unionByName(equal.select(F.col("first").alias("u"), F.col("node").alias("v")))


def _across(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs u, v whose ends are not yet in one component."""
    for end in "uv":
        pairs = pairs.join(joined.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}")), end, "left")
    return pairs.where("coalesce(c_u, u) <> coalesce(c_v, v)").select("u", "v")


def _hot(docs: DataFrame, words: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample and their counts. They only order the shingles: any order finds the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = [shingles(x or b"", words) for x in utf8(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    sample = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct()
    counts = sample.mapInArrow(run, "h bigint").groupBy("h").count().where(F.col("count") >= FREQUENT // SAMPLE)
    found = counts.orderBy(F.desc("count"), "h").limit(HOT).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of runs of whole buckets; the rows come sorted by the first column."""
    held: list[np.ndarray] = []
    for batch in _then_none(batches):
        if batch is not None:
            if batch.num_rows == 0:
                continue
            new = [c.to_numpy() for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if held[0][0] == held[0][-1]:
                continue
            end = np.searchsorted(held[0], held[0][-1])
        else:
            end = len(held[0]) if held else 0
        if end:
            yield [x[:end] for x in held]
        held = [x[end:] for x in held]


def _shared(nodes: DataFrame) -> DataFrame:
    """bucket, node, n, low, high, place: the rows of buckets (shingles of prefixes) with two sets at least."""
    names = ["bucket", "node", "n", "low", "high", "place"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "prefix", 1 << 18):
                keys = [np.frombuffer(x, np.int64) for x in part.column(4).to_pylist()]
                sizes = [len(x) for x in keys]
                columns = [np.concatenate(keys), *(np.repeat(part.column(k).to_numpy(), sizes) for k in range(4)), np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches):
            same = columns[0][1:] == columns[0][:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=names)

    schema = _ROW
    rows = nodes.select("node", "n", "low", "high", "prefix").mapInArrow(spread, schema)
    return rows.repartition(shards(nodes.sparkSession), "bucket").sortWithinPartitions("bucket", "n", "node").mapInArrow(several, schema)


def _candidates(rows: DataFrame, rule: _Rule, near: int | None) -> DataFrame:
    """u, v: pairs of a bucket that can be alike: all of different components, or, if `near` is given, each set with the
    next `near` in three orders, by size, by the lowest and by the highest shingle hash, and with `near` hubs.

    Sets that are alike have the same lowest hash with the probability of their similarity. A hub is a set with few rare
    shingles, so the bucket's shingle has an early place in its order: of a group of near copies the least changed one,
    which is like most others. So a large group is linked by a number of pairs in proportion to its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n, node, place, component, low, high in _groups(batches):
            n, place, us, vs = n.astype(np.int64), place.astype(np.int64), [], []

            def pairs(a: np.ndarray, b: np.ndarray) -> None:
                small, large = np.where(n[a] <= n[b], a, b), np.where(n[a] <= n[b], b, a)  # noqa: B023
                ok = rule.possible(n[small], n[large], place[small], place[large]) & (component[a] != component[b])  # noqa: B023
                a, b = node[a[ok]], node[b[ok]]  # noqa: B023
                us.append(np.minimum(a, b))  # noqa: B023
                vs.append(np.maximum(a, b))  # noqa: B023

            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            if near is not None:
                for order in (np.arange(len(key)), np.lexsort((node, n, low, key)), np.lexsort((node, n, high, key))):
                    for gap in range(1, min(near + 1, len(key))):
                        one, two = order[:-gap], order[gap:]
                        same = key[one] == key[two]
                        pairs(one[same], two[same])
                central, first = np.lexsort((node, n, place, key)), np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
                for hub in range(near):
                    at = first[of] + hub
                    some = np.flatnonzero(at < np.append(first[1:], len(key))[of])
                    pairs(some, central[at[some]])
            few = np.repeat((sizes <= FEW) & (near is None), sizes)
            for gap in range(1, min(FEW if near is None else 1, len(key))):
                pairs(i := np.flatnonzero(few[:-gap] & (key[:-gap] == key[gap:])), i + gap)
            for g in np.flatnonzero(sizes > FEW) if near is None else ():
                end = starts[g] + sizes[g]
                for one in range(starts[g], end, BLOCK):
                    a = np.arange(one, min(one + BLOCK, end))
                    far = starts[g] + np.searchsorted(n[starts[g] : end] * rule.num, n[a[-1]] * rule.den, "right")
                    for two in range(one, far, BLOCK):
                        b = np.arange(two, min(two + BLOCK, far))
                        i, j = np.nonzero((component[a][:, None] != component[b][None, :]) & (a[:, None] < b[None, :]))
                        pairs(a[i], b[j])
            found = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0) if us else np.empty((0, 2), np.int64)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["u", "v"])

    return rows.select("bucket", "n", "node", "place", "component", "low", "high").mapInArrow(run, "u bigint, v bigint").distinct()


def _sketch(h: np.ndarray) -> bytes:
    """Parities of the counts of hashes by their low bits: two bits a shingle at least, PARITY at least."""
    bits = max(PARITY, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _apart(one: bytes, two: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded: no more than the shingles in one set only."""
    a, b = sorted((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _bounded(pairs: DataFrame, nodes: DataFrame, rule: _Rule) -> DataFrame:
    """The pairs whose parity sketches don't differ in more bits than alike sets can have shingles of one only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = [_apart(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            most = both - 2 * -(-rule.num * both // (rule.num + rule.den))
            yield batch.select([0, 1]).filter(pa.array(np.array(apart, np.int64) <= most))

    for end in "uv":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"s_{end}")), end)
    return pairs.select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(run, "u bigint, v bigint")


def _sets(nodes: DataFrame, asked: DataFrame, docs: DataFrame, words: int, text: str) -> DataFrame:
    """node, items (its shingles) of the nodes asked for at least, made again from the texts.

    A map of fixed size of the rows asked for goes to the tasks, so no text is shuffled; what it lets through beyond
    them meets no pair.
    """
    cell = F.pmod("h", F.lit(MAP)) + 1
    rows = nodes.join(asked, "node", "left_semi").select(F.col("row.h").alias("h"))
    maps = rows.select(F.bitmap_bucket_number(cell).alias("k"), F.bitmap_bit_position(cell).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits = np.zeros(MAP // 8, np.uint8)
    for r in maps.collect():
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % MAP
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            for part in slices(batch, "text", 1 << 20):
                sets = [shingles(x or b"", words) for x in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "items"])

    made = docs.select(F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias("h"), F.col(text).cast("string").alias("text")).mapInArrow(run, "node bigint, items binary")
    return made.dropDuplicates(["node"])


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, rule: _Rule, text: str, keep: Scratch) -> DataFrame:
    """The pairs u, v whose sets are alike, by the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                keep.append(len(np.intersect1d(one, two, assume_unique=True)) >= rule.overlap(len(one), len(two)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = keep(pairs)
    sets = _sets(nodes, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), docs, words, text)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
    return keep(both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint"))


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: the columns of docs, unchanged, of its first row.

    Texts are near duplicates if the Jaccard similarity of their sets of distinct shingles is `similarity` or more;
    groups are connected. The first row is that with the smallest doc_id (nulls last), then by the row's hash; of
    wholly equal rows one stays. Null and empty texts are one group.

    First come pairs of sets whose SimHash fingerprints link by the pigeonring, at 3 bits or fewer. That loses pairs
    alike, so the rest follows exactly. The shingles have one order for all sets, rare ones first. Sets that are alike
    share one of the first shingles of both (prefix filtering), so the buckets of these hold every pair; sizes, places
    and parity sketches rule out only pairs that cannot be alike, and the rest is compared by the sets. Of what is in
    different components so far, each set meets its next in size in a bucket, and in two orders by a hash of the set;
    then all pairs of a bucket that these links leave in different components.
    """
    rule = _Rule(similarity)
    hot, counts = _hot(docs, words, text)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", 1 << 20):
                names, sizes, lows, highs, prints, prefixes, sketches = [], [], [], [], [], [], []
                for x in utf8(part.column(1)):
                    h = shingles(x or b"", words)
                    names.append(_name(h))
                    sizes.append(len(h))
                    lows.append(int(h[0] >> np.uint64(33)))
                    highs.append(int(h[-1] >> np.uint64(1) & np.uint64(0x7FFFFFFF)))
                    prints.append(_majority(h))
                    sketches.append(_sketch(h))
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                        h = h[np.lexsort((h, np.where(hot[at] == h, counts[at], 0)))]
                    prefixes.append(h[: rule.prefix(len(h))].tobytes())
                columns = [pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(prints, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary()), part.column(0)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "low", "high", "fp", "prefix", "sketch", "row"])

    every = [f"`{c}`" for c in docs.columns]
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64(*every).alias("h"))
    source = docs.select(order.alias("row"), F.col(text).cast("string").alias("__text"))
    signed = source.mapInArrow(sign, StructType([*_NODE.fields, source.schema["row"]]))
    with Scratch(docs.sparkSession) as keep:
        nodes = cut(signed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "low", "high", "fp", "prefix", "sketch")], F.min("row").alias("row")))
        found = _alike(_bounded(_ringed(nodes, keep), nodes, rule), nodes, docs, words, rule, text, keep)
        rows = cut(_shared(nodes))
        next_ones = _across(_candidates(rows.withColumn("component", F.col("node")), rule, 2), components(found, keep=keep))
        found = found.unionByName(_alike(_bounded(next_ones, nodes, rule), nodes, docs, words, rule, text, keep))
        joined = components(found, keep=keep)
        apart = rows.join(joined, "node", "left").select("bucket", "n", "node", "place", F.coalesce("component", "node").alias("component"), "low", "high")
        apart = apart.repartition(shards(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "n", "node")
        more = _alike(_bounded(_candidates(apart, rule, None), nodes, rule), nodes, docs, words, rule, text, keep)
        near = components(found.unionByName(more), keep=keep)
        named = nodes.join(near, "node", "left").select("row", F.coalesce("component", "node").alias("component"))
        first = cut(named.groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.n").alias("__n"), F.col("row.i").alias("__i"), F.col("row.h").alias("__h")))
    packed = docs.select(F.struct("*").alias("doc"), "doc_id", F.xxhash64(*every).alias("hash")).select("doc", F.col("doc_id").alias("id"), "hash")
    kept = packed.join(first, (F.col("hash") == F.col("__h")) & F.col("id").eqNullSafe(F.col("__i")), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("doc.*")
