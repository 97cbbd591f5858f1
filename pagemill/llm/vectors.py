"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

1. Fold. Rows are folded into balls block by block before anything is shuffled: a vector within FOLD (cosine) of a
   leader of its block joins the leader's ball. Two members of a ball are at most twice that angle apart, which is
   within the link threshold, so they are linked without being compared. A group of copies leaves a few leaders
   for each block, whatever its size.
2. Shards. Leaders go to the shards of their OVERLAP nearest centroids. The centroids are fitted on a bounded sample
   (SAMPLE leaders); every leader is indexed. A shard above SHARD leaders is divided again by centroids of its own
   (fitted on some SUBSAMPLE of its leaders), each leader going to its two nearest, so a search meets its own shards
   only. What is too large even then, because its vectors are all alike, is cut into parts that all its queries visit.
3. Graph. In each shard the nearest CANDIDATES of a leader are pruned to DEGREE neighbours by the robust rule (a
   candidate goes if a chosen neighbour is ALPHA times nearer to it), reverse edges are added, and the adjacency lists
   of a leader's shards are united.
4. Search. Each leader searches its shards greedily from their medoids with a beam of bounded width, then expands its
   range: the rows found that may hold a link are expanded until they lead to no other.
5. Verify. Pairs of balls whose radii leave a doubt are compared member by member, in blocks, in double precision;
   elsewhere the triangle inequality settles all pairs at once. No pairs of rows are emitted.
6. Audit. The link counts of AUDIT rows, drawn by hash whatever was found, are held against all rows; if the mean share
   found is below RECALL, all is searched again with a wider beam and more overlap, then refused.

The index may miss links, so n_links is a count of links found, each of them real; components are of found links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, shards
from .graph import components

FOLD = 0.98
BLOCK, SHARD, SAMPLE, SUBSAMPLE, OVERLAP = 2048, 4096, 20_000, 2048, 3
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 16, 1.2, 16
AUDIT, RECALL = 200, 0.9
#: Queries searched at once, and what single precision may be off by.
QUERIES, _SLACK = 1024, 1e-5


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of the usable rows (one length only), and their places."""
    at = [i for i, x in enumerate(rows) if x is not None and len(x) and all(y is not None for y in x)]
    if not at:
        return np.empty((0, 0)), np.empty(0, np.int64)
    x = np.array([rows[i] for i in at], np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max(axis=1)
        ok = np.isfinite(x).all(axis=1) & (scale > 0)
        x = x[ok] / scale[ok, None]
    return x / np.linalg.norm(x, axis=1)[:, None], np.array(at)[ok]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            ids, rows = part.column(0).to_pylist(), part.column(1).to_pylist()
            leader, cosine, vector, lead = [None] * len(ids), [None] * len(ids), [None] * len(ids), [False] * len(ids)
            lengths = [0 if x is None else len(x) for x in rows]
            for length in set(lengths):
                x, at = _unit([r if n == length else None for r, n in zip(rows, lengths, strict=True)])
                free = np.ones(len(at), bool)
                for i in range(len(at)):
                    if not free[i]:
                        continue
                    near = np.flatnonzero(free[i:]) + i
                    c = x[near] @ x[i]
                    c[0] = 1.0
                    near, c = near[c >= FOLD], c[c >= FOLD]
                    free[near] = False
                    for j, y in zip(near.tolist(), c.tolist(), strict=True):
                        k = int(at[j])
                        leader[k], cosine[k], vector[k], lead[k] = x[i].tobytes(), min(y, 1.0), x[j].tobytes(), j == i
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(leader, pa.binary()), pa.array(cosine, pa.float64()), pa.array(vector, pa.binary()), pa.array(lead, pa.bool_())], names=["vec_id", "leader", "cosine", "vector", "lead"])


def _centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """k directions by a few rounds of spherical k-means from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(6):
        own = np.concatenate([np.argmax(sample[i : i + 2048] @ centres.T, axis=1) for i in range(0, len(sample), 2048)])
        for c in range(k):
            if (mine := own == c).any():
                s = sample[mine].sum(axis=0)
                if (n := np.linalg.norm(s)) > 0:
                    centres[c] = s / n
    return centres


def _pruned(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of every row, reverse edges added."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    chosen: list[list[int]] = [[] for _ in range(n)]
    if k <= 0:
        return [np.empty(0, np.int64) for _ in range(n)]
    for start in range(0, n, 128):
        rows = np.arange(start, min(n, start + 128))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, axis=1)
        d = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, near, axis=1)))
        g = x[near]
        among = np.sqrt(np.maximum(0, 2 - 2 * (g @ g.transpose(0, 2, 1))))
        open_ = np.ones(near.shape, bool)
        for _ in range(DEGREE):
            first = np.argmax(open_, axis=1)
            has = open_[np.arange(len(rows)), first]
            if not has.any():
                break
            for q in np.flatnonzero(has):
                chosen[rows[q]].append(int(near[q, first[q]]))
            open_ &= ~(ALPHA * among[np.arange(len(rows)), first] <= d)
            open_[np.arange(len(rows)), first] = False
    back: list[list[int]] = [[] for _ in range(n)]
    for i, c in enumerate(chosen):
        for j in c:
            back[j].append(i)
    out = []
    for i, c in enumerate(chosen):
        more = np.setdiff1d(np.array(back[i], np.int64), np.array(c, np.int64))
        if len(more) > DEGREE:  # a hub keeps its nearest
            more = more[np.argpartition(-(x[more] @ x[i]), DEGREE - 1)[:DEGREE]]
        out.append(np.concatenate([np.array(c, np.int64), more]))
    return out


def _search(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, in_range, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) pairs found for which in_range(query, row, cosine) holds.

    A beam of the best rows seen is expanded from the medoid until all of it is; then the rows in range, level by level.
    Work is in proportion to the edges of what is expanded, not to the rows.
    """
    n = len(x)
    degree = np.array([len(a) for a in links], np.int64)
    first, flat = np.cumsum(degree) - degree, np.concatenate([*links, np.empty(0, np.int64)]).astype(np.int64)
    fast, medoid = x.astype(np.float32), int(np.argmax(x @ x.mean(axis=0)))

    for start in range(0, len(q), QUERIES):
        y = q[start : start + QUERIES].astype(np.float32)
        m = len(y)
        seen, expanded = np.zeros((m, n), bool), np.zeros((m, n), bool)
        found_a, found_b = [], []

        def reach(a: np.ndarray, b: np.ndarray, repeated: bool):
            """Rows not seen before next to rows b of queries a, with their cosines; those in range are noted."""
            size = degree[b]
            a = np.repeat(a, size)
            b = flat[np.arange(len(a)) + np.repeat(first[b] - (np.cumsum(size) - size), size)]
            new = ~seen[a, b]  # noqa: B023
            a, b = a[new], b[new]
            if repeated and len(a):
                pairs = np.unique(a * n + b)
                a, b = pairs // n, pairs % n
            seen[a, b] = True  # noqa: B023
            c = np.einsum("ij,ij->i", y[a], fast[b])  # noqa: B023
            near = in_range(start + a, b, c)  # noqa: B023
            found_a.append(a[near])  # noqa: B023
            found_b.append(b[near])  # noqa: B023
            return a, b, c

        pool, at, done = np.full((m, beam), -4.0, np.float32), np.zeros((m, beam), np.int64), np.ones((m, beam), bool)
        rows = np.arange(m)
        pool[:, 0], at[:, 0], done[:, 0], seen[:, medoid] = y @ fast[medoid], medoid, False, True
        near = in_range(start + rows, np.full(m, medoid), pool[:, 0])
        found_a.append(rows[near])
        found_b.append(np.full(int(near.sum()), medoid))
        active = rows
        while True:
            active = active[~done[active].all(axis=1)]
            if len(active) == 0:
                break
            best = np.argmax(np.where(done[active], np.float32(-5), pool[active]), axis=1)
            done[active, best] = True
            node = at[active, best]
            expanded[active, node] = True
            a, b, c = reach(active, node, False)
            if len(a) == 0:
                continue
            turn = np.searchsorted(active, a)  # in order
            count = np.bincount(turn, minlength=len(active))
            place = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            wide = beam + int(count.max())
            s, i, d = np.full((len(active), wide), -4.0, np.float32), np.zeros((len(active), wide), np.int64), np.ones((len(active), wide), bool)
            s[:, :beam], i[:, :beam], d[:, :beam] = pool[active], at[active], done[active]
            s[turn, beam + place], i[turn, beam + place], d[turn, beam + place] = c, b, False
            top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
            pool[active], at[active], done[active] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1), np.take_along_axis(d, top, 1)
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        left = ~expanded[a, b]
        a, b = a[left], b[left]
        while len(a):
            have = len(found_a)
            reach(a, b, True)
            a, b = np.concatenate(found_a[have:]), np.concatenate(found_b[have:])
        yield start + np.concatenate(found_a), np.concatenate(found_b)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", embedding: str = "embedding", beam: int = BEAM) -> DataFrame:
    """`key`, n_links, component_id, kept: one row per input row.

    Rows link if their cosine in double precision is at least the threshold (0.92 at most, so that balls are safe).
    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors of
    different lengths don't link. Rows that repeat an id are vectors of their own. A null id names no component that
    has an id. Other columns are ignored. No rows give no rows.
    """
    if not 0 < threshold <= 0.92:
        raise ValueError("threshold must be above 0 and at most 0.92")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    folded = cut(rows.mapInArrow(_fold, "vec_id bigint, leader binary, cosine double, vector binary, lead boolean"))
    members = folded.where("leader is not null").withColumn("ball", F.xxhash64("leader"))
    balls = cut(members.groupBy("ball").agg(F.first("leader").alias("x"), F.min("cosine").alias("cosine"), F.count("*").alias("size"), F.min("vec_id").alias("first")).withColumn("radius", F.when(F.col("size") == 1, F.lit(0.0)).otherwise(F.acos(F.least(F.lit(1.0), "cosine")))))
    for wider in range(3):
        pairs = _ball_pairs(spark, balls, threshold, beam << 2 * wider, OVERLAP << wider)
        counts = _counted(members, balls, pairs, threshold)
        result = cut(_result(folded, members, balls, counts, key))
        if _recall(spark, members, counts, threshold) >= RECALL:
            return result
    raise RuntimeError(f"the index finds less than {RECALL:.0%} of the links")


def _nearest(centres: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-(centres @ x), kind="stable")[:k]


def _placed(spark, balls: DataFrame, overlap: int) -> DataFrame:
    """shard, ball, x, radius: the shards of each leader."""
    n = balls.count()
    sample = balls.select("x", F.xxhash64("ball").alias("h")).orderBy("h").limit(SAMPLE).collect()
    by_length: dict[int, list[np.ndarray]] = {}
    for r in sample:
        by_length.setdefault(len(r["x"]), []).append(np.frombuffer(r["x"]))
    centres = {k: _centroids(np.array(v), max(1, min(len(v) // 20, -(-n * overlap // SHARD)))) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(centres)  # bounded by the sample

    def placing(choose):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out += [(shard, *row[1:]) for shard in choose(row[0], row[2])]
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.float64()), strict=True)], names=["shard", "ball", "x", "radius"])

        return run

    def top(_, raw: bytes) -> list[int]:
        c = shared.value.get(len(raw))
        near = [0] if c is None else _nearest(c, np.frombuffer(raw), overlap).tolist()
        return [(len(raw) << 16 | s) << 8 for s in near]

    schema = "shard bigint, ball bigint, x binary, radius double"
    placed = cut(balls.select(F.lit(0).cast("long").alias("shard"), "ball", "x", "radius").mapInArrow(placing(top), schema))
    large = placed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).withColumn("every", F.ceil(F.col("n") / SUBSAMPLE))
    if not large.take(1):
        return placed

    def fit(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(table.num_rows, -1)
        k = max(1, min(len(x) // 10, 200, -(-3 * table["n"][0].as_py() // SHARD)))
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "centres": pa.array([_centroids(x, k).tobytes()], pa.binary())})

    some = placed.join(large, "shard").where(F.pmod(F.xxhash64("ball", F.lit("sample")), F.col("every")) == 0)
    fitted = some.select("shard", "n", "x").groupBy("shard").applyInArrow(fit, "shard bigint, centres binary").collect()  # at most 200 of each centroid
    inner = spark.sparkContext.broadcast({r["shard"]: bytes(r["centres"]) for r in fitted})

    def below(shard: int, raw: bytes) -> list[int]:
        c = inner.value.get(shard)
        return [shard] if c is None else [shard + 1 + int(k) for k in _nearest(np.frombuffer(c).reshape(-1, len(raw) // 8), np.frombuffer(raw), 2)]

    return cut(placed.mapInArrow(placing(below), schema))


def _ball_pairs(spark, balls: DataFrame, threshold: float, beam: int, overlap: int) -> DataFrame:
    """a, b (both ways), whole: leaders near enough for links; whole if all members are linked."""
    theta = float(np.arccos(threshold))
    placed = _placed(spark, balls, overlap)
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    placed = placed.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("ball"), F.col("parts")).cast("int"))
    index = placed.select("shard", "part", "ball", "x", "radius")

    def build(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(table.num_rows, -1)
        ids = table["ball"].to_numpy()
        return pa.Table.from_arrays([table["ball"], pa.array([ids[a] for a in _pruned(x)], pa.list_(pa.int64()))], names=["ball", "near"])

    graph = index.groupBy("shard", "part").applyInArrow(build, "ball bigint, near array<bigint>")
    united = graph.groupBy("ball").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list from each of OVERLAP shards
    nodes = index.join(united, "ball").withColumn("asks", F.lit(False))
    # a query visits every part of its shards; it needs no list there
    asked = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "part", "ball", "x", "radius", F.lit(None).cast("array<bigint>").alias("near"), F.lit(True).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        asks = np.array(table["asks"].to_pylist())
        x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(table.num_rows, -1)
        ids, radius = table["ball"].to_numpy(), table["radius"].to_numpy()
        own, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        out = [np.empty((0, 2), np.int64)]
        whole = [np.empty(0, bool)]
        if len(own) and len(q):
            order = np.argsort(ids[own])
            own = own[order]
            known, lists = ids[own], table["near"].to_pylist()
            links = []
            for i in own.tolist():
                near = np.array(lists[i], np.int64)
                at = np.minimum(np.searchsorted(known, near), len(known) - 1)
                links.append(np.unique(at[known[at] == near]))

            rq, ro, y, z = radius[q], radius[own], x[q], x[own]

            def in_range(i, j, c):
                return c >= np.cos(np.minimum(np.pi, theta + rq[i] + ro[j])) - _SLACK

            for i, j in _search(z, links, y, in_range, beam):
                s = np.concatenate([np.einsum("ij,ij->i", y[i[k : k + 65536]], z[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.empty(0)])
                a, b = q[i], own[j]
                apart = ids[a] != ids[b]
                a, b, s = a[apart], b[apart], s[apart]
                reach = radius[a] + radius[b]
                sure = np.where(reach == 0, s >= threshold, np.arccos(np.clip(s, -1, 1)) + reach <= theta - 1e-7)
                keep = sure | (reach > 0)
                out.append(np.column_stack([ids[a], ids[b]])[keep])
                whole.append(sure[keep])
        pairs, sure = np.concatenate(out), np.concatenate(whole)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(sure)], names=["a", "b", "whole"])

    found = nodes.select(*asked.columns).unionByName(asked).groupBy("shard", "part").applyInArrow(search, "a bigint, b bigint, whole boolean")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "whole"))
    return cut(both.groupBy("a", "b").agg(F.max("whole").alias("whole")))


def _counted(members: DataFrame, balls: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """ball, vec_id, vector, n_links and, for the graph of balls, the links that were found member by member."""
    sizes = balls.select(F.col("ball").alias("b"), F.col("size").alias("b_size"))
    whole = pairs.where("whole").join(sizes, "b").groupBy("a").agg(F.sum("b_size").alias("more"))
    base = balls.join(whole, F.col("ball") == F.col("a"), "left").select("ball", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("base"))
    doubt = pairs.where("not whole")
    touched = doubt.select(F.col("a").alias("ball")).distinct()
    # members of the balls in doubt, in blocks of at most some hundreds: a pair of balls is pairs of blocks, not of rows
    parts = balls.select("ball", F.ceil(F.col("size") / 256).cast("int").alias("parts"))
    some = members.join(touched, "ball", "left_semi").join(parts, "ball").withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")))
    blocks = cut(some.groupBy("ball", "part").agg(F.collect_list(F.struct("vec_id", "vector")).alias("rows")))
    one = blocks.select(F.col("ball").alias("a"), F.col("rows").alias("a_rows"))
    two = blocks.select(F.col("ball").alias("b"), F.col("rows").alias("b_rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column("a_rows")[k].as_py(), batch.column("b_rows")[k].as_py()
                x, y = (np.frombuffer(b"".join(r["vector"] for r in z)).reshape(len(z), -1) for z in (a, b))
                n = (x @ y.T >= threshold).sum(axis=1)
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("a")[k].as_py()] * len(hit), pa.int64()), pa.array([batch.column("b")[k].as_py()] * len(hit), pa.int64()), pa.array([a[i]["vec_id"] for i in hit], pa.int64()), pa.array([a[i]["vector"] for i in hit], pa.binary()), pa.array(n[hit].astype(np.int64))], names=["ball", "other", "vec_id", "vector", "n"])

    found = cut(doubt.select("a", "b").join(one, "a").join(two, "b").mapInArrow(compare, "ball bigint, other bigint, vec_id bigint, vector binary, n bigint"))
    extra = found.groupBy("ball", F.col("vec_id").alias("__id"), F.xxhash64("vector").alias("__v")).agg(F.sum("n").alias("n"))
    edges = pairs.where("whole").select("a", "b").unionByName(found.select(F.col("ball").alias("a"), F.col("other").alias("b"))).where("a < b").distinct()
    named = components(edges, "a", "b")
    group = balls.join(named, F.col("ball") == F.col("node"), "left").select("ball", "first", F.coalesce("component", "ball").alias("component"))
    smallest = group.groupBy("component").agg(F.min("first").alias("component_id"))
    about = base.join(group.join(smallest, "component").select("ball", "component_id"), "ball")
    # rows that share id and vector were counted once each: take the mean of their sum
    same = members.withColumn("__v", F.xxhash64("vector")).groupBy("ball", F.col("vec_id").alias("__id"), "__v").agg(F.count("*").alias("copies"))
    extra = extra.join(same, ["ball", "__id", "__v"]).select("ball", "__id", "__v", (F.col("n") / F.col("copies")).cast("long").alias("n"))
    wide = members.join(about, "ball").withColumn("__h", F.xxhash64("vector"))
    more = extra.withColumnRenamed("ball", "__ball")
    wide = wide.join(more, (F.col("ball") == F.col("__ball")) & F.col("vec_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__v")), "left")
    return wide.select("vec_id", "vector", (F.col("base") + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")


def _result(folded: DataFrame, members: DataFrame, balls: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    alone = folded.where("leader is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = counts.select("vec_id", "n_links", "component_id").unionByName(alone)
    return rows.select(F.col("vec_id").alias(key), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _recall(spark, members: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The mean, over AUDIT rows drawn by hash that have links, of the share of their links that was counted."""
    rows = counts.select("vec_id", "vector", "n_links").orderBy(F.xxhash64("vec_id", "vector", F.lit("audit")), "vec_id").limit(AUDIT).collect()
    if not rows:
        return 1.0
    sample = spark.sparkContext.broadcast([r["vector"] for r in rows])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sample.value), np.int64)
        by_length: dict[int, list[int]] = {}
        for i, raw in enumerate(sample.value):
            by_length.setdefault(len(raw), []).append(i)
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            for length, at in by_length.items():
                own = [x for x in blobs if len(x) == length]
                if own:
                    q = np.frombuffer(b"".join(sample.value[i] for i in at)).reshape(len(at), -1)
                    total[at] += (q @ np.frombuffer(b"".join(own)).reshape(len(own), -1).T >= threshold).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

    true = {r["i"]: r["n"] - 1 for r in members.select("vector").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    shares = [min(1.0, r["n_links"] / true[i]) for i, r in enumerate(rows) if true[i]]
    return sum(shares) / len(shares) if shares else 1.0
