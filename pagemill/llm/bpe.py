"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every match of the pre-token pattern is merged on its own. The queue has one bucket per merge rank; a bucket
holds linked-list positions whose pair has that rank. A two-level bitmap, 256-way, marks the buckets in use, so
find-first-set names the lowest rank in two steps whatever the length of the pre-token. Pairs that a merge
destroys stay queued; a popped entry whose pair has changed is stale and is skipped. A pre-token of n bytes costs
O(n log n) at worst (the log within a bucket), so a megabyte without a space is no special case.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .common import utf8

#: Entries of each memo of a Python worker; a full memo becomes the old generation.
MEMO = 400_000


class Codec:
    """Encodes and decodes with the ranks of a tiktoken file; special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        #: Leaves of the bitmap, 256 ranks each; the root is an integer with one bit for each leaf. All zero between merges.
        self.leaves = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.bits = [1 << k for k in range(max(256, len(self.leaves)))]
        self.text_of = {str(i): token for token, i in ranks.items()}
        self.whole = {token: str(i) for token, i in ranks.items()}
        #: Ids of pre-tokens and of stretches of them; a pre-token alone is cut into itself, so one memo serves both.
        self.memo: list[dict[str, str]] = [{}, {}]

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token.

        A token is known by its first position i: it spans piece[i:after[i]], and after[i] is the next token.
        rank_of[i] is the rank of the pair that starts at i, by which stale entries are told.
        """
        rank = self.ranks.get
        if (whole := rank(piece)) is not None:
            return [whole]
        n, leaves, root, bit = len(piece), self.leaves, 0, self.bits
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = [rank(piece[i : i + 2], -1) for i in range(n - 1)]
        rank_of.append(-1)
        buckets: dict[int, list[int]] = {}
        for i, r in enumerate(rank_of):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    leaves[r >> 8] |= bit[r & 255]
                    root |= bit[r >> 8]
        while root:
            leaf = (root & -root).bit_length() - 1
            bits = leaves[leaf]
            low = bits & -bits
            now = (leaf << 8) + low.bit_length() - 1
            leaves[leaf] = bits = bits ^ low
            if not bits:
                root ^= bit[leaf]
            bucket = buckets.pop(now)
            if len(bucket) > 1:
                bucket.sort()
            for at, i in enumerate(bucket):
                if rank_of[i] != now:
                    continue  # stale
                j = after[i]
                k = after[j]
                after[i], rank_of[j] = k, -1
                lowest = now
                if k < n:
                    before[k] = i
                    rank_of[i] = r = rank(piece[i : after[k]], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            leaves[r >> 8] |= bit[r & 255]
                            root |= bit[r >> 8]
                        if r < lowest:
                            lowest = r
                else:
                    rank_of[i] = -1
                if (h := before[i]) >= 0:
                    rank_of[h] = r = rank(piece[h:k], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            buckets[r] = [h]
                            leaves[r >> 8] |= bit[r & 255]
                            root |= bit[r >> 8]
                        if r < lowest:
                            lowest = r
                if lowest < now and at + 1 < len(bucket):  # a lower rank has come up: the rest of this bucket waits
                    buckets[now] = bucket[at + 1 :]
                    leaves[leaf] |= low
                    root |= bit[leaf]
                    break
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : after[i]]))
            i = after[i]
        return out

    def _keep(self, key: str, ids: str) -> None:
        if len(key) < 64:
            if len(self.memo[0]) >= MEMO:
                self.memo = [{}, self.memo[0]]
            self.memo[0][key] = ids

    def _chunk(self, chunk: str) -> str:
        """Decimal ids, joined by commas, of a stretch of whole pre-tokens that the memo lacks."""
        new, old = self.memo
        if (ids := old.get(chunk)) is None:
            pieces = () if chunk.isalpha() or chunk[1:].isalpha() and chunk[0] == " " else self.pattern.findall(chunk)
            if len(pieces) <= 1:
                raw = chunk.encode()
                ids = self.whole.get(raw) or ",".join(map(str, self.merge(raw)))
            else:
                ids = ",".join([new.get(x) or self._chunk(x) for x in pieces])
        self._keep(chunk, ids)
        return ids

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas.

        A space with no white space beside it always starts a pre-token, and none crosses it, so a text may be
        cut there; what lies between such cuts is memoised.
        """
        if not text:
            return ""
        if text[0] == " " or text[-1] == " " or _BESIDE.search(text):
            parts = _CUT.split(text)
        else:
            parts = text.split(" ")
        out = [self._chunk(parts[0])]
        for part in parts[1:]:
            chunk = " " + part
            out.append(self.memo[0].get(chunk) or self._chunk(chunk))
        return ",".join(out)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids.split(","))) if ids else b""


_BESIDE = regex.compile(r"[\s\x1c-\x1f] | [\s\x1c-\x1f]")
_CUT = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in lines.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


@lru_cache(maxsize=2)
def codec(name: str, pattern: str) -> Codec:
    """The codec of a vocabulary file shipped to the executors; kept over the tasks of a Python worker."""
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(parse_ranks(f.read()), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds `ids` (array of int) and `decoded` (binary) to the columns of `keep`; one row per input row.

    A null or empty text has no ids and decodes to no bytes. Repeated rows are encoded each. Columns besides
    `keep` and `text` are ignored whatever their names.
    """
    return _mapped(docs, ranks_path, pattern, text, keep, pa.list_(pa.int32()), "array<int>", lambda ids: [int(x) for x in ids.split(",")] if ids else [], pa.binary(), "binary", lambda raw: raw, ("ids", "decoded"))


def digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As `encode`, but with SHA-256 of the joined ids and of the decoded bytes, for comparing whole tables."""
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, ranks_path, pattern, text, keep, pa.string(), "string", lambda ids: digest(ids.encode()), pa.string(), "string", digest, ("ids_sha256", "decoded_sha256"))


def _mapped(docs, ranks_path, pattern, text, keep, ids_type, ids_ddl, of_ids, raw_type, raw_ddl, of_raw, names):
    spark = docs.sparkSession
    spark.sparkContext.addFile(ranks_path)  # the file goes to every executor, late ones included
    name = ranks_path.rsplit("/", 1)[-1]
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                n, ids, raw = [], [], []
                for x in part.column("__text").to_pylist():
                    joined = c.encode(x or "")
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(of_ids(joined))
                    raw.append(of_raw(c.decode(joined)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, ids_type), pa.array(raw, raw_type)], names=[*keep, "n_tokens", *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kept}, n_tokens bigint, {names[0]} {ids_ddl}, {names[1]} {raw_ddl}")
