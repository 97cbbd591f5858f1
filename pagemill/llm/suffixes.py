"""External induced suffix sorting with common-prefix lengths, in whole blocks.

Suffixes are L or S by how they compare with the next one. The order of the leftmost S suffixes (LMS) induces that of
all L suffixes in a scan from the smallest, and the L suffixes that of all S suffixes in a scan from the largest. Each
scan keeps a priority queue with one bucket for each first byte. Within a bucket the order of arrival is the order of
the suffixes, so a bucket is popped as a block of tuples (position, common prefix with the one before), and what the
block induces is pushed in blocks. The common prefix of two induced neighbours is one more than the least
common prefix on the way between the suffixes that induced them. Buckets beyond the memory allowed go to disk and
come back in order, so the queues hold shards larger than memory.

Prefixes longer than `depth` are never told apart. That bounds the recursion as well: the LMS suffixes are put in
order by their first `depth` bytes, as words, rather than by naming them and sorting the string of names in turn.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

SEPARATOR, END = 0xFF, 0  # neither is in encoded text
JOINED = 1 << 20


def encoded(parts: list[bytes]) -> np.ndarray:
    """Texts in UTF-8 as one array, each followed by a separator, and the end mark."""
    raw = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8).copy()
    raw[raw != SEPARATOR] += 1  # UTF-8 has no byte above 0xF4
    return np.append(raw, np.uint8(END))


class Spool:
    """Blocks by bucket, first in, first out; beyond `memory` bytes they are kept in a scratch file of the task."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.blocks: list[list] = [[] for _ in range(256)]
        self.file = None

    def push(self, bucket: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[bucket].append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115 - gone when the spool is
        self.file.seek(0, 2)
        for blocks in self.blocks:
            for i, block in enumerate(blocks):
                if isinstance(block[0], np.ndarray):
                    where = self.file.tell()
                    self.file.write(block[0].tobytes())
                    self.file.write(block[1].tobytes())
                    blocks[i] = (where, len(block[0]))
        self.held = 0

    def _load(self, block) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            self.held -= block[0].nbytes + block[1].nbytes
            return block
        where, n = block
        self.file.seek(where)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)

    def pop(self, bucket: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The bucket's first blocks as one, up to JOINED tuples; with `last` its last block."""
        blocks = self.blocks[bucket]
        if not blocks:
            return None
        if last:
            return self._load(blocks.pop())
        taken, count = 0, 0
        while taken < len(blocks) and count < JOINED:
            block = blocks[taken]
            count += len(block[0]) if isinstance(block[0], np.ndarray) else block[1]
            taken += 1
        loaded = [self._load(x) for x in blocks[:taken]]
        del blocks[:taken]
        return loaded[0] if taken == 1 else (np.concatenate([x for x, _ in loaded]), np.concatenate([y for _, y in loaded]))


class _Scan:
    """One scan: takes blocks in order and pushes what they induce."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, wanted: bool, depth: int, spool: Spool):
        self.text, self.kind, self.wanted, self.depth, self.spool = text, kind, wanted, depth, spool
        self.least = np.full(256, depth, np.uint8)  # common prefix since the last push to each bucket
        self.used = np.zeros(256, bool)

    def take(self, at: np.ndarray, lcp: np.ndarray) -> None:
        before = at - 1
        if before.min() < 0:
            index = np.flatnonzero((before >= 0) & (self.kind[before] == self.wanted))
        else:
            index = np.flatnonzero(self.kind[before] == self.wanted)
        n, least = len(at), self.least.copy()
        np.minimum(self.least, lcp.min(), out=self.least)
        if len(index) == 0:
            return
        first = self.text[before[index]]
        order = np.argsort(first, kind="stable")
        index, first = index[order], first[order]
        edges = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(first)]])
        heads, tails = edges[:-1], edges[1:] - 1
        buckets = first[heads]
        # least common prefix since the last push to the same bucket, by a table of minima over powers of two
        since = np.empty(len(index), np.int64)
        since[1:] = index[:-1] + 1
        since[heads] = 0
        last = index[tails]
        lows, rest = _minima(lcp, np.concatenate([since, np.minimum(last + 1, n - 1)]), np.concatenate([index, np.full(len(last), n - 1)]), len(index))
        rest[last + 1 > n - 1] = self.depth
        lows[heads] = np.minimum(lows[heads], least[buckets])
        pushed = np.minimum(lows, self.depth - 1) + np.uint8(1)
        pushed[heads[~self.used[buckets]]] = 0
        self.used[buckets] = True
        self.least[buckets] = rest
        moved = before[index]
        push = self.spool.push
        for c, x, y in zip(buckets.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            push(c, moved[x:y], pushed[x:y])


def _minima(values: np.ndarray, start: np.ndarray, end: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Least values from start to end, both included; in two parts."""
    power = np.frexp(end - start + 1)[1] - 1
    table = [values]
    for k in range(int(power.max(initial=0))):
        table.append(np.concatenate([np.minimum(table[k][: -(1 << k)], table[k][1 << k :]), table[k][len(table[k]) - (1 << k) :]]))
    table = np.concatenate(table)
    row = power.astype(np.int64) * len(values)
    out = np.minimum(table[row + start], table[row + end - (1 << power.astype(np.int64)) + 1])
    return out[:split], out[split:]


def _words(text: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    view = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    return [view[at + k].astype(np.uint64) for k in range(0, depth, 8)]


def _sorted_lms(text: np.ndarray, lms: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    words = _words(text, lms, depth)
    order = np.lexsort(words[::-1])
    lcp = np.zeros(len(lms), np.int64)
    alike = np.ones(max(0, len(lms) - 1), bool)
    for w in words:
        x = w[order]
        x = x[1:] ^ x[:-1]
        zeros = np.zeros(len(x), np.int64)
        for k in range(1, 9):
            zeros += (x >> np.uint64(64 - 8 * k)) == 0
        lcp[1:] += np.where(alike, zeros, 0)
        alike &= x == 0
    return lms[order], np.minimum(lcp, depth).astype(np.uint8)


def induced(text: np.ndarray, depth: int, memory: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, common prefix with the suffix before) of all suffixes, from the largest to the smallest.

    text ends with the only END. Common prefixes count to `depth` at most (255 at most); suffixes with a longer one
    come in any order.
    """
    if not 0 < depth < 256:
        raise ValueError("depth must be 1 to 255")
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
        return
    ends = np.where(text[:-1] != text[1:], np.arange(n - 1), n)
    ends = np.minimum.accumulate(ends[::-1])[::-1]  # where the run of equal bytes ends
    kind = np.append((text[:-1] < text[1:])[ends], True)  # True: S
    run = np.append(np.minimum(ends - np.arange(n - 1) + 1, depth), 1).astype(np.uint8)
    del ends
    lms, lms_lcp = _sorted_lms(text, np.flatnonzero(kind[1:] & ~kind[:-1]) + 1, depth)
    firsts = np.searchsorted(text[lms], np.arange(257))

    larger, kept = Spool(memory // 2), Spool(memory // 2)
    scan = _Scan(text, kind, False, depth, larger)
    for c in range(256):
        last = None
        while (block := larger.pop(c)) is not None:
            kept.push(c, *block)
            scan.take(*block)
            last = block[0][-1]
        a, b = firsts[c], firsts[c + 1]
        if a < b:
            lcp = lms_lcp[a:b].copy()
            lcp[0] = 0 if last is None else min(run[last], run[lms[a]])
            scan.take(lms[a:b], lcp)

    smaller = Spool(memory // 2)
    scan = _Scan(text, kind, True, depth, smaller)
    smaller.push(END, np.array([n - 1]), np.zeros(1, np.uint8))
    for c in range(255, -1, -1):
        last = None
        while (block := smaller.pop(c)) is not None:
            yield block
            scan.take(*block)
            last = block[0][-1]
        after = None  # of the block before, in descending order: its smallest suffix's common prefix with the next
        while (block := kept.pop(c, last=True)) is not None:
            at, up = block[0][::-1], block[1][::-1]
            lcp = np.empty_like(up)
            lcp[1:] = up[:-1]
            lcp[0] = after if after is not None else 0 if last is None else min(run[last], run[at[0]])
            after = up[-1]
            yield at, lcp
            scan.take(at, lcp)


def smallest_owner(text: np.ndarray, owner: np.ndarray, depth: int, memory: int = 256 << 20) -> np.ndarray:
    """For each position the smallest owner of all positions with the same next `depth` bytes."""
    out = np.empty(len(text), np.int64)
    held: list[np.ndarray] = []
    least = 0

    def settle(low: int) -> None:
        for at in held:
            out[at] = low
        held.clear()

    for at, lcp in induced(text, depth, memory):
        starts = np.flatnonzero(lcp < depth)
        own = owner[at]
        if len(starts) == 0:  # all of it goes on with the last group
            held.append(at)
            least = min(least, int(own.min()))
            continue
        if starts[0] > 0:
            held.append(at[: starts[0]])
            least = min(least, int(own[: starts[0]].min()))
        settle(least)
        lows = np.minimum.reduceat(own, starts)
        sizes = np.diff(np.append(starts, len(at)))
        out[at[starts[0] : starts[-1]]] = np.repeat(lows[:-1], sizes[:-1])
        held.append(at[starts[-1] :])
        least = int(lows[-1])
    settle(least)
    return out
