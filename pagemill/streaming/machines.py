"""Stateful machines over telemetry: the same fold in batch and in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

PAUSES = (30, 120, 600)
BLACKLIST = 36_000
RUN = 3

_OUT = "host string, seq bigint, event string, pause_s bigint, level int"


class Cooldown:
    """Three failures in a row pause a host, longer each time; the fourth time it is blacklisted. A success ends a run."""

    def __init__(self, run: int = 0, level: int = 0):
        self.run, self.level = run, level

    def see(self, status: int) -> tuple[str, int] | None:
        if status == 200:
            self.run = 0
            return None
        self.run += 1
        if self.run < RUN:
            return None
        self.run = 0
        self.level += 1
        return ("cooldown", PAUSES[self.level - 1]) if self.level <= len(PAUSES) else ("blacklisted", BLACKLIST)


def cooldowns(log: DataFrame) -> DataFrame:
    """Pauses of each host's log (host, seq, status) in order of seq.

    A host's rows are streamed in batches through the fold, in order, never held together: the sort is the shuffle's,
    so a host with a third of all rows costs time in one task but no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = None, Cooldown()
        for pdf in batches:
            out = []
            for h, seq, status in zip(pdf["host"], pdf["seq"], pdf["status"], strict=True):
                if h != host:
                    host, state = h, Cooldown()
                if (fired := state.see(status)) is not None:
                    out.append((h, seq, *fired, state.level))
            yield pd.DataFrame(out, columns=["host", "seq", "event", "pause_s", "level"])

    rows = log.select("host", "seq", "status").repartition("host").sortWithinPartitions("host", "seq")
    return rows.mapInPandas(run, _OUT)


def backoff(yields: list[int], least: float, most: float) -> list[float]:
    """Delay after each cycle: the least after a yield, else twice the last one, up to the most."""
    out, now = [], least
    for y in yields:
        now = least if y > 0 else min(most, now * 2)
        out.append(now)
    return out


def deduplicated(stream: DataFrame, days: int = 30) -> DataFrame:
    """First sighting of each URL hash within the retention; later ones come through again (R3)."""
    return stream.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["url_hash"])


def pressure(stream: DataFrame) -> DataFrame:
    """Failures by host in sliding hours, for streams and tables alike."""
    kept = stream.withWatermark("ts", "10 minutes") if stream.isStreaming else stream
    return kept.groupBy("host", F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count_if(F.col("status") == 429).alias("n429"), F.count("*").alias("n")).select("host", F.col("w.start").alias("start"), "n429", "n")


def cooldown_stream(log: DataFrame) -> DataFrame:
    """The cooldown machine over a stream of (host, seq, status): each host's state is kept between micro-batches.

    Within a micro-batch a host's rows are taken in order of seq.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = Cooldown(*state.get) if state.exists else Cooldown()
        rows = sorted((seq, status) for pdf in frames for seq, status in zip(pdf["seq"], pdf["status"], strict=True))
        fired = [(key[0], seq, *x, machine.level) for seq, status in rows if (x := machine.see(status)) is not None]
        state.update((machine.run, machine.level))
        yield pd.DataFrame(fired, columns=["host", "seq", "event", "pause_s", "level"])

    return log.groupBy("host").applyInPandasWithState(run, _OUT, "run int, level int", "append", "NoTimeout")
