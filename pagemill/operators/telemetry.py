"""Host governor, request spacing, bandwidth, robots rules and log lines, as derived tables over recorded events."""

from __future__ import annotations

from collections.abc import Iterator
from urllib import robotparser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagemill.functions import urls as u, vocab as v

#: Seconds that a host rests after 429 and after another error, errors in a row that end it, and the yield that opens it.
REST_429, REST_ERROR, ERRORS, YIELD = 5.0, 2.0, 3, 5


def governed(events: DataFrame, most: int = 6) -> DataFrame:
    """What the governor knew before each event (seq, ts in seconds, host, outcome, found) of its host.

    outcome: ok, rate_limited, error or login_wall. Adds `available` (the host had neither failed nor was resting) and
    `allowed` (workers: one until it yielded enough). A success ends a row of errors, a 429 neither adds nor ends.
    Needs one sort of each host's events.
    """
    by = W.partitionBy("host").orderBy("seq")
    before, upto = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("__run", F.count_if(F.col("outcome") == "ok").over(upto))
    in_row = F.count_if(F.col("outcome") == "error").over(W.partitionBy("host", "__run").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__row", in_row)
    fatal = (F.col("outcome") == "login_wall") | ((F.col("outcome") == "error") & (F.col("__row") >= ERRORS))
    until = F.when(F.col("outcome") == "rate_limited", F.col("ts") + REST_429).when((F.col("outcome") == "error") & ~fatal, F.col("ts") + REST_ERROR)
    rows = rows.withColumns({"__fatal": fatal, "__until": until})
    failed = F.coalesce(F.bool_or("__fatal").over(before), F.lit(False))
    rest = F.coalesce(F.last("__until", ignorenulls=True).over(before) > F.col("ts"), F.lit(False))
    found = F.coalesce(F.sum("found").over(before), F.lit(0))
    return rows.select(*events.columns, (~failed & ~rest).alias("available"), F.when(found >= YIELD, most).otherwise(1).alias("allowed"))


def spaced(requests: DataFrame, interval: float) -> DataFrame:
    """When each request (seq, ts in seconds, host) may start if a host's requests keep an interval.

    A start is the arrival or the last start and the interval, whichever is later; so it is the running maximum of the
    arrivals, each less the intervals before it, and the intervals up to it.
    """
    by = W.partitionBy("host").orderBy("seq")
    rows = requests.withColumn("__n", (F.row_number().over(by) - 1) * F.lit(float(interval)))
    start = F.max(F.col("ts") - F.col("__n")).over(by.rowsBetween(W.unboundedPreceding, 0)) + F.col("__n")
    return rows.withColumn("start", start).drop("__n")


def throttled(blocks: DataFrame, rate: float, key: str = "host", burst: float = 0.5, longest: float = 5.0) -> DataFrame:
    """The pause after each block (seq, ts in seconds, bytes) of a token bucket of `rate` bytes a second, by key.

    The bucket holds `burst` seconds. ts is when the block would come without any pause, so what came before moves it.
    A fold in order over sorted partitions: memory doesn't grow with a key's rows.
    """
    rows = blocks.select(key, "seq", F.col("ts").cast("double").alias("ts"), F.col("bytes").cast("double").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, tokens, last, moved = object(), 0.0, 0.0, 0.0
        for batch in batches:
            pauses = []
            for name, ts, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if name != open_key:
                    open_key, tokens, last, moved = name, rate * burst, ts, 0.0
                now, pause = ts + moved, 0.0
                if size > 0 and rate > 0:
                    tokens = min(rate * burst, tokens + (now - last) * rate) - size
                    last = now
                    if tokens < 0:
                        pause = min(longest, max(0.001, -tokens / rate))
                        last, moved, tokens = now + pause, moved + pause, 0.0
                pauses.append(pause)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pauses, pa.float64())], names=[key, "seq", "pause"])

    kinds = dict(rows.dtypes)
    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(run, f"`{key}` {kinds[key]}, seq {kinds['seq']}, pause double")


def robots_allowed(links: DataFrame, robots: DataFrame, agent: str = "*", link: str = "url") -> DataFrame:
    """The links (any columns) with `allowed` by the robots files (host, body) of their hosts; no file allows all.

    Hosts are joined once and each file is read once a batch of its links.
    """
    rules = robots.groupBy("host").agg(F.max("body").alias("__robots")).withColumnRenamed("host", "__host")
    rows = links.join(rules, u.host(F.col(link)) == F.col("__host"), "left")

    @F.pandas_udf("boolean")
    def run(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        known: dict[str, robotparser.RobotFileParser] = {}
        out = []
        for url, body in zip(urls, bodies, strict=True):
            if not body or not url:
                out.append(True)
                continue
            if body not in known:
                known[body] = robotparser.RobotFileParser()
                known[body].parse(body.splitlines())
            out.append(known[body].can_fetch(agent, url))
        return pd.Series(out, dtype=bool)

    return rows.select(*links.columns, run(F.col(link), F.col("__robots")).alias("allowed"))


def line_kind(line: Column) -> Column:
    """What a log line counts as: page, image, video or error; null for none. The first test that holds decides."""
    low = F.lower(line)
    saved = F.contains(low, F.lit("downloaded "))
    fetched = u.any_of(low, v.FETCH_LINES)
    return (
        F.when(fetched, F.when(~u.any_of(low, v.LOG_FETCHED_FILES), "page"))
        .when(saved, F.when(F.contains(low, F.lit("images")) | u.any_of(low, v.LOG_IMAGES), "image").when(F.contains(low, F.lit("videos")) | u.any_of(low, v.LOG_VIDEOS), "video"))
        .when(u.any_of(F.upper(line), v.LOG_ERRORS), "error")
    )


def progress(bar: Column) -> Column:
    """percent, current, total and time of a progress bar; zeros and the empty text where it doesn't say."""
    number = lambda pattern, k: F.coalesce(F.regexp_extract(bar, pattern, k).try_cast("int"), F.lit(0))
    return F.struct(number(r"(\d+)%", 1).alias("percent"), number(r"(\d+)/(\d+)", 1).alias("current"), number(r"(\d+)/(\d+)", 2).alias("total"), F.regexp_extract(bar, r"\[([^\]]+)\]", 1).alias("time"))


def log_lines(raw: DataFrame, line: str = "value") -> DataFrame:
    """bar and line of raw output: carriage returns part lines, what stands before a time stamp is a progress bar."""
    keep = [c for c in raw.columns if c != line]
    rows = raw.select(*keep, F.explode(F.split(F.col(line), "\r")).alias("__line")).withColumn("__line", F.trim(F.regexp_replace("__line", "\n", ""))).where("__line <> ''")
    stamp = r"^(.*?)(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.*)$"
    text, stamped = F.col("__line"), F.col("__line").rlike(stamp)
    bar_only = F.contains(text, F.lit("Fetching pages:")) & text.rlike("[%|]")
    bar = F.when(stamped, F.trim(F.regexp_extract(text, stamp, 1))).when(bar_only, text).otherwise("")
    rest = F.when(stamped, F.trim(F.regexp_extract(text, stamp, 2))).when(bar_only, "").otherwise(text)
    return rows.select(*keep, bar.alias("bar"), rest.alias("line"))


def line_counts(lines: DataFrame) -> DataFrame:
    """Pages, images, videos and errors of log lines, in batch or stream."""
    kind = line_kind(F.col("line"))
    return lines.select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("page", "image", "video", "error")])


def lines_from(lines: DataFrame, offset: int) -> DataFrame:
    """Lines (seq from 0) from an offset on; all of them where it lies beyond the end."""
    last = lines.agg(F.max("seq")).first()[0]
    return lines.where(F.col("seq") >= (0 if last is None or offset > last + 1 else offset))
