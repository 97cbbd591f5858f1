"""WARC archives: writing with de-duplication and segmentation, and reading with segment reassembly.

Writing. Each page is one HTTP response with chunked transfer framing. Of pages with equal payloads of at least
`min_bytes` the one with the largest id is a `response` record, the others are `revisit` records that refer to it. A
block longer than `segment_bytes` is cut: the first segment keeps the record's type, the others are `continuation`
records with the first one's id as origin and a segment number; the last gives the total length. Records are valid
UTF-8 (cuts fall between characters), so Spark's own text writer makes the archive files, with the blank lines
that end a record as line separator; it works on whatever store the session writes to and commits each file once.

Reading. Files are parsed by Content-Length. Continuations are grouped by origin, ordered by segment number and
checked against the total length; then the chunked framing is undone. Only segmented records are shuffled. The files
hold at most RECORDS records of `segment_bytes`, which bounds what one task holds.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_dir

#: Records a file, and about how many bytes of them at most; bytes a chunk.
RECORDS, FILE_BYTES = 1000, 64 << 20
CHUNK = 4096
_END = b"\r\n\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 9562

_PARSED = (
    "record_id string, record_type string, target string, page_id bigint, digest string, refers_to bigint, length bigint, "
    "segment int, origin string, total bigint, block binary"
)


def cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most `size` bytes that split no UTF-8 character."""
    start = 0
    while start < len(data):
        end = min(len(data), start + max(4, size))
        while end < len(data) and end > start + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[start:end]
        start = end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in cuts(payload, size)) + b"0" + _END


def unchunked(body: bytes) -> bytes | None:
    """The payload under chunked transfer framing (extensions and trailers are skipped); None if it is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        at = line + 2
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{page_id}/{digest}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    """One record without the two line ends behind it."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head + block.decode()


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[str]:
    digest = base32_sha1(payload)
    own = record_id(page_id, digest)
    url = None if url is None else "".join(c if " " < c < "\x7f" or c > "\x9f" else f"%{ord(c):02X}" for c in url)
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = [("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        about = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to), ("X-Payload-Length", len(payload))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *about, *http], head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked" + _END + chunked(payload)
    parts = list(cuts(block, segment_bytes))
    first = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *first, *http], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if i == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{own}/{i}')}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i), *last], part)


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = 1 << 20) -> None:
    """Writes the archive of pages (page_id, url, html) to a new folder `path`.

    A null html is an empty payload. Rows with a null id are responses unless an equal payload has an id. Rows that
    repeat a page, id and payload, are all written. An empty table makes an archive without records. A file holds at
    most about FILE_BYTES, as records are cut into segments; a reader takes a file at a time into memory.
    """
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    equal = source.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null")
    # written, so that the next plan knows its size and moves the pages only where it is large
    equal.select(F.col("sha").alias("same"), "kept").write.parquet(f"{path}.equal")
    equal = spark.read.parquet(f"{path}.equal")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("kept")), F.col("kept"))
    planned = source.join(equal, source["sha"] == equal["same"], "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = [r for row in part.to_pylist() for r in records(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    made = planned.mapInArrow(build, "value string")
    made.write.option("lineSep", _END.decode()).option("maxRecordsPerFile", max(1, min(RECORDS, FILE_BYTES // segment_bytes))).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers with lower-case names, block) of each record of a file.

    What is no record is passed over up to the next line that starts one; a block that the file's end cuts off is None.
    """
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(_END, at) if data.startswith(b"WARC/", at) else -1
        headers = {}
        if end >= 0:
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = _number(headers.get("content-length"))
        if length is None:
            at = data.find(b"\nWARC/", at + 1) + 1
            if at == 0:
                return
            continue
        start, at = end + 4, end + 4 + length
        yield headers, data[start:at] if at <= len(data) else None


def _number(x: str | None) -> int | None:
    """A header's value as a number of 18 digits at most, else None."""
    return int(x) if x is not None and x.isascii() and x.isdigit() and len(x) < 19 else None


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block, transfer framing undone; None if the framing is broken."""
    head, gap, body = block.partition(_END)
    if not gap:
        return None
    is_chunked = any(x.partition(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(b"\r\n")[1:])
    return unchunked(body) if is_chunked else body


def read(spark: SparkSession, path: str, files: str = "part-*") -> DataFrame:
    """One row per response or revisit record: record_id, record_type, url, page_id, digest, refers_to, length
    (of the payload that a revisit refers to), payload, complete.

    `payload` is null for revisits, and where segments lack, are cut off, differ between copies or break the framing
    (`complete` is then false). What is no record is passed over. An archive without records gives no rows.
    """
    contents = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("record_id", "record_type", "target", "page_id", "digest", "refers_to", "length", "segment", "origin", "total", "block")
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary())

        number = _number
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(content.as_py()):
                    kind, own = h.get("warc-type"), h.get("warc-record-id")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    rows.append((own, kind, h.get("warc-target-uri"), number(h.get("x-page-id")), h.get("warc-payload-digest"), number(h.get("x-refers-to-page-id")), number(h.get("x-payload-length")), number(h.get("warc-segment-number")), h.get("warc-segment-origin-id", own), number(h.get("warc-segment-total-length")), block))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    parsed = contents.mapInArrow(run, _PARSED)
    about = ("record_type", "target", "page_id", "digest", "refers_to", "length")
    whole = parsed.where("segment is null").select("record_id", *about, F.array("block").alias("blocks"), F.col("block").isNotNull().alias("complete"))
    # equal copies of a segment fold before the shuffle's end; the first segment counts how often its record stands there
    content = F.xxhash64("block", "total")
    each = parsed.where("segment is not null").groupBy("origin", "segment").agg(F.min_by(F.struct(*about, "total", "block"), content).alias("one"), (F.min(content) == F.max(content)).alias("same"), F.count("*").alias("n")).select("origin", "segment", "one.*", "same", "n")
    of_first = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in (*about, "n")]
    joined = each.groupBy("origin").agg(*of_first, F.max("total").alias("total"), F.count("*").alias("found"), F.max("segment").alias("last"), F.sum(F.length("block")).alias("bytes"), F.bool_and(F.col("same") & F.col("block").isNotNull()).alias("same"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    complete = F.col("same") & (F.col("found") == F.col("last")) & F.coalesce(F.col("bytes") == F.col("total"), F.lit(False))
    joined = joined.where("n is not null").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    joined = joined.select(F.col("origin").alias("record_id"), *about, F.when(complete, F.col("parts.block")).alias("blocks"), complete.alias("complete"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                payload = [None if kind == "revisit" or x is None or None in x else payload_of(b"".join(x)) for kind, x in zip(part.column(1).to_pylist(), part.column(7).to_pylist(), strict=True)]
                done = [ok and (kind == "revisit" or x is not None) for ok, kind, x in zip(part.column(8).to_pylist(), part.column(1).to_pylist(), payload, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:7], pa.array(payload, pa.binary()), pa.array(done, pa.bool_())], names=["record_id", "record_type", "url", "page_id", "digest", "refers_to", "length", "payload", "complete"])

    schema = "record_id string, record_type string, url string, page_id bigint, digest string, refers_to bigint, length bigint, payload binary, complete boolean"
    return whole.unionByName(joined).select("record_id", *about, "blocks", "complete").mapInArrow(decode, schema)


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0, segment_bytes: int = 16384) -> DataFrame:
    """Writes pages to an archive (by default in the shared folder) and reads it back; one row per input row.

    Columns: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to, complete. A
    revisit has no payload of its own: its length and digest are those its headers give for the response's.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/pagemill-warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes, segment_bytes)
    found = read(spark, path)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, payloads, written, lengths = (batch.column(i).to_pylist() for i in (1, 7, 4, 6))
            size = [n if k == "revisit" else None if x is None else len(x) for k, x, n in zip(kinds, payloads, lengths, strict=True)]
            digest = [w.removeprefix("sha1:") if k == "revisit" else None if x is None else base32_sha1(x) for k, x, w in zip(kinds, payloads, written, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(size, pa.int64()), pa.array(digest, pa.string()), batch.column(1), batch.column(5), batch.column(8)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete"])

    return found.mapInArrow(measure, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, complete boolean")
