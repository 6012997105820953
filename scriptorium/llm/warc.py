"""WARC archives: written in segments with chunked transfer framing, read back and reassembled.

Writing. Every page becomes one record: `response` for the smallest page_id of its payload, `revisit` for others.
A response's block is an HTTP message whose body is framed in chunks. A block longer than `segment_bytes` is split:
the first segment is the record itself (WARC-Segment-Number: 1), the others are `continuation` records that name
it in WARC-Segment-Origin-ID; the last one states WARC-Segment-Total-Length. Records are written by Spark's text
writer, whose separator is the CRLF CRLF that ends a WARC record, so the usual commit protocol covers lost executors.
Roles follow from digests and page_ids alone; a payload is exchanged only if a bitmap of copied digests holds it.

Reading. Files are parsed by Content-Length, one stream per file. Whole records are decoded where they are;
segments are grouped by origin, ordered by number, checked for gaps and against the stated total length, and then
decoded. Revisits take the payload's length from the response they refer to.

A record's id is made of the page_id, the payload's digest and a counter of rows that share both, so a task that runs again
writes the same ids, and what a revisit names exists.

Null payloads count as empty; empty payloads are compared like others. Empty tables give no rows. Repeated page
ids: each row is written as its own record, and the smallest page_id is the response once; its further rows
with the same payload revisit it. A null page_id comes after all others and is read back as null; of rows that share page_id and
payload the least url is written for all. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, fresh_path, paths, stash

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Records in one file at most; with SEGMENT_BYTES a bound on what a reading task takes in.
FILE_RECORDS = 8_192
#: Bits of one bitmap of Spark's, bits for each payload that has copies, and bitmaps at most (16 MB).
BUCKET_BITS, BITS_EACH, MAX_BUCKETS = 32_768, 16, 4_096
DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(part), part) for i in range(0, len(payload), size) for part in [payload[i : i + size]]]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != CRLF:
            raise ValueError("broken chunk")
        out.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message, its transfer framing removed."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _name(page_id: object, sha: str, number: int) -> str:
    return f"urn:page:{'' if page_id is None else quote(str(page_id), safe='')}:{sha}:{number}"


def _records(number: int, page_id: object, url: str | None, payload: bytes | None, sha: str, first: tuple | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one row; `number` tells rows of one page and payload apart, `first` holds the page_id that a revisit refers to."""
    own, target = _name(page_id, sha, number), "".join((url or "about:blank").split())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    common = {"WARC_Target_URI": target, "WARC_Payload_Digest": f"sha1:{sha}"}
    if first is not None:
        yield _record("revisit", own, http, **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{_name(first[0], sha, 1)}>")
        return
    block = http + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record("response", own, parts[0], **common, WARC_Segment_Number=1 if len(parts) > 1 else None)
    for i, part in enumerate(parts[1:], 2):
        total = len(block) if i == len(parts) else None
        yield _record("continuation", f"{own}:{i}", part, WARC_Target_URI=target, WARC_Segment_Number=i, WARC_Segment_Origin_ID=f"<{own}>", WARC_Segment_Total_Length=total)


def _copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored: (sha, page_id, n, url) of the rows by payload and page, and (sha, first) of payloads that several rows have."""
    entries = stash(rows.groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")), "warc-entries")
    least = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id"))["page_id"]
    return entries, stash(entries.groupBy("sha").agg(least.alias("first"), F.sum("n").alias("copies")).where("copies > 1").select("sha", "first"), "warc-copied")


def _suspected(rows: DataFrame, copied: DataFrame, n: int) -> DataFrame:
    """rows with `suspected`: true for every row whose sha is in `copied` (of n rows), and for few others.

    It is looked up in a broadcast bitmap of at most MAX_BUCKETS * 4 kB, one hash a sha. Where that is too small for n, more
    rows are suspected, and none is missed.
    """
    buckets = min(MAX_BUCKETS, n * BITS_EACH // BUCKET_BITS + 1)
    place = F.pmod(F.xxhash64("sha"), F.lit(buckets * BUCKET_BITS))
    at = lambda df: df.withColumns({"bucket": F.floor(place / BUCKET_BITS), "bit": F.pmod(place, F.lit(BUCKET_BITS))})
    bitmap = at(copied).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    is_set = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    return at(rows).join(F.broadcast(bitmap), "bucket", "left").withColumn("suspected", F.coalesce(is_set, F.lit(False))).drop("bucket", "bit", "bits")


def _marked(rows: DataFrame, entries: DataFrame, copied: DataFrame) -> DataFrame:
    """Every row to write once: (page_id, url, payload, sha, number, refers); refers.page_id is what a revisit names, and it has no payload.

    Only payloads that may have copies are exchanged, and of those one per task; all others are written where they are read.
    """
    names = ["page_id", "url", "payload", "sha"]
    response = [F.lit(1).alias("number"), F.lit(None).cast(T.StructType([rows.schema["page_id"]])).alias("refers")]
    n = copied.count()
    if not n:
        return rows.select(*names, *response)
    told = _suspected(rows, copied, n)
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("bare"), "url", "payload")
    firsts = told.where("suspected").groupBy("sha").agg(F.min(order).alias("r")).select("r.page_id", "r.url", "r.payload", "sha")
    again = entries.join(copied, "sha").withColumn("number", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    again = again.where(~(F.col("page_id").eqNullSafe(F.col("first")) & (F.col("number") == 1)))
    revisits = again.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha", "number", F.struct(F.col("first").alias("page_id")).alias("refers"))
    return told.where("not suspected").select(*names, *response).unionByName(firsts.select(*names, *response)).unionByName(revisits)


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the archive of (page_id, url, html) into the folder `path`, as gzipped WARC files."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    entries, copied = _copies(rows)
    marked = _marked(rows, entries, copied)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                out = []
                for r in b.to_pylist():
                    refers = r["refers"] and (r["refers"]["page_id"],)
                    out += _records(r["number"], r["page_id"], r["url"], r["payload"], base64.b32encode(r["sha"]).decode(), refers, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = marked.mapInArrow(each, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    discard(pages.sparkSession, paths(entries) + paths(copied))


class _Inflated(io.RawIOBase):
    """Streams the inflated bytes of a gzip file of one or more members."""

    def __init__(self, data: bytes):
        self.data, self.at, self.rest, self.z = data, 0, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while not self.rest and self.at < len(self.data):
            part = self.data[self.at : self.at + 65536]
            self.at += len(part)
            self.rest = self.z.decompress(part)
            if self.z.eof:
                self.at -= len(self.z.unused_data)
                self.z = zlib.decompressobj(31)
        n = min(len(b), len(self.rest))
        b[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record in an archive file."""
    stream = io.BufferedReader(_Inflated(data) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 18)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("truncated record")
        yield headers, block


_PARSED = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("stated", pa.string()), ("refers", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
_PARSED_DDL = "kind string, record_id string, origin string, segment int, total long, stated string, refers string, size long, digest string, block binary"


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive. Unsegmented responses are decoded (size, digest); of segments the block is kept."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                out: list[tuple] = []
                held = 0
                for h, block in parse(data.as_py()):
                    kind, number = h["warc-type"], int(h.get("warc-segment-number", 0))
                    own = h["warc-record-id"].strip("<>")
                    origin = h.get("warc-segment-origin-id", f"<{own}>").strip("<>") if number else None
                    payload = payload_of(block) if kind == "response" and not number else None
                    size, sha = (None, None) if payload is None else (len(payload), digest(payload))
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    total = h.get("warc-segment-total-length")
                    out.append((kind, own, origin, number or None, total and int(total), stated, h.get("warc-refers-to", "").strip("<>") or None, size, sha, block if number else None))
                    held += len(block) if number else 0
                    if len(out) >= 2000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PARSED, strict=True)], schema=_PARSED)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PARSED, strict=True)], schema=_PARSED)

    # one file a task at most: files are whole archives of a bounded number of bounded records
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(each, _PARSED_DDL)


def reassemble(segments: DataFrame) -> DataFrame:
    """Groups segments by origin, orders them by number, verifies numbers and total length, decodes the framing.

    One origin's segments are one payload, so a group is bounded by the longest record.
    """
    grouped = segments.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "block", "total", "stated"))).alias("parts"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 16) for i in range(0, whole.num_rows, 16)):
                out = []
                for r in b.to_pylist():
                    parts = r["parts"]
                    block = b"".join(p["block"] for p in parts)
                    whole_ = [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
                    payload = payload_of(block) if whole_ else None
                    out.append((r["origin"], parts[0]["stated"], None if payload is None else len(payload), None if payload is None else digest(payload), len(parts)))
                names = ["record_id", "stated", "size", "digest", "segments"]
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return grouped.mapInArrow(each, "record_id string, stated string, size long, digest string, segments int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: page_id (text), record_type, payload_bytes, payload_digest, refers_to (text), segments, intact.

    intact: the payload was whole and its digest is the stated one. A broken payload has null bytes and digest.
    """
    found = stash(records(spark, path), "warc-records")  # each file is parsed once
    segmented = reassemble(found.where("segment is not null"))
    whole = found.where("segment is null")
    responses = whole.where("kind = 'response'").select("record_id", "stated", "size", "digest", F.lit(1).alias("segments")).unionByName(segmented)
    responses = responses.withColumn("record_type", F.lit("response")).withColumn("refers", F.lit(None).cast("string"))
    revisits = whole.where("kind = 'revisit'").select("record_id", "stated", "refers")
    sizes = responses.select(F.col("record_id").alias("refers"), "size", "digest")
    revisits = revisits.join(sizes, "refers", "left").select("record_id", "stated", "size", "digest", F.lit(1).alias("segments"), F.lit("revisit").alias("record_type"), "refers")
    page = lambda c: F.nullif(F.url_decode(F.split(c, ":")[2]), F.lit(""))
    return responses.unionByName(revisits).select(page("record_id").alias("page_id"), "record_type", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), page("refers").alias("refers_to"), "segments", F.coalesce(F.col("digest") == F.col("stated"), F.lit(False)).alias("intact"))


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the pages' archive into the shared folder and reads it back."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, segment_bytes)
    return read(pages.sparkSession, path)
