"""Where long repeats can be: candidate segments of a corpus, found with two shuffles of compact blocks.

A window of `length` symbols (bytes or words) is represented by its minimizer, the least hash of its k-symbol
substrings. Equal windows have equal minimizers, so a window can repeat only where its minimizer does. Neighbouring
windows with one minimizer form a segment.

  scan     (map) segments of each document, as blocks per minimizer bucket
  reply    (per bucket) segments whose minimizer occurs elsewhere too, as blocks per document bucket
  gather   (per document bucket, together with its texts) the operator's own work

Blocks are binary columns of zstandard-compressed byte planes; rows are (bucket, block), so a shuffle moves few, dense
rows. In a scan chunk a minimizer that repeats within the chunk is answered on the spot and asked about
only once, so a very frequent one reaches its bucket at most once per chunk.

The numbers of buckets follow from the bytes of text, so a group holds about GROUP_BYTES of texts however large the table is;
a task handles one group at a time.

doc_id should be integral; one that is not counts as null, and a null one as the least id. Rows that share a doc_id keep
their own texts: they are told apart by a tag, 16 bits of the text's CRC-32, which also spreads the rows of one id over many
buckets, and where tags agree by their order within the bucket. Wholly equal rows are one document that is answered as
often as it occurs.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix64, release_memory

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
NULL_ID = -(1 << 63)
#: Bytes of text whose windows are hashed at a time, and bytes of text in one scan chunk, about: a chunk makes a block for each bucket.
HASHED_BYTES, CHUNK_BYTES = 1 << 21, 1 << 23
#: Bytes of text that one group stands for, about; buckets up to which there are two for each shuffle partition, as blocks grow with their square.
GROUP_BYTES, EASY_BUCKETS = 16 << 20, 512
BYTE_SYMBOLS = mix64(np.arange(256, dtype=U64))
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, each by byte planes."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else b""
        parts += [struct.pack("<3sI", a.dtype.str[-2:].encode(), len(a)), bytes(planes)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def expand(block: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        code, n = struct.unpack_from("<3sI", raw, at)
        dtype = np.dtype(code.rstrip(b"\0").decode())
        at += 7
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def span_hash(symbols: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of the n symbols from each position on; shorter than `symbols` by n - 1."""
    out, done, cur, width = None, 0, symbols, 1
    while True:
        if n & width:
            if out is None:
                out, done = cur, width
            else:
                size = len(symbols) - done - width + 1
                out = out[: max(0, size)] * U64(pow(BASE, width, 1 << 64)) + cur[done : done + max(0, size)]
                done += width
        if 2 * width > n:
            return out[: max(0, len(symbols) - n + 1)]
        cur = cur[: max(0, len(cur) - width)] * U64(pow(BASE, width, 1 << 64)) + cur[width:]
        width *= 2


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    p = 1
    while 2 * p <= width:
        a = np.minimum(a[: max(0, len(a) - p)], a[p:])
        p *= 2
    rest = width - p
    return np.minimum(a[: max(0, len(a) - rest)], a[rest:]) if rest else a


_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    """BASE to the powers 0..n-1, kept from call to call."""
    global _POWERS
    if len(_POWERS) < n:
        ups = np.full(max(n, 256), BASE, U64)
        ups[0] = 1
        _POWERS = np.cumprod(ups, dtype=U64)
    return _POWERS


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the disjoint, non-empty, ascending stretches raw[starts[i]:ends[i]]."""
    if not len(starts):
        return np.zeros(0, U64)
    place = np.arange(len(raw), dtype=np.int32)
    which = np.zeros(len(raw), np.int32)
    which[starts[1:]] = np.diff(starts)
    place -= np.cumsum(which, out=which)
    place -= np.int32(starts[0])
    sizes = ends - starts
    inside = place < np.repeat(sizes, np.diff(starts, append=len(raw))) if starts[0] == 0 else None
    if inside is None:
        inside = np.zeros(len(raw), bool)
        inside[starts[0] :] = place[starts[0] :] < np.repeat(sizes, np.diff(starts, append=len(raw)))
    place[~inside] = 0
    value = BYTE_SYMBOLS[raw]
    value *= _powers(int(sizes.max()))[place]
    value[~inside] = 0
    return mix64(np.add.reduceat(value, starts) + sizes.astype(U64))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of non-blank bytes) of UTF-8 text."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~BLANK[raw]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


word_hashes = stretch_hashes


def segments(symbols: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, document, first window, windows) of all segments of concatenated documents of the given sizes.

    A segment's windows share one place of the least hash (the leftmost), so equal windows always lie in different
    segments, and a segment has at most length - k + 1 windows.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return np.zeros(0, U64), none, none, none
    h = mix64(span_hash(symbols, k))
    low = U64((1 << max(20, len(h).bit_length())) - 1)  # place in the low bits: ties go to the left
    least = sliding_least((h & ~low) | np.arange(len(h), dtype=U64), length - k + 1)
    n = len(least)
    starts = np.cumsum(sizes) - sizes
    last = starts + sizes - length  # of each document, its last window; before its start if it is too short
    change = np.zeros(n + 1, bool)
    change[1:n] = least[1:] != least[:-1]
    usable = sizes >= length
    change[starts[usable]] = True
    change[last[usable] + 1] = True
    at = np.flatnonzero(change)
    end = np.append(at[1:], n)
    doc = np.searchsorted(starts, at, side="right") - 1  # of documents that start at one place the last, the only one with symbols
    fits = (at < n) & (at <= last[doc]) & (end > at)
    at, end, doc = at[fits], end[fits], doc[fits]
    return h[(least[at] & low).astype(np.int64)], doc, at - starts[doc], end - at


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in their order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(values.astype(np.int64).view(U64) if values.dtype != U64 else values) % U64(buckets)).astype(np.int64)


def rows_of(table: pa.Table | pa.RecordBatch) -> list[bytes]:
    return [x.as_py() for x in table.column("block")]


BLOCKS = pa.schema([("bucket", pa.int64()), ("block", pa.binary())])
BLOCKS_DDL = "bucket long, block binary"


def block_table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=BLOCKS)


def whole_number(docs: DataFrame, name: str = "doc_id") -> Column:
    """The id as a long; null for a text that is not one."""
    return F.expr(f"try_cast({name} AS bigint)") if docs.schema[name].dataType.simpleString() == "string" else F.col(name).cast("long")


def keyed(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc_id, text) with null ids and texts replaced."""
    out = docs.select(F.coalesce(whole_number(docs), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tag = F.crc32(F.encode("text", "UTF-8")).bitwiseAND(F.lit(0xFFFF))
    return out.select(F.pmod(F.pmod("doc_id", F.lit(buckets)) + tag, F.lit(buckets)).alias("bucket"), "doc_id", "text")


def row_buckets(own: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    """Document buckets as `keyed` has them."""
    return np.mod(np.mod(own.astype(np.int64), buckets) + tag.astype(np.int64), buckets)


def tag_of(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFF


def bucket_count(docs: DataFrame) -> int:
    """Buckets for blocks: one for every GROUP_BYTES of text; at least two per shuffle partition, or EASY_BUCKETS."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(min(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), EASY_BUCKETS), -(-size // GROUP_BYTES))


#: Turns texts (UTF-8) into (concatenated symbols, sizes).
Symbols = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_SYMBOLS[np.frombuffer(b"".join(texts), np.uint8)], np.fromiter(map(len, texts), np.int64, len(texts))


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts, ends = word_spans(raw)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    sizes = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return word_hashes(raw, starts, ends), sizes.astype(np.int64)


def candidates(docs: DataFrame, buckets: int, length: int, k: int, symbols: Symbols, across: bool) -> DataFrame:
    """(bucket, block) per document bucket: segments whose minimizer also occurs in another document (`across`) or anywhere else.

    A block holds minimizer, doc_id, tag, first window, number of windows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(ids: list[int], texts: list[bytes]) -> tuple[np.ndarray, ...]:
            m, doc, at, n = segments(*symbols(texts), length, k)
            return m, np.array(ids, np.int64)[doc], np.array([tag_of(t) for t in texts], np.uint16)[doc], at.astype(np.uint32), n.astype(np.uint16)

        def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            m, own, tag, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((own, m))
            m, own, tag, at, n = m[order], own[order], tag[order], at[order], n[order]
            new = np.ones(len(m), bool)
            new[1:] = m[1:] != m[:-1]
            group = np.cumsum(new) - 1
            other = ~new
            if across:
                other[1:] &= own[1:] != own[:-1]
            known = np.bincount(group, weights=other, minlength=1)[group] > 0  # more than one document here, or one place
            ask = ~known | new
            out = []
            target = bucket_of(m, buckets)
            for b, rows in by_bucket(target):
                a, s = rows[ask[rows]], rows[known[rows]]
                short = m[a] >> U64(16)
                out.append((b, squeeze(np.diff(short, prepend=U64(0)), own[a], tag[a], at[a], n[a], known[a].astype(np.uint8), m[s], own[s], tag[s], at[s], n[s])))
            if out:
                yield from block_table(out).to_batches()

        ids, texts, size, parts, whole = [], [], 0, [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = t.as_py().encode("utf-8")
                ids.append(i)
                texts.append(raw)
                size += len(raw)
                if size >= HASHED_BYTES:
                    parts.append(hashed(ids, texts))
                    whole += size
                    ids, texts, size = [], [], 0
                if whole >= CHUNK_BYTES:
                    yield from flush(parts)
                    parts, whole = [], 0
        if ids:
            parts.append(hashed(ids, texts))
        if parts:
            yield from flush(parts)
        release_memory()

    def reply(table: pa.Table) -> pa.Table:
        parts = [expand(x) for x in rows_of(table)]
        m = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        own, tag, at, n, known = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
        order = np.lexsort((own, m))
        m, own, tag, at, n, known = m[order], own[order], tag[order], at[order], n[order], known[order].astype(bool)
        new = np.ones(len(m), bool)
        new[1:] = m[1:] != m[:-1]
        other = ~new
        if across:
            other[1:] &= own[1:] != own[:-1]
        group = np.cumsum(new) - 1
        repeats = (np.bincount(group, weights=other | known, minlength=1)[group] > 0) & ~known
        m, own, tag, at, n = (np.concatenate([x[repeats], *(p[i] >> U64(16) if i == 6 else p[i] for p in parts)]) for x, i in ((m, 6), (own, 7), (tag, 8), (at, 9), (n, 10)))
        return block_table([(b, squeeze(m[r], own[r], tag[r], at[r], n[r])) for b, r in by_bucket(row_buckets(own, tag, buckets))])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(scan, BLOCKS_DDL).groupBy("bucket").applyInArrow(reply, BLOCKS_DDL)


class Rows:
    """The rows of one document bucket by (doc_id, text), wholly equal ones once: the same order whenever the bucket is read."""

    def __init__(self, table: pa.Table):
        counted = Counter((i, t.as_py().encode("utf-8")) for i, t in zip(table.column("doc_id").to_pylist(), table.column("text"), strict=True))
        ordered = sorted(counted)
        self.ids = np.array([i for i, _ in ordered], np.int64)
        self.texts = [t for _, t in ordered]
        self.times = [counted[x] for x in ordered]
        key = self._key(self.ids, np.array([tag_of(t) for t in self.texts], np.uint16))
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    @staticmethod
    def _key(own: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return mix64(own.view(U64)) + tag

    def of(self, own: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in own, row) of every row that a doc_id and tag can mean; more than one only where tags agree by chance."""
        key = self._key(own, tag)
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        count = hi - lo
        which = np.repeat(np.arange(len(own)), count)
        return which, self.order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(which))]


def joined(blocks: list[bytes], *types: type) -> list[np.ndarray]:
    """The columns of several blocks, one after the other; `types` of those of no blocks."""
    parts = [expand(x) for x in blocks]
    if not parts:
        return [np.zeros(0, t) for t in types]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(types))]


#: Columns of the blocks that `candidates` gives.
CANDIDATE = (U64, np.int64, np.uint16, np.uint32, np.uint16)


def slices(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated stretches flat[starts[i] : starts[i] + sizes[i]]."""
    index = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    index += np.arange(len(index))
    return flat[index]


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions in the union of [start, end) spans."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
