"""Exact substring deduplication by merging shard Burrows-Wheeler transforms.

Texts are UTF-8 bytes. `repeats.candidates` leaves the stretches whose 50-byte windows can repeat in another document;
they are dealt by minimizer, so equal windows meet in one bucket. In a bucket:
  1. wholly equal stretches, compared byte by byte, become one string with its smallest doc_id: copies are counted before
     they are sorted, as a third of the corpus may be one text;
  2. strings of one minimizer go together into batches, and within a batch into shards by the document bucket they come from;
  3. each shard's suffixes are sorted on their own and give its transform over blocks of `q` bytes (q strided
     strings a string, so that every byte offset has its suffix);
  4. the shards' transforms are merged by interleave refinement: an array of shard numbers, at first one shard after the
     other, is refined by one stable pass over the merged transform for each block of context. The pass at which two
     neighbours part gives their common prefix, in blocks; after length / q passes, the runs of common prefixes of `length` bytes are
     the repeated intervals. No suffixes are sorted across shards;
  5. the smallest doc_id of each interval tells which windows also start in an earlier document.

Bytes covered by such windows are removed; windows are judged on the input, and matches never cross documents.
Null text: empty. Texts shorter than a window: unchanged. Repeated doc_id: see `repeats`; rows of one doc_id do not
count against each other. One row per input row, wholly equal rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import BLOCKS_DDL, CANDIDATE, NULL_ID, U64, Rows, block_table, bucket_count, bucket_of, by_bucket, byte_symbols, candidates, covered, expand, joined, keyed, rows_of, slices, squeeze, stretch_hashes

WINDOW, K = 50, 16
#: Symbols in one merge batch, unless one minimizer alone has more.
BATCH_SYMBOLS = 60_000
SHARDS = 8
#: Bytes of stretches that are compared at a time before they are dealt by minimizer.
CUT_BYTES = 1 << 20


def classes(flat: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Class numbers of concatenated strings: equal strings with equal m have equal numbers. Hashes propose, bytes decide."""
    end = np.cumsum(sizes)
    begin = end - sizes
    h = stretch_hashes(flat, begin, end)
    order = np.lexsort((h, m))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (m[order][1:] != m[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    later = order[~new]
    same = sizes[later] == sizes[first[~new]]
    if same.all() and np.array_equal(slices(flat, begin[later], sizes[later]), slices(flat, begin[first[~new]], sizes[later])):
        return out
    seen: dict[tuple[int, bytes], int] = {}  # two strings share a hash: once in a very long while
    return np.array([seen.setdefault((int(x), flat[b:e].tobytes()), len(seen)) for x, b, e in zip(m, begin, end, strict=True)])


def _ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of positive values; 0 stays 0."""
    order = np.argsort(values)
    s = values[order]
    step = np.concatenate([[s[0] > 0], s[1:] != s[:-1]])
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(step)
    return out, int(step.sum())


def _least_in_classes(flat: np.ndarray, sizes: np.ndarray, owner: np.ndarray, shard: np.ndarray, length: int) -> np.ndarray:
    """For every byte position of the strings, the least owner of the window that starts there (own owner where none does).

    shard: number of each string's shard, 0..SHARDS-1.
    """
    for q in (d for d in (5, 2, 1) if length % d == 0):
        full = sizes + q  # q further positions a string: the empty suffixes of its strided strings
        string = np.repeat(np.arange(len(sizes)), full)
        begin = np.cumsum(full) - full
        off = np.arange(len(string)) - begin[string]
        left = sizes[string] - off
        text = np.zeros(len(string) + q, np.int64)
        text[np.flatnonzero(left > 0)] = flat.astype(np.int64) + 1
        names = np.zeros(len(string), np.int64)
        for j in range(q):
            names = names * 257 + np.where(left > j, text[j : j + len(string)], 0)
        names, distinct = _ranks(names)
        if distinct < 65_535 or q == 1:
            break
    names = names.astype(np.uint16)
    n, depth = len(string), length // q
    before = np.where(off >= q, names[np.maximum(np.arange(n) - q, 0)], 0).astype(np.uint16)
    # the order of each shard's own suffixes, by the first `depth` blocks; four blocks make one key
    padded = np.concatenate([names, np.zeros(q * (depth + 4), np.uint16)]).astype(U64)
    keys = []
    for a in range(0, depth, 4):
        key = np.zeros(n, U64)
        for j in range(a, a + 4):
            inside = left > j * q if j < depth else False
            key = (key << U64(16)) | np.where(inside, padded[j * q : j * q + n], U64(0))
        keys.append(key)
    of_shard = shard[string]
    mine = [np.flatnonzero(of_shard == x) for x in range(SHARDS)]
    sorted_shards = [x[np.lexsort([k[x] for k in keys[::-1]])] for x in mine if len(x)]
    order = np.concatenate(sorted_shards)
    transforms = before[order]  # one shard's transform after the other
    z = of_shard[order].astype(np.uint8)
    context = np.zeros(n, np.int64)
    common = np.full(n, depth, np.int16)  # blocks that a suffix and the one before it have in common
    common[0] = 0
    for passed in range(depth):
        merged = np.empty(n, np.uint16)
        merged[np.argsort(z, kind="stable")] = transforms
        step = np.argsort(merged, kind="stable")
        z, context, symbol = z[step], context[step], merged[step]
        edge = np.empty(n, bool)
        edge[0] = False
        edge[1:] = (symbol[1:] != symbol[:-1]) | (context[1:] != context[:-1])
        common[edge & (common > passed)] = passed
        context = np.cumsum(edge)
    suffix = np.empty(n, np.int64)
    suffix[np.argsort(z, kind="stable")] = order
    owners = owner[string[suffix]]
    apart = common < depth  # an interval begins
    least = np.empty(n, owner.dtype)
    least[suffix] = np.minimum.reduceat(owners, np.flatnonzero(apart))[np.cumsum(apart) - 1]
    least = np.where(left >= length, least, owner[string])
    return least[left > 0]


def _batches(m: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Ranges of strings (sorted by m) of about BATCH_SYMBOLS symbols; strings of one m stay together."""
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])), [len(m)]])
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a > first and total[b] - total[first] > BATCH_SYMBOLS:
            yield slice(first, int(a))
            first = int(a)
    if len(m):
        yield slice(first, len(m))


def _runs(target: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, bounds of each bucket) of ranges of sorted buckets with about CUT_BYTES, or one bucket with more."""
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])), [len(target)]]) if len(target) else np.zeros(1, np.int64)
    total, at = np.concatenate([[0], np.cumsum(sizes)])[cuts], 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(total, total[at] + CUT_BYTES, "right")) - 1)
        yield int(cuts[at]), int(cuts[to]), cuts[at : to + 1]
        at = to


def _settle(m: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, flat: np.ndarray, source: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (stretch, start, end) that one bucket's stretches show to be repeats of an earlier document.

    A row is a stretch of n windows from byte `at` of `doc`; flat holds their bytes, `source` the block each came in.
    """
    if not len(m):
        return at, at, at
    sizes = n + length - 1
    begin = np.cumsum(sizes) - sizes
    kind = classes(flat, sizes, m)
    order = np.lexsort((doc, kind, m))
    ks, ms, ds = kind[order], m[order], doc[order]
    new = np.concatenate([[True], (ks[1:] != ks[:-1]) | (ms[1:] != ms[:-1])])
    cls = np.cumsum(new) - 1
    least = ds[new][cls]
    copies = order[ds > least]  # whole stretches of an earlier document
    spans = [(copies, at[copies], at[copies] + sizes[copies])]
    # strings: one for each class whose minimizer has other classes too
    classes_of_m = np.bincount(np.cumsum(np.concatenate([[True], ms[1:] != ms[:-1]])) - 1, weights=new)
    several = classes_of_m[np.cumsum(np.concatenate([[True], ms[1:] != ms[:-1]])) - 1] > 1
    reps = np.flatnonzero(new & several)
    kept = order[reps]
    string_of = np.full(int(new.sum()), -1, np.int64)
    string_of[cls[reps]] = np.arange(len(reps))
    found: list[np.ndarray] = []
    shards = (source[kept] * SHARDS) // (int(source.max()) + 1)
    for part in _batches(ms[reps], sizes[kept]):
        rows = kept[part]
        found.append(_least_in_classes(slices(flat, begin[rows], sizes[rows]), sizes[rows], doc[rows], shards[part], length))
    if found:
        earlier = np.concatenate(found) < np.repeat(doc[kept], sizes[kept])
        base = np.cumsum(sizes[kept]) - sizes[kept]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], earlier, [False]]).astype(np.int8)))
        run_start, run_end = edge[::2], edge[1::2]  # runs of windows; never across strings, whose last bytes start no window
        string = np.searchsorted(base, run_start, side="right") - 1
        # every row of the class that belongs to its least document
        rows = np.flatnonzero((ds == least) & several)
        strings = string_of[cls[rows]]
        runs = np.searchsorted(string, [strings, strings + 1])
        count = runs[1] - runs[0]
        which = np.repeat(np.arange(len(rows)), count)
        run = np.repeat(runs[0] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        row = order[rows[which]]
        shift = at[row] - base[strings[which]]
        spans.append((row, run_start[run] + shift, run_end[run] + shift + length - 1))
    return tuple(np.concatenate(x) for x in zip(*spans, strict=True))


def spans(docs: DataFrame, length: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(blocks, keyed documents): per document bucket, removed byte spans as row, start, end (they may overlap)."""
    buckets = bucket_count(docs)
    rows = keyed(docs, buckets)
    asked = candidates(rows, buckets, length, k, byte_symbols, across=True)

    def cut(key: tuple, texts: pa.Table, blocks: pa.Table) -> pa.Table:
        """The candidate stretches' bytes by minimizer bucket; of stretches equal within this bucket, those of the least document."""
        m, own, tag, at, n = joined(rows_of(blocks), *CANDIDATE)
        if not len(m):
            return block_table([])
        held = Rows(texts)
        flat = np.frombuffer(b"".join(held.texts), np.uint8)
        lengths = np.fromiter(map(len, held.texts), np.int64, len(held.texts))
        base = np.cumsum(lengths) - lengths
        which, row = held.of(own, tag)
        m, at, n = m[which], at[which].astype(np.int64), n[which].astype(np.int64)
        fits = at + n + length - 1 <= lengths[row]
        m, row, at, n = m[fits], row[fits], at[fits], n[fits]
        own, here, out = held.ids[row], np.array([key[0].as_py()]), []
        target = bucket_of(m, buckets)
        order = np.lexsort((at, own, m, target))
        target, m, row, at, n, own = (x[order] for x in (target, m, row, at, n, own))
        sizes = n + length - 1
        for a, z, cuts in _runs(target, sizes):
            begin = np.cumsum(sizes[a:z]) - sizes[a:z]
            text = slices(flat, base[row[a:z]] + at[a:z], sizes[a:z])
            kind = classes(text, sizes[a:z], m[a:z])
            least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, kind, own[a:z])
            first = own[a:z] == least[kind]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                kept, gone = lo + np.flatnonzero(first[lo - a : hi - a]), lo + np.flatnonzero(~first[lo - a : hi - a])
                ended = at[gone] + sizes[gone]
                several, place = np.unique(row[kept], return_inverse=True)  # a row's id is sent once
                out.append((int(target[lo]), squeeze(here, m[kept], held.ids[several], several.astype(np.uint32), place.astype(np.uint32), at[kept].astype(np.uint32), n[kept].astype(np.uint16), slices(text, begin[kept - a], sizes[kept]), row[gone].astype(np.uint32), at[gone].astype(np.uint32), ended.astype(np.uint32))))
        return block_table(out)

    def merge(table: pa.Table) -> pa.Table:
        parts = [expand(x) for x in rows_of(table)]
        m, at, n, flat, g_row, g_at, g_end = (np.concatenate([p[i] for p in parts]) for i in (1, 5, 6, 7, 8, 9, 10))
        doc, row = (np.concatenate([p[i][p[4]] for p in parts]) for i in (2, 3))
        source = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        homes = np.array([int(p[0][0]) for p in parts])
        stretch, s, e = _settle(m, doc, at.astype(np.int64), n.astype(np.int64), flat, source, length)
        home = np.concatenate([homes[source[stretch]], np.repeat(homes, [len(p[8]) for p in parts])])
        columns = np.concatenate([row[stretch], g_row]), np.concatenate([s, g_at]).astype(np.uint32), np.concatenate([e, g_end]).astype(np.uint32)
        return block_table([(b, squeeze(*(c[r] for c in columns))) for b, r in by_bucket(home)])

    stretches = rows.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(cut, BLOCKS_DDL)
    return stretches.groupBy("bucket").applyInArrow(merge, BLOCKS_DDL), rows


def dedup(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the remaining bytes; spans are maximal removed runs."""
    found, rows = spans(docs, length)

    def each(texts: pa.Table, blocks: pa.Table) -> pa.Table:
        held = Rows(texts)
        row, start, end = (x.astype(np.int64) for x in joined(rows_of(blocks), np.uint32, np.uint32, np.uint32))
        order = np.argsort(row, kind="stable")
        start, end = start[order], end[order]
        cuts = np.searchsorted(row[order], np.arange(len(held.texts) + 1)).tolist()
        out = []
        for k, (i, raw, times) in enumerate(zip(held.ids.tolist(), held.texts, held.times, strict=True)):
            a, b = cuts[k], cuts[k + 1]
            kept, removed, runs = raw, 0, 0
            if a < b:
                gone = covered(start[a:b], end[a:b], len(raw))
                kept, removed = np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum())
                runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
            out += [(None if i == NULL_ID else i, len(raw), removed, runs, kept)] * times
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
