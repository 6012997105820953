"""Exact substring deduplication by relative Lempel-Ziv parsing over words.

Stretches: the words under the windows that can repeat (`repeats.candidates`), dealt by minimizer. Equal windows have equal
minimizers, so whatever a stretch repeats lies in the stretches of its own deal: these are its reference block.
Every block is indexed by the 128-bit hashes of its windows, each with its earliest occurrence (smaller doc_id, or same
document and earlier start). A stretch is then factored greedily against the block: a factor begins at the first window that the
index knows from an earlier place and is extended word by word, on the words themselves, as long as the source goes
on alike; at its boundary, windows that straddle its end are looked up anew, so the next factor may overlap it by up to a
window less one word. Factors of at least a window are duplicate spans, and the union of the spans is what is removed.

The parse runs twice: in each document bucket against the bucket's own stretches, so that copies met there are settled
before anything is sent, and in each reference block against all others. Windows are judged on the input, not on what is left.

Null text: no words. Texts shorter than a window: unchanged. Repeated doc_id: see `repeats`; a window at the same place of
another row with the same doc_id is not earlier. One row per input row, wholly equal rows alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import BLOCKS_DDL, CANDIDATE, NULL_ID, U64, Rows, block_table, bucket_count, bucket_of, by_bucket, candidates, covered, expand, joined, keyed, rows_of, slices, span_hash, squeeze, word_hashes, word_spans, word_symbols
from .shared import mix64

WINDOW, K = 20, 4


def factor(words: np.ndarray, sizes: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse of stretches against the block that they form: (stretch, start, length, source doc_id, source start) of each factor.

    words: hashes of the concatenated stretches' words; a stretch has `sizes` of them (a window at least) from word `at` of `doc`.
    Starts are places in the documents.
    """
    none = np.zeros(0, np.int64)
    if not len(sizes):
        return none, none, none, none, none
    begin = np.cumsum(sizes) - sizes
    end = begin + sizes
    stretch = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) + (at - begin)[stretch]
    seeds = np.flatnonzero(np.arange(len(words)) + window <= end[stretch])
    # the index: windows by hash, in each class the earliest first
    h1, h2 = span_hash(words, window)[seeds], span_hash(mix64(words), window)[seeds]
    order = np.lexsort((place[seeds], doc[stretch[seeds]], h2, h1))
    h1, h2, sorted_ = h1[order], h2[order], seeds[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    source = np.full(len(words), -1, np.int64)
    source[sorted_] = sorted_[np.flatnonzero(new)[np.cumsum(new) - 1]]
    known = np.zeros(len(words), bool)
    s = source[seeds]
    known[seeds] = (doc[stretch[s]] != doc[stretch[seeds]]) | (place[s] != place[seeds])
    follow = np.where(known, np.arange(len(words)), len(words))
    follow = np.append(np.minimum.accumulate(follow[::-1])[::-1], len(words))  # the next known window
    out: list[tuple[np.ndarray, ...]] = []
    cursor, which = begin, np.arange(len(sizes))
    while len(which):
        p = follow[cursor]
        live = p < end[which]
        which, p = which[live], p[live]
        q, length = source[p], np.full(len(p), window)
        growing = np.arange(len(p))
        while len(growing):
            a, b = p[growing] + length[growing], q[growing] + length[growing]
            inside = (a < end[which[growing]]) & (b < end[stretch[q[growing]]])
            growing, a, b = growing[inside], a[inside], b[inside]
            growing = growing[words[a] == words[b]]
            length[growing] += 1
        out.append((which, place[p], length, doc[stretch[q]], place[q]))
        cursor = p + length - window + 1
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _fully_covered(sizes: np.ndarray, at: np.ndarray, stretch: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """Whether all windows of a stretch lie in its factors."""
    return np.bincount(stretch, weights=length - window + 1, minlength=len(sizes)) == sizes - window + 1


def parsed(docs: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(blocks, keyed documents): per document bucket, factors as row, start, length, source doc_id, source start."""
    buckets = bucket_count(docs)
    rows = keyed(docs, buckets)
    asked = candidates(rows, buckets, window, k, word_symbols, across=False)

    def look(key: tuple, texts: pa.Table, blocks: pa.Table) -> pa.Table:
        """Stretches of one document bucket: what factors within the bucket cover whole is settled, the rest goes to the reference blocks."""
        m, own, tag, at, n = joined(rows_of(blocks), *CANDIDATE)
        if not len(m):
            return block_table([])
        held = Rows(texts)
        raw = np.frombuffer(b"\n".join([*held.texts, b""]), np.uint8)
        starts, ends = word_spans(raw)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in held.texts)]))
        which, row = held.of(own, tag)
        m, at, sizes = m[which], at[which].astype(np.int64), n[which].astype(np.int64) + window - 1
        fits = at + sizes <= np.diff(bounds)[row]
        m, row, at, sizes = m[fits], row[fits], at[fits], sizes[fits]
        if not len(m):
            return block_table([])
        first = bounds[row] + at
        words = slices(word_hashes(raw, starts, ends), first, sizes)
        f_stretch, f_start, f_length, f_doc, f_source = factor(words, sizes, held.ids[row], at, window)
        here, out = key[0].as_py(), []
        settled = (row[f_stretch].astype(np.uint32), f_start.astype(np.uint32), f_length.astype(np.uint16), f_doc, f_source.astype(np.uint32))
        if len(f_stretch):
            out.append((buckets + here, squeeze(*settled)))
        sent = np.flatnonzero(~_fully_covered(sizes, at, f_stretch, f_start, f_length, window))
        for b, r in by_bucket(bucket_of(m[sent], buckets)):
            r = sent[r]
            r = r[np.lexsort((at[r], row[r]))]
            text = slices(raw, starts[first[r]], ends[first[r] + sizes[r] - 1] + 1 - starts[first[r]])  # with the blank after the last word
            out.append((b, squeeze(np.array([here]), held.ids[row[r]], row[r].astype(np.uint32), at[r].astype(np.uint32), sizes[r].astype(np.uint16), text)))
        return block_table(out)

    def block(table: pa.Table) -> pa.Table:
        """One reference block: its stretches are factored against each other."""
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:
            return block_table([(bucket - buckets, x) for x in rows_of(table)])
        parts = [expand(x) for x in rows_of(table)]
        home = np.repeat([int(p[0][0]) for p in parts], [len(p[1]) for p in parts])
        doc, row, at, sizes, text = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
        words = word_hashes(text, *word_spans(text))
        f_stretch, f_start, f_length, f_doc, f_source = factor(words, sizes.astype(np.int64), doc, at.astype(np.int64), window)
        columns = (row[f_stretch], f_start.astype(np.uint32), f_length.astype(np.uint16), f_doc, f_source.astype(np.uint32))
        return block_table([(b, squeeze(*(c[r] for c in columns))) for b, r in by_bucket(home[f_stretch])])

    stretches = rows.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(look, BLOCKS_DDL)
    return stretches.groupBy("bucket").applyInArrow(block, BLOCKS_DDL), rows


def _chained(start: np.ndarray, length: np.ndarray, doc: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A document's factors: those that go on in the same source are one, those inside an earlier one drop."""
    order = np.lexsort((-length, start))
    start, length, doc, source = start[order], length[order], doc[order], source[order]
    end = start + length
    reach = np.maximum.accumulate(end)
    kept = np.concatenate([[True], end[1:] > reach[:-1]]) if len(start) else np.zeros(0, bool)
    start, end, doc, source = start[kept], end[kept], doc[kept], source[kept]
    begins = np.ones(len(start), bool)
    begins[1:] = (doc[1:] != doc[:-1]) | (source[1:] - start[1:] != source[:-1] - start[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(start)) - 1
    return start[first], (end[last] if len(first) else end) - start[first], doc[first], source[first]


def _factors_by_row(texts: pa.Table, blocks: pa.Table):
    held = Rows(texts)
    row, start, length, doc, source = joined(rows_of(blocks), np.uint32, np.uint32, np.uint16, np.int64, np.uint32)
    order = np.argsort(row, kind="stable")
    row, start, length, doc, source = (x[order].astype(np.int64) for x in (row, start, length, doc, source))
    cuts = np.searchsorted(row, np.arange(len(held.texts) + 1))
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        yield int(held.ids[i]), held.texts[i], held.times[i], _chained(start[a:b], length[a:b], doc[a:b], source[a:b])


def _id(i: int) -> int | None:
    return None if i == NULL_ID else i


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, source_doc_id, source_start) of every duplicate factor, in words; a source is an earlier occurrence."""
    found, rows = parsed(docs, window)

    def each(texts: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [(_id(i), s, n, _id(d), p) for i, _, times, f in _factors_by_row(texts, blocks) for s, n, d, p in zip(*(x.tolist() for x in f), strict=True) for _ in range(times)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=["doc_id", "start", "length", "source_doc_id", "source_start"])

    return rows.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(each, "doc_id long, start long, length long, source_doc_id long, source_start long")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words outside duplicate factors, joined by one blank."""
    found, rows = parsed(docs, window)

    def each(texts: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for i, raw, times, (start, length, _, _) in _factors_by_row(texts, blocks):
            words = raw.split()
            gone = covered(start, start + length, len(words)) if len(start) else np.zeros(0, bool)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(start) else words
            out += [(_id(i), len(words), int(gone.sum()), b" ".join(kept).decode("utf-8"))] * times
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names=["doc_id", "n_words", "n_removed", "text"])

    return rows.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(each, "doc_id long, n_words long, n_removed long, text string")
