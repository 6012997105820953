"""Benchmark decontamination with an FM-index per training shard.

A task gathers documents into shards of a bounded number of symbols, so there is no shuffle. Symbols are the
benchmark's distinct words; a document word outside them ends a run, and runs shorter than the shortest window
cannot hold an occurrence, so the index keeps the longer runs only, each after a separator. Per shard:
  suffix array (prefix doubling up to the longest window) -> Burrows-Wheeler transform -> wavelet tree with ranks
  -> backward search of all windows at once -> occurrences located by walking to sampled suffix positions
  -> spans merged per document.

The benchmark is broadcast in blocks of at most `block_windows` windows (a documented bound); each block is one
more map over the same rows, stored in between, so a larger benchmark needs more passes, not more memory.

Null or empty text: no words, no hits. Null items: no windows. Repeated rows and items: each row is answered,
an item_id counts once, a null one as the empty string. Item ids may hold any characters. Extra columns are kept by `cut`,
whatever their names; doc_id may be of any type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release_memory, sha256_hex, stash

TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # on UTF-8 bytes: those of other code points all count
WINDOW = 10
#: Symbols in one shard's index; a document beyond it has a shard of its own.
SHARD_SYMBOLS = 400_000
#: Characters of text that a shard's documents may have.
SHARD_BYTES = 8 << 20
#: Windows in one broadcast block.
BLOCK_WINDOWS = 200_000
#: Every SAMPLE-th text position, and every start of a run, keeps its place in the index.
SAMPLE = 8


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered; bytes.lower touches ASCII letters only."""
    return TOKEN.findall(text.encode("utf-8").lower()) if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class WaveletTree:
    """Ranks over an integer sequence: one bit plane per level, most significant bit first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for b in range(bits - 1, -1, -1):
            plane = ((symbols >> b) & 1).astype(np.uint8)
            self.ones.append(np.concatenate([[0], np.cumsum(plane, dtype=np.int64)]))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = symbols[np.argsort(plane, kind="stable")]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        lo, hi = np.zeros_like(at), at
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            ones, zeros = self.ones[level], self.zeros[level]
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    """Index of a shard's symbols: runs of positive symbols, each followed by one 0.

    Separators sort by position and before all symbols, so the suffix array is total after log2(longest run)
    doublings. Walks to a sampled position never cross a separator, as every run's start is sampled.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int):
        n = len(symbols)
        gaps = symbols == 0
        n_gaps = int(gaps.sum())
        rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + n_gaps - 1)
        width = 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - width)] = rank[width:] + 1
            key = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            width *= 2
        self.bwt = symbols[order - 1].astype(np.int64)  # order - 1 = -1 is the last separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        self.tree = WaveletTree(self.bwt, max(1, int(alphabet).bit_length()))
        self.sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of right-aligned patterns (rows, padded with 0 on the left): row ranges [sp, ep)."""
        sp, ep = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= j) & (sp < ep))
            if not len(live):
                break
            c = patterns[live, -j]
            sp[live] = self.first[c] + self.tree.rank(c, sp[live])
            ep[live] = self.first[c] + self.tree.rank(c, ep[live])
        return sp, np.maximum(sp, ep)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows."""
        out, steps, rows = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            there = self.sampled[at]
            done = left[there]
            out[done] = self.samples[self.sample_rank[rows[done]]] + steps[done]
            left = left[~there]
            c = self.bwt[rows[left]]
            rows[left] = self.first[c] + self.tree.rank(c, rows[left])
            steps[left] += 1
        return out


class Phrases:
    """The windows of one block of benchmark items as symbol patterns."""

    def __init__(self, items: list[tuple[str, tuple[bytes, ...]]]):
        of: dict[tuple[bytes, ...], list[str]] = {}
        for item, window in items:
            of.setdefault(window, []).append(item)
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for window in of for w in window))}
        self.items = [sorted(set(x)) for x in of.values()]
        self.lengths = np.array([len(w) for w in of], np.int64)
        self.patterns = np.zeros((len(of), int(self.lengths.max(initial=1))), np.int64)
        for row, window in zip(self.patterns, of, strict=True):
            row[len(row) - len(window) :] = [self.vocabulary[w] for w in window]
        self.least = int(self.lengths.min(initial=1))

    def runs(self, words: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """(start, symbols) of each run of vocabulary words long enough to hold a window."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if np.count_nonzero(ids) < self.least:
            return []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        return [(s, ids[s:e]) for s, e in edges.reshape(-1, 2).tolist() if e - s >= self.least]

    def occurrences(self, shard: list[list[tuple[int, np.ndarray]]]) -> list[list[tuple[int, int, int]]]:
        """Per document of the shard: (first word, end word, pattern) of every occurrence."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in shard]
        flat = [(d, s, ids) for d, runs in enumerate(shard) for s, ids in runs]
        if not flat:
            return out
        text = np.concatenate([x for _, _, ids in flat for x in (ids, [0])])
        begins = np.concatenate([[0], np.cumsum([len(ids) + 1 for _, _, ids in flat])])[:-1]
        index = FMIndex(text, len(self.vocabulary))
        sp, ep = index.search(self.patterns, self.lengths)
        which = np.repeat(np.arange(len(sp)), ep - sp)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(ep - sp) - (ep - sp), ep - sp) + np.repeat(sp, ep - sp)
        at = index.locate(rows)
        run = np.searchsorted(begins, at, side="right") - 1
        for p, x, r in zip(which.tolist(), (at - begins[run]).tolist(), run.tolist(), strict=True):
            d, s, _ = flat[r]
            out[d].append((s + x, s + x + int(self.lengths[p]), p))
        return out


def blocks_of(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[Phrases]:
    """The benchmark's windows in bounded blocks; the driver holds one block at a time."""
    size, block = 0, []
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("text is not null").toLocalIterator():
        got = [(row.i or "", w) for w in windows_of(words_of(row.text), window)]
        if block and size + len(got) > block_windows:
            yield Phrases(block)
            size, block = 0, []
        block += got
        size += len(got)
    if block:
        yield Phrases(block)


_HITS = pa.schema([("n_words", pa.int64()), ("h_start", pa.list_(pa.int32())), ("h_end", pa.list_(pa.int32())), ("h_item", pa.list_(pa.list_(pa.string())))])


def _add_hits(df: DataFrame, phrases: Phrases | None, first: bool, cutting: bool = False) -> DataFrame:
    """df: (row, text) and, but for the first block, the hit columns. Adds one block's occurrences; or, for the last block,
    cuts the hits out of the text."""
    shared = df.sparkSession.sparkContext.broadcast(phrases)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value

        def flush(held: list[pa.RecordBatch], runs: list, n_words: list[int]) -> Iterator[pa.RecordBatch]:
            hits, at = found.occurrences(runs) if found else [[] for _ in runs], 0
            for b in held:
                own = hits[at : at + b.num_rows]
                new = [[[s for s, _, _ in h] for h in own], [[e for _, e, _ in h] for h in own], [[found.items[p] for _, _, p in h] for h in own]]
                if not first:
                    new = [[x + y for x, y in zip(b.column(c).to_pylist(), n, strict=True)] for c, n in zip(_HITS.names[1:], new, strict=True)]
                if cutting:
                    texts = [t if t is None or not s else _cut(t, s, e) for t, s, e in zip(b.column("text").to_pylist(), new[0], new[1], strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])
                else:
                    columns = [pa.array(x, f.type) for x, f in zip([n_words[at : at + b.num_rows], *new], _HITS, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), *columns], names=["row", "text", *_HITS.names])
                at += b.num_rows

        held, runs, n_words, symbols, size = [], [], [], 0, 0
        for whole in batches:
            for b in (whole.slice(i, 250) for i in range(0, whole.num_rows, 250)):
                held.append(b)
                for text in b.column("text"):
                    plain = text.as_py()
                    words = words_of(plain)
                    size += len(plain or "")
                    n_words.append(len(words))
                    runs.append(found.runs(words) if found else [])
                    symbols += sum(len(x) + 1 for _, x in runs[-1])
                if symbols >= SHARD_SYMBOLS or size >= SHARD_BYTES:
                    yield from flush(held, runs, n_words)
                    held, runs, n_words, symbols, size = [], [], [], 0, 0
        if held:
            yield from flush(held, runs, n_words)
        release_memory()

    kept = f"row {df.schema['row'].dataType.simpleString()}, text string"
    return df.mapInArrow(each, kept if cutting else f"{kept}, n_words long, h_start array<int>, h_end array<int>, h_item array<array<string>>")


def hits(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, cutting: bool = False) -> DataFrame:
    """rows: (row, text), `row` of any type. They come back with n_words and every occurrence of a window: h_start, h_end
    (words, end exclusive), h_item (item ids of each).

    cutting: (row, text) without the spans hit instead. Between two blocks the rows are stored, and the block is let go.
    """
    out, first = rows, True
    blocks = blocks_of(benchmark, window, block_windows)
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        out, first = _add_hits(out, block, first, cutting and following is None), False
        if following is not None:
            out = stash(out, "hits")
        block = following
    return _add_hits(out, None, True, cutting) if first else out


def merged(starts, ends) -> list[list[int]]:
    """Word spans that overlap or touch, merged."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


_REPORT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.string())])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged word spans)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, starts, ends, items in zip(*(b.column(c).to_pylist() for c in _HITS.names), strict=True):
                spans = merged(starts, ends)
                ids = sorted({i for x in items for i in x})
                rows.append((n, sum(e - s for s, e in spans), len(ids), sha256_hex(",".join(ids)), bool(spans), ",".join(f"{s}-{e}" for s, e in spans)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_REPORT), _REPORT, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *_REPORT.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = hits(docs.select(F.col("doc_id").alias("row"), "text"), benchmark, window).drop("text").withColumnRenamed("row", "doc_id")
    return found.mapInArrow(each, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string")


def _cut(text: str, starts, ends) -> str:
    raw = text.encode("utf-8")
    words = [m.span() for m in TOKEN.finditer(raw.lower())]  # as words_of counts them; lower-casing ASCII keeps every place
    parts, at = [], 0
    for s, e in merged(starts, ends):
        parts.append(raw[at : words[s][0]])
        at = words[e - 1][1]
    return b"".join([*parts, raw[at:]]).decode("utf-8")


def cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without the spans that occur in the benchmark (first to last hit word of each); n_chars follows."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], *([] if others else [F.lit(0).alias("none")])).alias("row"), "text")
    out = hits(rows, benchmark, window, cutting=True)
    out = out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out
