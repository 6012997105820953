"""Ranked lexical search: the k best documents of every item, best-first over intervals of documents.

Terms are runs of ASCII digits, ASCII letters (A-Z lowered) and all other code points beyond ASCII. Over all documents: N with a term
at least, L terms, df documents with a given term. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))); in a document of n terms that
holds it tf times its impact is w * ((10^9 tf) div (1000 tf + 20m)), m = 100 - b + ((b n N) div L); a score is the sum of impacts.

  1. index (map): documents are gathered into shards of about SHARD_BYTES of text; a shard keeps, in the order of doc_id, postings of
     the items' terms. Shards are stored; each reports its counts, which are summed for N, L and df.
  2. search (map): a shard's impacts carry a range-maximum sparse table over each posting list. For an item, the bound of an
     interval of documents is the sum of the maxima of its terms' lists there. The intervals of the greatest bounds are taken, each
     split at the document of its greatest single impact, which is scored; one of LEAF documents or fewer is scored whole. What
     cannot reach the k-th best found so far, in this task's shards too, is left.
  3. The k best of all tasks are taken per item; Spark limits each item to k rows in every task before they are shuffled.

Items are taken in blocks of BLOCK_ITEMS with BLOCK_TERMS terms (documented bounds of what tasks are sent); each block is one more pass over
the documents, so more items need more passes, not more memory.

Null or empty text: no terms; such a document is in no list and not in N. Rows of one item_id are one item with all their terms; a
null item_id is an item too. Repeated documents are ranked one by one. doc_id should be integral; one that is not counts as null,
and null ones come after all others among equal scores. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import expand, slices, squeeze, whole_number
from .shared import BATCH_ROWS, release_memory, stash

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # on lowered UTF-8
#: Bytes of text in one shard, about.
SHARD_BYTES = 24 << 20
#: Items, and terms of them, in one block.
BLOCK_ITEMS, BLOCK_TERMS = 2_000, 200_000
#: Intervals of so few documents are scored whole; so many intervals are taken at a time.
LEAF, WIDTH = 64, 128
#: Fixed values of the score.
B, TF_SCALE, TF_HALF = 50, 1_000_000_000, 20
#: Stands for a null doc_id inside a shard: after all others.
LAST = (1 << 63) - 1


def terms_of(text: bytes | None) -> list[bytes]:
    """bytes.lower touches ASCII letters only."""
    return TERM.findall(text.lower()) if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


_INDEX = pa.schema([("docs", pa.int64()), ("words", pa.int64()), ("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int64())), ("block", pa.binary())])


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(docs, words, terms, dfs, block): a row a shard; its counts, and its postings of the vocabulary. Stored."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def shard(ids: list[int], sizes: list[int], doc: list[np.ndarray], term: list[np.ndarray], tf: list[np.ndarray]) -> pa.RecordBatch:
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            doc_, term_, tf_ = place[np.concatenate(doc)], np.concatenate(term), np.concatenate(tf)
            o = np.lexsort((doc_, term_))
            doc_, term_, tf_ = doc_[o], term_[o], tf_[o]
            found, dfs = np.unique(term_, return_counts=True)
            n = np.array(sizes, np.int64)
            block = squeeze(np.array(ids, np.int64)[order], n[order], found.astype(np.int32), dfs.astype(np.int32), doc_.astype(np.int32), tf_.astype(np.int32))
            return pa.RecordBatch.from_pylist([{"docs": int((n > 0).sum()), "words": int(n.sum()), "terms": found.tolist(), "dfs": dfs.tolist(), "block": block}], schema=_INDEX)

        ids, sizes, doc, term, tf, held = [], [], [], [], [], 0
        for b in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, whole.num_rows, BATCH_ROWS)):
            d, t, c = [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = terms_of(text)
                if words:
                    for w, k in Counter(words).items():
                        if w in known:
                            d.append(len(ids))
                            t.append(known[w])
                            c.append(k)
                    ids.append(LAST if i is None else i)
                    sizes.append(len(words))
                    held += len(text)
            doc.append(np.array(d, np.int64))
            term.append(np.array(t, np.int64))
            tf.append(np.array(c, np.int64))
            if held >= SHARD_BYTES:
                yield shard(ids, sizes, doc, term, tf)
                ids, sizes, doc, term, tf, held = [], [], [], [], [], 0
        if ids:
            yield shard(ids, sizes, doc, term, tf)
        release_memory()

    found = docs.select(whole_number(docs).alias("doc_id"), "text").mapInArrow(each, "docs long, words long, terms array<int>, dfs array<long>, block binary")
    return stash(found, "postings")


class Best:
    """The k best (score, doc_id) so far: greatest score first, then least id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def may_hold(self, bounds: np.ndarray, least_ids: np.ndarray) -> np.ndarray:
        """Mask of the intervals in which a document could still be among the best."""
        if len(self.scores) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | (bounds == self.scores[-1]) & (least_ids < self.ids[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = self.may_hold(scores, ids)
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


class Shard:
    """Postings with impacts, term by term and in each by document, and one sparse table over all lists.

    table[j][p] is the posting of the greatest impact among the 2^j from p on; a query stays within a list.
    """

    def __init__(self, block: bytes, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, n, terms, dfs, doc, tf = expand(block)
        self.size = len(self.ids)
        n = n.astype(object) if B * int(n.max(initial=0)) * n_docs >= 1 << 63 else n
        m = (100 - B + (B * n * n_docs) // n_terms).astype(np.int64)
        tf, doc = tf.astype(np.int64), doc.astype(np.int64)
        term = np.repeat(terms.astype(np.int64), dfs)
        impact = weights[term] * ((TF_SCALE * tf) // (1000 * tf + TF_HALF * m[doc]))
        some = impact > 0
        self.impact, self.doc, self.keys = impact[some], doc[some], term[some] * self.size + doc[some]
        longest = int(dfs.max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for i in range(2, longest + 1):
            self.log[i] = self.log[i >> 1] + 1
        self.table = [np.arange(len(self.keys), dtype=np.int32)]
        while 2 << len(self.table) - 1 <= longest:
            half, last = 1 << len(self.table) - 1, self.table[-1]
            a, b = last[: max(0, len(last) - half)], last[half:]
            self.table.append(np.where(self.impact[a] >= self.impact[b], a, b))
        self.stacked = np.stack([np.pad(t, (0, len(self.keys) - len(t))) for t in self.table]) if len(self.keys) else None

    def bounds(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the maxima of the lists' stretches, document of the greatest) of each interval; rows: intervals, columns: terms."""
        n = right - left
        none = n <= 0
        left, j = np.where(none, 0, left), self.log[np.maximum(n, 1)]
        a = self.stacked[j, left]
        b = self.stacked[j, np.where(none, 0, right - (1 << j))]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        value = np.where(none, 0, self.impact[at])
        top = value.argmax(axis=1)
        return value.sum(axis=1), self.doc[at[np.arange(len(at)), top]]

    def places(self, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first posting at or after the document, whether it is the document's) by document and term."""
        key = terms[None, :] * self.size + docs[:, None]
        at = np.searchsorted(self.keys, key)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == key

    def leaf_scores(self, lo: np.ndarray, hi: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all documents of some intervals, from what their lists hold there."""
        sizes, held = hi - lo, (right - left).ravel()
        first = np.cumsum(sizes) - sizes
        total = np.zeros(sizes.sum(), np.int64)
        doc, impact = (slices(x, left.ravel(), held) for x in (self.doc, self.impact))
        np.add.at(total, doc + np.repeat(np.repeat(first - lo, left.shape[1]), held), impact)
        return np.repeat(lo - first, sizes) + np.arange(len(total)), total

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Adds to `best` whatever of this shard belongs there. terms: distinct."""
        if self.stacked is None:
            return
        left, right = (np.searchsorted(self.keys, (terms + x) * self.size) for x in (0, 1))
        have = right > left
        terms, left, right = terms[have], left[have][None, :], right[have][None, :]
        if not len(terms):
            return
        lo, hi = np.zeros(1, np.int64), np.full(1, self.size, np.int64)
        bound, split = self.bounds(left, right)
        while True:
            open_ = best.may_hold(bound, self.ids[np.minimum(lo, self.size - 1)]) & (lo < hi)
            if not open_.any():
                return
            lo, hi, left, right, bound, split = (x[open_] for x in (lo, hi, left, right, bound, split))
            take = np.argpartition(-bound, WIDTH)[:WIDTH] if len(bound) > WIDTH else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[take] = False
            small = hi[take] - lo[take] <= LEAF
            leaves, take = take[small], take[~small]
            inside, scores = self.leaf_scores(lo[leaves], hi[leaves], left[leaves], right[leaves])
            at = split[take]
            middle, there = self.places(terms, at)
            own = np.where(there, self.impact[np.minimum(middle, len(self.keys) - 1)], 0).sum(axis=1)
            best.add(np.concatenate([scores, own]), self.ids[np.concatenate([inside, at])])
            parts = [(lo[take], at, left[take], middle), (at + 1, hi[take], middle + there, right[take])]
            new_lo, new_hi, new_left, new_right = (np.concatenate(x) for x in zip(*parts, strict=True))
            new_bound, new_split = self.bounds(new_left, new_right)
            lo, hi, left, right, bound, split = (np.concatenate([x[rest], y]) for x, y in ((lo, new_lo), (hi, new_hi), (left, new_left), (right, new_right), (bound, new_bound), (split, new_split)))


def item_blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, distinct terms) in bounded blocks; the driver holds one at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(t))) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    each_item = items.select("item_id", "text").where("text is not null").mapInArrow(each, f"item_id {kind}, terms array<binary>")
    block, size = [], 0
    for row in each_item.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row.terms) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((row.item_id, [bytes(t) for t in row.terms]))
        size += len(row.terms)
    if block:
        yield block


def _found(docs: DataFrame, block: list[tuple[object, list[bytes]]], k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of each item of the block, by the item's number there."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    wanted = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], np.int64) for _, terms in block]
    shards = index(docs, vocabulary)
    total = shards.agg(F.sum("docs"), F.sum("words")).first()
    df = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).collect()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    weights = np.zeros(len(vocabulary), np.int64)
    for term, n in df:  # a row for each term of the block at most
        weights[term] = weight(n_docs, n)
    sent = spark.sparkContext.broadcast((wanted, weights))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = sent.value
        best = [Best(k) for _ in wanted]
        for b in batches:
            for raw in b.column("block"):
                shard = Shard(raw.as_py(), weights, n_docs, n_terms)
                for terms, top in zip(wanted, best, strict=True):
                    shard.search(terms, top)
        for i, top in enumerate(best):
            if len(top.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids), i, np.int32)), pa.array(top.ids, mask=top.ids == LAST), pa.array(top.scores)], names=["item", "doc_id", "score"])
        release_memory()

    return shards.select("block").mapInArrow(each, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0, equal scores by ascending doc_id."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for block in item_blocks(items):
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {kind.simpleString()}")
        ranked = _found(docs, block, k).withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
