"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

Sets are the distinct word n-grams of a text. The global order of n-grams is (document frequency, hash); frequencies
are exact up to EXACT and four steps a doubling beyond.
  1. scan: a chunk of documents gives its n-grams in blocks by n-gram range; equal sets of a chunk are one item, and an n-gram
     of several items of a chunk is asked about once, with its count: a very frequent one costs its range one entry a chunk.
  2. count: per range, the frequency of each n-gram; those of one item only can support no link and are dropped.
  3. order: per chunk, an item's shared n-grams in the global order, with the number of its unshared ones before
     them, the prefix that any partner must meet, and the whole cut into vertical fragments of the order.
  4. candidates: items that meet in a prefix n-gram and pass the length and the position filters. Each n-gram's
     items are first compared with one centre; then only items not yet in one component are compared with each
     other, so a large group of copies costs links in proportion to its size, and no link between components is lost. In that
     second step the smaller of two sets is met in the shorter prefix that a partner of its size or more leaves, the
     items of an n-gram's largest component meet only those outside it, and a frequent n-gram's are split into blocks of PAIR_ROWS.
  5. verify: partial overlaps are counted fragment by fragment and summed per pair; 100 * overlap >= 100 * t * union.
Equal sets are classes: one node, however many documents; nodes are 64-bit set signatures.

Words: runs of non-blank characters, A-Z lowered. A text with fewer than n words has the whole sequence as its one n-gram; one
without words, or null, has an empty set and no links. Repeated rows are answered one by one,
and a row's own set decides its component. A doc_id that is no whole number counts as null; null ids come after
all others, and a component of null ids only has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repeats import BLOCKS_DDL, NULL_ID, U64, block_table, bucket_count, bucket_of, expand, rows_of, span_hash, squeeze, whole_number, word_hashes, word_spans
from .shared import attach, components, discard, mix64, paths, release_memory, stash

#: Text in one scan chunk.
CHUNK_BYTES = 2 << 20
#: Frequencies up to here are exact, in one byte; beyond, a code has four steps a doubling, up to 2 ** 38.
EXACT = 127
#: Cuts of the global order: fragments hold frequencies below each bound, each again in two by hash.
CUTS = np.array([3, 5, 17, EXACT + 1])
#: Items of one n-gram in one block of the second step.
PAIR_ROWS = 2048
_SALT = U64(0xD6E8FEB86659FD93)


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every n-gram place, in text order."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts, ends = word_spans(raw)
    words = word_hashes(raw, starts, ends)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    sizes = np.diff(bounds)
    grams = mix64(span_hash(words, n)) if len(words) >= n else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(grams)]
    inside = np.arange(len(grams)) + n <= bounds[1:][owner]
    grams, owner = grams[inside], owner[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        whole = np.array([int(mix64(span_hash(words[bounds[i] : bounds[i + 1]], int(sizes[i])) + np.full(1, _SALT) * U64(sizes[i]))[0]) for i in short], U64)
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    return grams, owner


def frequency_codes(frequency: np.ndarray) -> np.ndarray:
    """One-byte codes in the order of the frequencies."""
    rough = EXACT + 1 + np.floor(4 * np.log2(np.maximum(frequency, 1) / (EXACT + 1)))
    return np.where(frequency <= EXACT, frequency, np.minimum(rough, 255)).astype(np.uint8)


def _distinct(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (n-gram, text) once, by n-gram."""
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], owner[new]


def signatures(grams: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, 64-bit set signature) of each text; 0 for an empty set."""
    size, total = np.bincount(owner, minlength=count), np.zeros(count, U64)
    np.add.at(total, owner, mix64(grams ^ _SALT))
    return size, np.where(size > 0, mix64(total + size.astype(U64)), U64(0))


def text_key() -> Column:
    """64-bit hash of a row's text as it stands: with doc_id, what tells rows apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def ordered_items(docs: DataFrame, n: int, t: int) -> DataFrame:
    """Steps 1 to 3: a row per document with doc_id, text_key, n_shingles, node, unshared, prefix, fragments.

    prefix and fragments are empty for documents that can have no partner, and for all but one of equal sets in a chunk.
    A chunk is named by its task's partition and its number there. Its blocks also carry a digest of its rows in their order:
    a task that ran again over rows in another order is an error, not a mixture.
    """
    buckets = bucket_count(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(chunk: int, ids: list[int], keys: list[np.ndarray], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            grams, owner = _distinct(*shingles(texts, n))
            size, sig = signatures(grams, owner, len(ids))
            doc = np.array(ids, np.int64)
            order = np.lexsort((doc, sig))
            first = np.zeros(len(ids), bool)
            first[order] = np.concatenate([[True], sig[order][1:] != sig[order][:-1]])
            keep = first[owner]
            grams, owner = grams[keep], owner[keep].astype(np.uint32)
            name = np.array([chunk, mix64(mix64(sig + mix64(doc.view(U64))) + np.arange(len(doc), dtype=U64)).sum().view(np.int64)])
            start = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            many = np.diff(np.append(start, len(grams)))
            several = np.repeat(many > 1, many)  # these stay with the chunk's head; the range is asked once
            asked, count = grams[start], many.astype(np.uint32)
            bucket = (asked >> U64(32)) * U64(buckets) >> U64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
            head = (doc, np.concatenate(keys), size.astype(np.uint32), sig, first.astype(np.uint8), np.diff(grams[several], prepend=U64(0)), owner[several])
            out = [(buckets + int(bucket_of(name[:1], buckets)[0]), squeeze(name, *head))]
            alone = owner[start]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                r = slice(cuts[b], cuts[b + 1])
                out.append((b, squeeze(name, np.diff(asked[r], prepend=U64(0)), count[r], alone[r][count[r] == 1])))
            yield from block_table(out).to_batches()

        chunk = TaskContext.get().partitionId() << 32
        ids, keys, texts, held = [], [], [], 0
        for b in batches:
            key = b.column("text_key").to_numpy()
            for k, (i, x) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True)):
                raw = (x.as_py() or "").encode("utf-8").lower()
                ids.append(NULL_ID if i is None else i)
                keys.append(key[k : k + 1])
                texts.append(raw)
                held += len(raw)
                if held >= CHUNK_BYTES:
                    yield from flush(chunk, ids, keys, texts)
                    chunk += 1
                    ids, keys, texts, held = [], [], [], 0
        if ids:
            yield from flush(chunk, ids, keys, texts)
        release_memory()

    def count(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            return block_table([(int(expand(x)[0][0]), x) for x in rows_of(table)])
        parts = [expand(x) for x in rows_of(table)]
        grams, count = np.concatenate([np.cumsum(p[1], dtype=U64) for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.argsort(grams, kind="stable")
        s = grams[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        group = np.cumsum(new) - 1
        df = np.empty(len(grams), np.int64)
        df[order] = np.bincount(group, weights=count[order])[group]
        code = frequency_codes(df)
        out, ends = [], np.cumsum([len(p[1]) for p in parts])
        for p, end in zip(parts, ends.tolist(), strict=True):
            g, c, d, k = (x[end - len(p[1]) : end] for x in (grams, count, df, code))
            one, several = c == 1, c > 1
            shared = one & (d > 1)
            if shared.any() or several.any():
                out.append((int(p[0][0]), squeeze(p[0], np.diff(g[shared], prepend=U64(0)), p[3][shared[one]], k[shared], np.diff(g[several], prepend=U64(0)), k[several])))
        return block_table(out)

    def order(table: pa.Table) -> pa.Table:
        parts = [expand(x) for x in rows_of(table)]
        heads, blocks = [p for p in parts if len(p) == 8], [p for p in parts if len(p) == 6]
        if len(heads) != 1 or any((p[0] != heads[0][0]).any() for p in blocks):
            raise RuntimeError(f"a scan chunk with {len(heads)} heads, or blocks of other rows than its head's")
        doc, key, size, sig, first, several, several_of = heads[0][1:]
        size, several = size.astype(np.int64), np.cumsum(several, dtype=U64)
        column = lambda i, kind: np.concatenate([np.cumsum(p[i], dtype=U64) if kind is U64 else p[i] for p in blocks]) if blocks else np.zeros(0, kind)
        grams, owner, df, known, code = (column(i, z) for i, z in ((1, U64), (2, np.uint32), (3, np.uint8), (4, U64), (5, np.uint8)))
        by_gram = np.argsort(known)
        grams, owner = np.concatenate([grams, several]), np.concatenate([owner, several_of])
        df = np.concatenate([df, code[by_gram][np.searchsorted(known[by_gram], several)]])
        o = np.lexsort((grams, df, owner))
        grams, owner, df = grams[o], owner[o].astype(np.int64), df[o].astype(np.int64)
        have = np.bincount(owner, minlength=len(doc))
        unshared = np.where(first > 0, size - have, size)
        place = np.arange(len(owner)) - (np.cumsum(have) - have)[owner] + unshared[owner]
        prefix = 100 * (size[owner] - place) >= t * size[owner]
        n_prefix = np.bincount(owner[prefix], minlength=len(doc))
        useful = n_prefix[owner] > 0
        fragment = 2 * np.searchsorted(CUTS, df, side="right") + (grams >> U64(63)).astype(np.int64)
        g, w, f = grams[useful].view(np.int64), owner[useful], fragment[useful]
        o = np.lexsort((g, f, w))
        g, w, f = g[o], w[o], f[o]
        edge = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (f[1:] != f[:-1])])) if len(g) else np.zeros(0, np.int64)
        offsets = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]).astype(np.int32))
        grams_of = pa.ListArray.from_arrays(pa.array(np.append(edge, len(g)).astype(np.int32)), pa.array(g))
        frags = pa.StructArray.from_arrays([pa.array(f[edge].astype(np.int32)), grams_of], names=["fragment", "grams"])
        columns = [
            pa.array([None if i == NULL_ID else i for i in doc.tolist()], pa.int64()),
            pa.array(key),
            pa.array(size),
            pa.array(sig.view(np.int64)),
            pa.array(unshared),
            pa.ListArray.from_arrays(offsets(n_prefix), pa.array(grams[prefix].view(np.int64))),
            pa.ListArray.from_arrays(offsets(np.bincount(w[edge], minlength=len(doc))), frags),
        ]
        return pa.table(columns, names=["doc_id", "text_key", "n_shingles", "node", "unshared", "prefix", "fragments"])

    scanned = docs.select(whole_number(docs).alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(scan, BLOCKS_DDL)
    counted = scanned.groupBy("bucket").applyInArrow(count, BLOCKS_DDL)
    return counted.groupBy("bucket").applyInArrow(order, "doc_id long, text_key long, n_shingles long, node long, unshared long, prefix array<long>, fragments array<struct<fragment: int, grams: array<long>>>")


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b, size_a, size_b) that reach the threshold: partial overlaps by fragment, summed per pair."""
    left = sets.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("n"))
    total = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    return total.where((100 + t) * F.col("n") >= t * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def links(items: DataFrame, t: int) -> DataFrame:
    """Steps 4 and 5: links (a, b) between nodes, enough of them to connect every component of the whole link graph. Stored; what was
    stored on the way is deleted."""
    spark = items.sparkSession
    live = items.where(F.size("prefix") > 0).dropDuplicates(["node"])
    live = stash(live.select("node", "n_shingles", "unshared", "prefix", "fragments"), "items")
    sets = live.select("node", F.explode("fragments").alias("f")).select("node", "f.fragment", "f.grams")
    grams = live.select("node", F.col("n_shingles").alias("size"), F.posexplode("prefix").alias("i", "gram"), "unshared")
    # a row's place in its item's order; the share of unshared n-grams is least for the item nearest to its group's middle
    grams = grams.select("gram", "node", "size", (F.col("unshared") + F.col("i")).alias("place"), (F.col("unshared") / F.col("size")).alias("odd"))

    def fits(a: str, b: str):
        sa, sb = F.col(f"size_{a}"), F.col(f"size_{b}")
        left = F.least(sa - F.col(f"place_{a}"), sb - F.col(f"place_{b}"))
        return (100 * F.least(sa, sb) >= t * F.greatest(sa, sb)) & ((100 + t) * left >= t * (sa + sb))

    def as_(side: str, df: DataFrame) -> DataFrame:
        return df.select("gram", F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("place").alias(f"place_{side}"))

    def ordered(pairs: DataFrame) -> DataFrame:
        swap = F.col("a") > F.col("b")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        return pairs.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("size_a", "size_b").alias("size_a"), pick("size_b", "size_a").alias("size_b")).distinct()

    centres = grams.groupBy("gram").agg(F.min_by(F.struct("node", "size", "place"), F.struct("odd", "node")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    centres = centres.select("gram", F.col("c.node").alias("a"), F.col("c.size").alias("size_a"), F.col("c.place").alias("place_a"))
    star = ordered(attach(as_("b", grams), centres, "gram", "inner").where("a != b").where(fits("a", "b")))
    star = stash(star, "pairs")
    found = stash(_verified(star, sets, t), "links")
    label = components(found).select(F.col("id").alias("node"), "component")
    named = attach(grams, label, "node").select("gram", "node", "size", "place", F.coalesce("component", "node").alias("label"))
    named = stash(named, "named")
    by_label = named.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_label.groupBy("gram").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    blocks = lambda n: F.ceil(n / PAIR_ROWS).cast("int")
    met = stash(attach(named, mixed.select("gram", "top", blocks(F.col("n")).alias("all"), blocks(F.col("n") - F.col("most")).alias("few")), "gram", "inner"), "mixed")
    discard(spark, paths(named))
    first = (F.col("size_a") > F.col("size_b")) | (F.col("size_a") == F.col("size_b")) & (F.col("a") > F.col("b"))
    short = (100 + t) * (F.col("size") - F.col("place")) >= 2 * t * F.col("size")

    def meet(left: DataFrame, right: DataFrame, n: str) -> DataFrame:
        larger = left.select("gram", F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("block"), *_side("a"))
        smaller = right.where(short).select("gram", F.pmod(F.xxhash64("node"), n).cast("int").alias("block"), *_side("b"))
        return larger.join(smaller, ["gram", "block"]).where(first & (F.col("label_a") != F.col("label_b")) & fits("a", "b"))

    others, most = met.where("label != top"), met.where("label = top")  # those of the n-gram's largest component never meet each other
    rest = meet(others, met, "all").unionByName(meet(most, others, "few"))
    rest = ordered(rest).join(star, ["a", "b"], "left_anti")
    out = stash(found.unionByName(_verified(rest, sets, t)), "all-links")
    for done in (live, star, found, met):
        discard(spark, paths(done))
    return out


def _side(side: str) -> list[Column]:
    return [F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", "place", "label")]]


def _keyed_rows(docs: DataFrame, n: int, t: int) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, and as key its component's least node; null for an empty set. Stored."""
    items = stash(ordered_items(docs, n, t), "sets")
    linked = links(items, t)
    own = stash(items.select("doc_id", "text_key", "n_shingles", "node"), "rows")
    discard(docs.sparkSession, paths(items))
    label = components(linked).select(F.col("id").alias("node"), "component")
    rows = attach(own, label, "node")
    return stash(rows.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("key")), "keys")


def join(docs: DataFrame, n: int = 5, t: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity t / 100 or more)."""
    rows = _keyed_rows(docs, n, t)
    least = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    return attach(rows, least, "key").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_each(docs: DataFrame, n: int = 5, t: int = 80) -> DataFrame:
    """One row of docs per component, and every row without words.

    Rows are told apart by (doc_id, text). Of a component's rows that with the smallest doc_id stays, a null one last;
    of several with that id, one fixed by the hash of its text.
    """
    wordless = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    some = docs.where(~wordless)
    kept = _keyed_rows(some, n, t).groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("least"))
    kept = kept.select(F.coalesce("least.doc_id", F.lit(NULL_ID)).alias("own_id"), F.col("least.text_key").alias("own_key"))
    inner = some.select(F.struct("*").alias("row"), F.coalesce(whole_number(docs), F.lit(NULL_ID)).alias("own_id"), text_key().alias("own_key"))  # any names of docs are inside the structure
    inner = inner.join(kept, ["own_id", "own_key"], "left_semi").dropDuplicates(["own_id", "own_key"])
    return inner.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)).unionByName(docs.where(wordless))
