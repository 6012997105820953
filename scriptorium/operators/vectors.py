"""Cosine top-k of many queries over many vectors: exact, block by block; or by an index of lists that covers every vector."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stash

#: Vectors and queries in one block; a pair of blocks is one task's unit of work, a few MB however large the tables are.
NODE_BLOCK, QUERY_BLOCK = 4096, 1024
#: Queries scored at a time within a block.
_ROWS = 128


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit rows; a zero vector stays zero. Vectors of different lengths are an error."""
    flat = column.combine_chunks()
    if len(flat) == 0:
        return np.zeros((0, 0))
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    if np.any(np.diff(flat.offsets.to_numpy()) != rows.shape[1]):
        raise ValueError("vectors of different dimensions")
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores) + 0.0


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of every row; of equal ones the first columns."""
    n = scores.shape[1]
    if n <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    least = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    above, equal = scores > least, scores == least
    equal &= np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | equal)


def _runs(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(codes)) + 1
    yield from zip([0, *edge.tolist()], [*edge.tolist(), len(codes)], strict=True)


def block_hits(queries: DataFrame, nodes: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(query_id, node_id, *by, score): each pair of blocks gives a query's k best per group, in ties the smallest node_id.

    Rows without a vector have no hits. Every vector goes to each block of queries and every query to each block of
    vectors, so a pair meets once; what is shuffled is pairs over block size, and what comes out is k per block.
    """
    # counted as rows: a vector that is computed is not needed for it, and rows without one are left out where they are scored
    node_blocks, query_blocks = (max(1, math.ceil(df.count() / size)) for df, size in ((nodes, NODE_BLOCK), (queries, QUERY_BLOCK)))
    deal = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = nodes.select("node_id", "vec", *by, deal("node_id", node_blocks).alias("nb")).withColumn("qb", every(query_blocks))
    asked = queries.select("query_id", "qvec", deal("query_id", query_blocks).alias("qb")).withColumn("nb", every(node_blocks))

    return _scored(asked, held, ["nb", "qb"], k, by)


#: Groups whose numbers of blocks are sent to all tasks, at most.
SENT_GROUPS = 100_000


def scope_hits(queries: DataFrame, scope: DataFrame, nodes: DataFrame, k: int, by: str) -> DataFrame:
    """(query_id, node_id, by, score): a query's k best of each block of the groups that its scope (query_id, by) admits, in ties the smallest node_id.

    As block_hits, but blocks are of one group: a group's vectors meet only the queries that ask for it, and groups that none asks for are left out.
    """
    wanted = stash(scope.select("query_id", by).distinct(), "scope")
    blocks = lambda df, size, name: df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = stash(blocks(wanted, QUERY_BLOCK, "query_blocks").join(blocks(nodes, NODE_BLOCK, "node_blocks"), by), "blocks")
    sized = F.broadcast(sizes) if sizes.count() <= SENT_GROUPS else sizes
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = nodes.join(sized, by).select("node_id", "vec", by, deal("node_id", "node_blocks").alias("nb"), every("query_blocks").alias("qb"))
    asked = queries.join(wanted, "query_id").join(sized, by).select("query_id", "qvec", by, deal("query_id", "query_blocks").alias("qb"), every("node_blocks").alias("nb"))
    return _scored(asked, held, [by, "nb", "qb"], k, [by])


def _scored(asked: DataFrame, held: DataFrame, keys: list[str], k: int, by: list[str]) -> DataFrame:
    """Of each group of keys, every query's k best vectors per group of `by`."""

    def score(q: pa.Table, v: pa.Table) -> pa.Table:
        q, v = (t.filter(pc.is_valid(t.column(c))) for t, c in ((q, "qvec"), (v, "vec")))
        groups = np.zeros(len(v), np.int64)
        for c in by:
            codes = v.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            groups = np.unique(groups * (len(v) + 1) + codes, return_inverse=True)[1]
        order = np.lexsort((v.column("node_id").to_numpy(), groups))
        v, groups = v.take(pa.array(order)), groups[order]
        left, right = _matrix(q.column("qvec")), _matrix(v.column("vec"))
        rows, columns, scores = [], [], []
        for at in range(0, len(q), _ROWS):
            if not len(v):
                break
            part = _rounded(left[at : at + _ROWS] @ right.T)
            for lo, hi in _runs(groups):
                r, c = _best(part[:, lo:hi], k)
                rows.append(r + at)
                columns.append(c + lo)
                scores.append(part[r, c + lo])
        many = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        taken = v.take(pa.array(many(columns, np.int64)))
        out = {"query_id": q.column("query_id").take(pa.array(many(rows, np.int64))), "node_id": taken.column("node_id")}
        return pa.table({**out, **{c: taken.column(c) for c in by}, "score": pa.array(many(scores, np.float64))})

    schema = T.StructType([asked.schema["query_id"], held.schema["node_id"], *[held.schema[c] for c in by], T.StructField("score", T.DoubleType())])
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(score, schema)


# an index of lists

#: Vectors that centroids are fitted on, at most, and lists of an index, at most: what the driver holds and tasks are sent.
SAMPLE, MOST_LISTS = 10_000, 2_048


def fit_centroids(nodes: DataFrame, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means on at most SAMPLE vectors, those of the smallest hashes of node_id; a list that falls empty starts anew."""
    rows = nodes.where("vec is not null").select("vec").orderBy(F.xxhash64("node_id")).limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.vec for r in rows], np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    start = np.random.default_rng(0)
    centroids = x[start.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        near = np.argmax(x @ centroids.T, axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        empty = np.bincount(near, minlength=len(centroids)) == 0
        total[empty] = x[start.integers(0, len(x), empty.sum())]
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.divide(total, length, out=centroids.copy(), where=length > 0)
    return centroids


def _nearest(rows: DataFrame, column: str, centroids: np.ndarray, many: int) -> DataFrame:
    """rows with `list` and its place: a row for each of the `many` nearest centroids. Map-only; rows without a vector go."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column(column)))
            score = _matrix(pa.chunked_array([b.column(column)])) @ sent.value.T if b.num_rows else np.zeros((0, 1))
            n = min(many, score.shape[1])
            near = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
            out = b.take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            place = np.tile(np.arange(n, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel(), pa.int32()), pa.array(place, pa.int32())], names=[*out.schema.names, "list", "place"])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("place", T.IntegerType())]))


def indexed(nodes: DataFrame, lists: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(nodes with their list, centroids): an inverted file over every vector; about the root of their number of lists, if not given.

    Store it with partitionBy or bucketBy("list") to keep it; a zero vector is in some list.
    """
    lists = lists or max(1, min(MOST_LISTS, round(math.sqrt(nodes.count()))))
    centroids = fit_centroids(nodes, lists)
    if not len(centroids):
        return nodes.limit(0).withColumn("list", F.lit(0)), centroids
    return _nearest(nodes, "vec", centroids, 1).drop("place"), centroids


#: Queries that the number of lists to look at is measured on, at most.
SAMPLE_QUERIES = 256


def probes_for(queries: DataFrame, nodes: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, recall: float = 0.95) -> int:
    """How many lists a query must look at for this share of its exact k best, measured on SAMPLE_QUERIES of the queries (by the hash of their
    id) against every vector: where the exact hits lie among each query's lists."""
    sample = queries.where("qvec is not null").select("query_id", "qvec").orderBy(F.xxhash64("query_id")).limit(SAMPLE_QUERIES)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    exact = block_hits(sample, nodes, k, []).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query_id", "node_id")
    lists = _nearest(sample, "qvec", centroids, len(centroids)).select("query_id", "list", "place")
    at = exact.join(index.select("node_id", "list"), "node_id").join(lists, ["query_id", "list"])
    found = at.agg(F.percentile_approx("place", F.lit(recall), F.lit(10_000))).first()[0]
    return max(1, len(centroids) if found is None else found + 1)


def probed_hits(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, probes: int, by: list[str] | None = None) -> DataFrame:
    """(query_id, node_id, *by, score): as block_hits, but a query meets only the vectors of its `probes` nearest lists; all lists give what
    block_hits gives. A list is dealt into blocks of NODE_BLOCK vectors and its queries into blocks of QUERY_BLOCK, so one that
    holds a third of all vectors is many groups."""
    by = by or []
    asked = _nearest(queries.select("query_id", "qvec"), "qvec", centroids, probes) if len(centroids) else queries.select("query_id", "qvec", F.lit(0).alias("list")).limit(0)
    blocks = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / NODE_BLOCK).cast("int").alias("parts"))
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    sized = F.broadcast(blocks)  # MOST_LISTS rows at most
    held = index.join(sized, "list").select("node_id", "vec", *by, "list", F.pmod(F.xxhash64("node_id"), "parts").cast("int").alias("nb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    asked = asked.join(sized, "list").select("query_id", "qvec", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("nb"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("qb"))
    return _scored(asked, held, ["list", "nb", "qb"], k, by)
