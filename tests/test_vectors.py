"""Blocked top-k against brute force, with ties, zero and missing vectors, several blocks and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import hash_vector
from scriptorium.operators import hierarchy, retrieval, vectors
from scriptorium.operators.retrieval import top_k

NODES, QUERIES = "node_id long, vec array<float>, label string", "query_id long, qvec array<float>"


def brute(queries, nodes, k, grouped):
    out = set()
    for q, a in queries:
        if a is None:
            continue
        groups = {}
        for n, v, label in nodes:
            if v is not None:
                x, y = np.array(a, float), np.array(v, float)
                both = np.linalg.norm(x) * np.linalg.norm(y)
                groups.setdefault(label if grouped else 0, []).append((-(round(x @ y / both, 6) if both else 0.0), n))
        for label, found in groups.items():
            out |= {(q, n, label if grouped else None, rank, round(-s, 6) + 0.0) for rank, (s, n) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("grouped", [False, True])
def test_blocks(spark, monkeypatch, grouped):
    monkeypatch.setattr(vectors, "NODE_BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(3)
    nodes = [(i, rng.integers(-3, 4, 4).astype(float).tolist(), [None, "a", "b"][i % 3]) for i in range(100)]
    nodes += [(100 + i, [1.0, 2.0, 0.0, 0.0], "a") for i in range(40)] + [(200, [0.0] * 4, "b"), (201, None, "a")]
    queries = [(i, v) for i, v, _ in nodes[:10]] + [(50, [0.0] * 4), (51, None), (52, [1.0, 2.0, 0.0, 0.0])]
    found = retrieval.vector_top_k(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(nodes, NODES), 6, ["label"] if grouped else None)
    got = {(r.query_id, r.node_id, r.label if grouped else None, r["rank"], r.score) for r in found.collect()}
    assert got == brute(queries, nodes, 6, grouped)


def test_empty(spark):
    some, none = spark.createDataFrame([(1, [1.0], "a")], NODES), spark.createDataFrame([], NODES)
    asked, nobody = spark.createDataFrame([(1, [1.0])], QUERIES), spark.createDataFrame([], QUERIES)
    assert retrieval.vector_top_k(asked, none, 3).count() == 0
    assert retrieval.vector_top_k(nobody, some, 3).count() == 0


def _clustered(spark, n, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(24, 16))
    rows = [(i, (centres[i % 24] + 0.35 * r.normal(size=16)).tolist(), i % 3) for i in range(n)]
    rows += [(n + i, centres[0].tolist(), 0) for i in range(n // 3)] + [(9_000_000, None, 1), (9_000_001, [0.0] * 16, 1)]  # a third is one vector
    return spark.createDataFrame(rows, "node_id long, vec array<double>, label int").repartition(4)


def test_index_covers_every_vector(spark, monkeypatch):
    monkeypatch.setattr(vectors, "NODE_BLOCK", 100)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    nodes = _clustered(spark, 900)
    queries = nodes.where("node_id % 20 = 0").selectExpr("node_id AS query_id", "vec AS qvec")
    index, centroids = vectors.indexed(nodes, 12)
    assert index.count() == nodes.where("vec is not null").count()
    best = lambda hits: sorted(map(tuple, top_k(hits, ["query_id", "label"], [F.col("score").desc(), F.col("node_id")], 4).select("query_id", "label", "node_id", "score").collect()))
    assert best(vectors.probed_hits(queries, index, centroids, 4, 12, ["label"])) == best(vectors.block_hits(queries, nodes, 4, ["label"]))


def test_recall_of_a_few_lists(spark):
    nodes = _clustered(spark, 3000)
    queries = nodes.where("node_id % 20 = 0 and node_id < 3000").selectExpr("node_id AS query_id", "vec AS qvec")
    index, centroids = vectors.indexed(nodes, 40)
    ids = lambda hits: {(r.query_id, r.node_id) for r in top_k(hits, ["query_id"], [F.col("score").desc(), F.col("node_id")], 10).collect()}
    exact, found = ids(vectors.block_hits(queries, nodes, 10, [])), ids(vectors.probed_hits(queries, index, centroids, 10, 8))
    assert len(exact & found) >= 0.9 * len(exact)


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "node_id long, vec array<double>, label int")
    index, centroids = vectors.indexed(none)
    assert vectors.probed_hits(none.selectExpr("node_id AS query_id", "vec AS qvec"), index, centroids, 3, 2).count() == 0


def test_scope_comes_before_embedding(spark):
    """Only what a semi-join left is embedded; nothing is computed as a filter of the scan."""
    nodes = spark.createDataFrame([(1, "a", "one word"), (2, "b", "two words")], "paper long, node_id string, text string")
    queries = spark.createDataFrame([(1, [1.0] * 64)], "query_id long, qvec array<double>")
    scope = spark.createDataFrame([(1, 2)], "query_id long, paper long")
    out = hierarchy.scored_in_scope(queries, scope, nodes, "paper")
    assert [r.node_id for r in out.collect()] == ["b"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") <= 2 and "LeftSemi" in plan[plan.index("md5") :]


def test_expansion_over_levels(spark):
    texts = {"p": "root", "s1": "alpha", "s2": "beta", "c1": "alpha word", "c2": "alpha other", "c3": "beta thing", "x": "deep", "c4": "alpha deep"}
    parents = {"s1": "p", "s2": "p", "c1": "s1", "c2": "s1", "c3": "s2", "x": "s2", "c4": "x"}
    kind = lambda n: "chunk" if n[0] == "c" else "root" if n == "p" else "section"
    nodes = spark.createDataFrame([(n, parents.get(n), kind(n), t) for n, t in texts.items()], "node_id string, parent string, kind string, text string")
    queries = spark.createDataFrame([(1,)], "query_id long").withColumn("qvec", hash_vector(F.lit("alpha word")))
    found = lambda hits, levels: sorted((r.node_id, r.level) for r in hierarchy.expanded_levels(queries, spark.createDataFrame([(1, h) for h in hits], "query_id long, node_id string"), nodes, levels).collect())
    assert found(["c1"], 2) == [("c2", 1)]
    assert found(["p"], 1) == [] and found(["p"], 2) == [("c1", 2), ("c2", 2), ("c3", 2)] and found(["p", "c1"], 3) == [("c2", 1), ("c3", 2), ("c4", 3)]


def test_lists_to_look_at_are_measured(spark):
    """Vectors without clusters need most lists; clustered ones few."""
    r = np.random.default_rng(1)
    spread = spark.createDataFrame([(i, r.normal(size=16).tolist(), 0) for i in range(1500)], "node_id long, vec array<double>, label int")
    ids = lambda hits: {(x.query_id, x.node_id) for x in top_k(hits, ["query_id"], [F.col("score").desc(), F.col("node_id")], 10).collect()}
    needed = []
    for nodes in (spread, _clustered(spark, 1500)):
        queries = nodes.where("node_id % 20 = 0 and node_id < 1500").selectExpr("node_id AS query_id", "vec AS qvec")
        index, centroids = vectors.indexed(nodes, 30)
        needed.append(vectors.probes_for(queries, nodes, index, centroids, 10))
        exact, found = ids(vectors.block_hits(queries, nodes, 10, [])), ids(vectors.probed_hits(queries, index, centroids, 10, needed[-1]))
        assert len(exact & found) >= 0.9 * len(exact)
    assert needed[1] < needed[0] <= 30
