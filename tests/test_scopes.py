"""Vectors of the groups that a query's scope admits, block by block, against every pair."""

import numpy as np
from pyspark.sql import functions as F

from scriptorium import catalog
from scriptorium.operators import hierarchy, vectors
from scriptorium.operators.retrieval import top_k


def test_scoped_hits_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(vectors, "NODE_BLOCK", 30)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    r = np.random.default_rng(5)
    nodes = spark.createDataFrame([(i, r.integers(-2, 3, 4).astype(float).tolist(), int(r.integers(6)) if i % 3 else 1) for i in range(400)], "node_id long, vec array<double>, label int")
    queries = spark.createDataFrame([(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(20)], "query_id long, qvec array<double>")
    scope = spark.createDataFrame([(i, x) for i in range(19) for x in (i % 3, 1, 9)], "query_id long, label int")  # two of a kind, a label without vectors, a query without scope
    best = lambda hits: sorted(map(tuple, top_k(hits, ["query_id", "label"], [F.col("score").desc(), F.col("node_id")], 3).select("query_id", "label", "node_id", "score", "rank").collect()))
    assert best(vectors.scope_hits(queries, scope, nodes, 3, "label")) == best(hierarchy.scored_in_scope(queries, scope, nodes, "label")) != []


def test_scoped_chunks_score_no_pair_by_rows(spark):
    plan = catalog.QUERIES["scoped_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "qvec" in plan and "zip_with" not in plan.lower() and "zipwith" not in plan.lower()
