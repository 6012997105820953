"""Recall along the tree: papers, their sections, the sections' chunks, beside a recall over all chunks; and expansion level by level.

roots: (paper, node_id, text); sections: (paper, node_id, text); chunks: (paper, parent, node_id, text); queries: (query_id, qvec, papers).
A scope is applied before anything is scored: nodes are chosen by a semi-join, and only what is left is embedded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine, hash_vector
from .planning import Budget, in_scope
from .retrieval import top_k, vector_top_k

def _best() -> list[Column]:
    return [F.col("score").desc(), F.col("node_id")]


def scored_in_scope(queries: DataFrame, scope: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """(query_id, by, node_id, score) of the nodes that each query's scope (query_id, by) admits; nodes have vec, or text to embed."""
    vec = F.col("vec") if "vec" in nodes.columns else hash_vector(F.col("text"))
    held = in_scope(nodes, scope.select(by).distinct(), [by]).select(by, "node_id", vec.alias("vec"))
    met = held.join(scope.select("query_id", by).distinct(), by).join(queries.select("query_id", "qvec"), "query_id")
    return met.select("query_id", by, "node_id", F.round(cosine(F.col("qvec"), F.col("vec")), 6).alias("score"))


def _over_all(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    return vector_top_k(queries.select("query_id", "qvec"), nodes.select("node_id", hash_vector(F.col("text")).alias("vec")), k).select("query_id", "node_id", "score", "rank")


def routed_papers(queries: DataFrame, roots: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(query_id, paper): a query's own papers, or the papers of the nearest roots."""
    own = queries.where(F.size("papers") > 0).select("query_id", F.explode("papers").alias("paper"))
    free = queries.where(F.size("papers") == 0)
    near = _over_all(free, roots, budget.max_papers).join(roots.select("node_id", "paper"), "node_id").select("query_id", "paper")
    return own.unionByName(near).distinct()


def recalled(queries: DataFrame, roots: DataFrame, sections: DataFrame, chunks: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(query_id, node_id, score, channel, rank): each query's chunks, best first.

    Routing to papers, the nearest sections of each, the nearest chunks under those; and the nearest of all chunks in the query's scope. A
    chunk that both ways find counts once; channel says which found it first.
    """
    routed = routed_papers(queries, roots, budget)
    near = top_k(scored_in_scope(queries, routed, sections, "paper"), ["query_id", "paper"], _best(), budget.sections_per_paper)
    under = top_k(scored_in_scope(queries, near.select("query_id", F.col("node_id").alias("parent")), chunks, "parent"), ["query_id"], _best(), budget.initial_top_k)
    scoped = queries.where(F.size("papers") > 0)
    inside = scored_in_scope(scoped, scoped.select("query_id", F.explode("papers").alias("paper")), chunks, "paper")
    fallback = top_k(inside, ["query_id"], _best(), budget.global_fallback_top_k).select("query_id", "node_id", "score")
    fallback = fallback.unionByName(_over_all(queries.where(F.size("papers") == 0), chunks, budget.global_fallback_top_k).select("query_id", "node_id", "score"))
    both = under.select("query_id", "node_id", "score", F.lit("hierarchy").alias("channel")).unionByName(fallback.withColumn("channel", F.lit("fallback")))
    once = both.groupBy("query_id", "node_id").agg(F.max("score").alias("score"), F.max("channel").alias("channel"))
    return top_k(once, ["query_id"], _best(), budget.initial_top_k + budget.global_fallback_top_k)


def expanded_levels(queries: DataFrame, hits: DataFrame, nodes: DataFrame, levels: int = 2, most: int = Budget().max_expanded_per_hit) -> DataFrame:
    """(query_id, anchor, node_id, score, level): chunks that hang near a query's hits, found level by level.

    hits: (query_id, node_id); nodes: (node_id, parent, kind, text), kind chunk or another. The first frontier is the hit chunks' parents and the
    other hits. Each level joins the frontier with its children: chunks that are no candidates yet are scored and the best of each anchor
    become candidates; other nodes that were on no frontier yet are the next one.
    """
    start = hits.join(nodes.select("node_id", "parent", "kind"), "node_id")
    frontier = start.select("query_id", F.when((F.col("kind") == "chunk") & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("node_id")).alias("anchor")).distinct()
    known, visited, out = hits.select("query_id", "node_id"), frontier, None
    for level in range(1, levels + 1):
        children = nodes.withColumnRenamed("parent", "anchor").join(frontier, "anchor")
        fresh = children.where("kind = 'chunk'").join(known, ["query_id", "node_id"], "left_anti").select("query_id", "anchor", "node_id")
        held = in_scope(nodes, fresh.select("node_id").distinct(), ["node_id"]).select("node_id", hash_vector(F.col("text")).alias("vec"))
        scored = fresh.join(held, "node_id").join(queries.select("query_id", "qvec"), "query_id").select("query_id", "anchor", "node_id", F.round(cosine(F.col("qvec"), F.col("vec")), 6).alias("score"))
        best = top_k(scored, ["query_id", "anchor"], _best(), most).drop("rank").withColumn("level", F.lit(level))
        out = best if out is None else out.unionByName(best)
        if level < levels:
            known = known.unionByName(best.select("query_id", "node_id"))
            deeper = children.where("kind <> 'chunk'").select("query_id", F.col("node_id").alias("anchor"))
            frontier = deeper.join(visited, ["query_id", "anchor"], "left_anti").distinct()
            visited = visited.unionByName(frontier)
    return out
