"""Requests to plans: sub-questions with inherited scopes, targets, strategy, budget; and what sub-questions' hits add up to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .retrieval import normalised
from .selection import strategy

# Modes of a request that look at a hit's surroundings.
EXPANDING = ("summary", "method", "compare", "synthesis")


@dataclass(frozen=True)
class Budget:
    """The default limits of a request."""

    max_papers: int = 5
    sections_per_paper: int = 3
    initial_top_k: int = 12
    global_fallback_top_k: int = 6
    keyword_top_k: int = 10
    max_expanded_per_hit: int = 8
    rerank_candidate_limit: int = 30
    max_chunks_per_paper: int = 3
    final_top_k: int = 8
    max_final_top_k: int = 24
    multi_paper_chunks: int = 2
    survey_papers: int = 20
    survey_final: int = 16


def planned(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """(request, ord, query, mode, papers, dimension): the distinct sub-questions of each request in order.

    requests: (request, query, mode, papers array); questions: (request, ord, query, mode, papers array, dimension). A
    sub-question without papers inherits the request's, an empty dimension is none; of equal ones the first stays; a request without any is its own only one.
    """
    asked = requests.select("request", F.col("query").alias("r_query"), F.col("mode").alias("r_mode"), F.col("papers").alias("r_papers"))
    rows = asked.join(questions, "request", "left")
    own = F.col("ord").isNull()
    scope = F.when(own | (F.size("papers") == 0), F.col("r_papers")).otherwise(F.col("papers"))
    pick = lambda mine, theirs: F.when(own, F.col(theirs)).otherwise(F.col(mine))
    rows = rows.select("request", F.coalesce("ord", F.lit(0)).alias("ord"), pick("query", "r_query").alias("query"), pick("mode", "r_mode").alias("mode"), scope.alias("papers"), F.nullif("dimension", F.lit("")).alias("dimension"))
    return rows.groupBy("request", "query", "mode", "papers", "dimension").agg(F.min("ord").alias("ord"))


def budgets(requests: DataFrame, plan: DataFrame, base: Budget = Budget()) -> DataFrame:
    """(request, targets, strategy, expands, and the nine limits) of each request with its plan."""
    merged = plan.groupBy("request").agg(F.array_distinct(F.flatten(F.collect_list("papers"))).alias("scoped"), F.count(F.lit(1)).cast("int").alias("q"), F.count_distinct("dimension").cast("int").alias("d"), F.bool_or(F.col("mode").isin(*EXPANDING)).alias("some"))
    rows = requests.join(merged, "request").withColumn("targets", F.array_union("papers", "scoped"))
    n, q, d = F.size("targets"), F.col("q"), F.greatest("d", F.lit(1))
    kind = strategy(n, q, F.col("d"))
    p, share = F.greatest(n, F.lit(1)), F.greatest(F.lit(base.multi_paper_chunks), d)
    at_least = lambda name, other: F.greatest(F.lit(getattr(base, name)), other)
    multi = {
        "max_papers": at_least("max_papers", p), "sections_per_paper": F.lit(max(base.sections_per_paper, 2)), "initial_top_k": at_least("initial_top_k", 3 * p), "global_fallback_top_k": at_least("global_fallback_top_k", 2 * p),
        "keyword_top_k": at_least("keyword_top_k", 2 * p), "rerank_candidate_limit": at_least("rerank_candidate_limit", 3 * p * share), "max_chunks_per_paper": share, "final_top_k": F.greatest(F.lit(base.final_top_k), p * share, 2 * q),
    }
    survey = {
        "max_papers": F.lit(max(base.max_papers, base.survey_papers)), "initial_top_k": F.lit(max(base.initial_top_k, 20)), "global_fallback_top_k": F.lit(max(base.global_fallback_top_k, 12)), "keyword_top_k": F.lit(max(base.keyword_top_k, 12)),
        "rerank_candidate_limit": F.lit(max(base.rerank_candidate_limit, 40)), "max_chunks_per_paper": F.lit(min(base.max_chunks_per_paper, 2)), "final_top_k": F.lit(max(base.final_top_k, base.survey_final)),
    }
    single = {"sections_per_paper": at_least("sections_per_paper", F.least(q, F.lit(6))), "initial_top_k": at_least("initial_top_k", 3 * q), "final_top_k": at_least("final_top_k", 2 * q)}

    def limit(name: str) -> Column:
        usual = F.lit(getattr(base, name))
        value = F.when(kind == "multi_paper", multi.get(name, usual)).when(kind == "corpus_survey", survey.get(name, usual)).otherwise(single.get(name, usual))
        return F.least(value, F.lit(base.max_final_top_k)) if name == "final_top_k" else value

    names = ("max_papers", "sections_per_paper", "initial_top_k", "global_fallback_top_k", "keyword_top_k", "max_expanded_per_hit", "rerank_candidate_limit", "max_chunks_per_paper", "final_top_k")
    return rows.select("request", "targets", kind.alias("strategy"), (F.col("mode").isin(*EXPANDING) | F.col("some")).alias("expands"), *[limit(x).cast("int").alias(x) for x in names])


def in_order(value: Column, order: Column) -> Column:
    """Distinct values by their first place; nulls drop. An aggregate."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


def merged_hits(hits: DataFrame, constant: int = 60) -> DataFrame:
    """One candidate per (request, node) from the hits of all sub-questions and channels.

    hits: (request, ord, channel, node_id, score, rank, query, dimension). Best score of each channel, the first channel's name
    (vector before keyword in each sub-question), queries and dimensions in order of the sub-questions, fused score.
    """
    vector = F.col("channel") == "vector"
    by = hits.groupBy(F.col("request").alias("query_id"), "node_id").agg(
        F.coalesce(F.max(F.when(vector, F.col("score"))), F.lit(0.0)).alias("vector_score"), F.max(F.when(~vector, F.col("score"))).alias("keyword_score"), F.min_by("channel", F.struct("ord", (~vector).cast("int"))).alias("source"),
        in_order(F.col("query"), F.col("ord")).alias("queries"), in_order(F.col("dimension"), F.col("ord")).alias("dimensions"), F.sum(1.0 / (constant + F.col("rank"))).alias("raw"),
    )
    return normalised(by).withColumnsRenamed({"score": "fused_score", "query_id": "request"})


def provenance(candidates: DataFrame) -> DataFrame:
    """(request, parent, queries, dimensions): what led to a section, over its candidates (request, parent, node_id, queries, dimensions) by node_id."""
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("node_id", c))), lambda x: x[c])))
    return candidates.where("parent is not null").groupBy("request", "parent").agg(union("queries").alias("queries"), union("dimensions").alias("dimensions"))


def folded(scores: DataFrame, by: list[str]) -> DataFrame:
    """The best score over all of a request's embeddings."""
    return scores.groupBy("request", *by).agg(F.max("score").alias("score"))


def in_scope(nodes: DataFrame, routed: DataFrame, by: list[str]) -> DataFrame:
    """Nodes of what was routed to; the recall that follows sees nothing else."""
    return nodes.join(routed, by, "left_semi")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two term sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def reranked(candidates: DataFrame, rescore, k: int) -> DataFrame:
    """The k best of each request by another scorer: a function of (query, text) columns, such as a model's vectorised UDF."""
    scored = candidates.withColumn("rerank_score", rescore(F.col("query"), F.col("text")))
    w = W.partitionBy("request").orderBy(F.col("rerank_score").desc(), "node_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
