"""Candidates of a request: merge of channels, tree expansion, context scores, reservation, diversity and final choice."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine, lexical_terms
from .retrieval import normalised, ranking_score, top_k


def merged(vector: DataFrame, keyword: DataFrame, constant: int = 60) -> DataFrame:
    """Both channels' hits as one candidate per (query_id, node_id): best scores, the first channel's name, fused score."""
    v = vector.select("query_id", "node_id", F.col("score").alias("vector_score"), F.col("rank").alias("v"))
    w = keyword.select("query_id", "node_id", F.col("score").alias("keyword_score"), F.col("rank").alias("w"))
    part = lambda rank: F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))
    source = F.when(F.col("v").isNull(), "keyword").otherwise("vector")
    both = v.join(w, ["query_id", "node_id"], "full").select("query_id", "node_id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), "keyword_score", source.alias("source"), (part("v") + part("w")).alias("raw"))
    return normalised(both).withColumnRenamed("score", "fused_score")


def expanded(anchors: DataFrame, children: DataFrame, queries: DataFrame, most: int = 8) -> DataFrame:
    """The best children of each anchor: anchors (query_id, parent), children (parent, node_id, vec, ...), queries (query_id, qvec).

    Only children of anchors are scored; the anchors are as many as the recall limits admit.
    """
    scored = children.join(anchors, "parent").join(queries, "query_id").withColumn("score", F.round(cosine(F.col("qvec"), F.col("vec")), 6))
    return top_k(scored, ["query_id", "parent"], [F.col("score").desc(), F.col("node_id")], most)


def in_context(candidates: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """Expanded candidates with the scores of their section's parent and paper and the ranking score.

    texts: (query_id, query); roots: (parent, root_vec). A fused score is 0 for what expansion found.
    """
    with_root = candidates.join(roots, "parent", "left").join(texts, "query_id")
    context = F.coalesce(F.round(cosine(F.col("qvec"), F.col("root_vec")), 6), F.lit(0.0))
    asked, held = lexical_terms(F.col("query")), lexical_terms(F.col("text"))
    lexical = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, held)) / F.size(asked)).otherwise(0.0)
    score = ranking_score(F.col("score"), F.lit(0.0), context, context, lexical)
    return with_root.withColumn("paper_score", context).withColumn("ranking", F.round(score, 9))


def strategy(targets: Column, questions: Column, dimensions: Column) -> Column:
    """More than one target paper: multi_paper; else more than one question or dimension: corpus_survey."""
    return F.when(targets > 1, "multi_paper").when((questions > 1) | (dimensions > 1), "corpus_survey").otherwise("single_paper")


@dataclass(frozen=True)
class Limits:
    """Default limits of a request."""

    final: int = 8
    max_final: int = 24
    per_paper: int = 3
    candidates: int = 40
    multi_chunks: int = 2
    survey_final: int = 16
    floor: float = 0.20
    window: float = 0.18
    diversity: float = 0.70
    rerank: int = 30


def final_top_k(kind: Column, targets: Column, questions: Column, dimensions: Column, limits: Limits = Limits()) -> Column:
    """Evidence that a request returns at most, by its strategy."""
    twice, share = 2 * questions, F.greatest(F.lit(limits.multi_chunks), dimensions)
    base = F.lit(limits.final)
    most = F.when(kind == "multi_paper", F.greatest(base, targets * share, twice)).when(kind == "corpus_survey", F.greatest(base, F.lit(limits.survey_final))).otherwise(F.greatest(base, twice))
    return F.least(most, F.lit(limits.max_final))


def _round_robin(papers: list, passes: list, rows: list[dict], admit) -> None:
    """In each pass every paper offers its best row not yet taken; a pass for a dimension offers rows that match it."""
    for dimension in passes:
        for paper in papers:
            offer = next((r for r in rows if not r.get("taken") and r["paper"] == paper and (dimension is None or dimension in r["dimensions"])), None)
            if offer is not None:
                admit(offer)


def reserve(rows: list[dict], papers: list, dimensions: list, limits: Limits) -> list[dict]:
    """Cuts rows (best first) to the candidate limit; target papers and their dimensions keep theirs, marked protected."""
    chosen: list[dict] = []

    def admit(r: dict, protect: bool = True) -> None:
        r["taken"], r["protected"] = True, protect
        chosen.append(r)

    if papers:
        _round_robin(papers, (dimensions or [None]) + [None] * max(1, limits.per_paper), rows, admit)
    for r in [r for r in rows if not r.get("taken")][: max(0, limits.candidates - len(chosen))]:
        admit(r, False)
    return sorted(({**r, "taken": False} for r in chosen), key=lambda r: -r["score"])


def likeness(rows: list[dict]) -> np.ndarray:
    """Likeness of each two rows: the cosine of their vectors, not below 0; where one has none, the Jaccard figure of their terms."""
    width = max((len(r["vec"]) for r in rows if r.get("vec") is not None), default=1)
    held = np.array([r.get("vec") is not None for r in rows])
    vecs = np.array([r["vec"] if r.get("vec") is not None else np.zeros(width) for r in rows], float)
    norms = np.linalg.norm(vecs, axis=1)
    unit = vecs / np.where(norms == 0, 1, norms)[:, None]
    alike = np.maximum(unit @ unit.T, 0)
    terms = [set(r["terms"]) if r.get("terms") is not None else set() for r in rows]
    for i, j in zip(*np.nonzero(~(held[:, None] & held[None, :])), strict=True):
        both = terms[i] | terms[j]
        alike[i, j] = len(terms[i] & terms[j]) / len(both) if both else 0.0
    return alike


def diversify(rows: list[dict], limits: Limits) -> list[dict]:
    """Maximal marginal relevance: protected rows first, then what gains most; ties take the earlier row."""
    if len(rows) < 2:
        return rows
    alike = likeness(rows)
    scores = np.array([r["score"] for r in rows])
    spread = scores.max() - scores.min()
    worth = np.ones(len(rows)) if np.isclose(spread, 0, atol=1e-12) else (scores - scores.min()) / spread
    order = [i for i, r in enumerate(rows) if r.get("protected")][: limits.rerank]
    left = [i for i in range(len(rows)) if not rows[i].get("protected")]
    near = alike[:, order].max(axis=1) if order else np.zeros(len(rows))
    while left and len(order) < limits.rerank:
        gain = limits.diversity * worth[left] - (1 - limits.diversity) * near[left]
        best = left.pop(int(np.argmax(gain)))
        order.append(best)
        near = np.maximum(near, alike[:, best])
    return [rows[i] for i in order]


def choose(rows: list[dict], papers: list, dimensions: list, limits: Limits) -> list[dict]:
    """Final evidence: cells first, then papers, then the order given, under the total and the per-paper limit."""
    chosen, count = [], {}

    def admit(r: dict) -> None:
        if len(chosen) < limits.final and count.get(r["paper"], 0) < limits.per_paper:
            r["taken"] = True
            count[r["paper"]] = count.get(r["paper"], 0) + 1
            chosen.append(r)

    _round_robin(papers, dimensions + [None] * (1 + limits.per_paper), rows, admit)
    for r in [r for r in rows if not r.get("taken")]:
        admit(r)
    return chosen


def bounded_pool(candidates: DataFrame, limits: Limits) -> DataFrame:
    """What selection can ever look at: the best of a request, of each paper and of each paper's dimension.

    The rows that go could not be chosen: reservation takes from a paper at most its first per_paper + 1 rows of each
    dimension, and fills up from the request's first rows.
    """
    best = [F.col("score").desc(), F.col("node_id")]
    deep = F.max(F.size("want_dimensions")).over(W.partitionBy("query_id"))
    spread = F.row_number().over(W.partitionBy("query_id", "paper").orderBy(*best))
    per_cell = F.row_number().over(W.partitionBy("query_id", "paper", "dimensions").orderBy(*best))
    room = limits.per_paper + 1 + F.col("deep")
    ranked = candidates.withColumn("deep", deep).withColumn("all", F.row_number().over(W.partitionBy("query_id").orderBy(*best))).withColumn("own", spread).withColumn("cell", per_cell)
    wanted = F.array_contains("want_papers", F.col("paper")) & ((F.col("own") <= room) | (F.col("cell") <= room))
    return ranked.where((F.col("all") <= limits.candidates + room) | wanted).drop("deep", "all", "own", "cell")


SELECTED = "query_id string, node_id long, paper string, score double, rank int"


def select(candidates: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Reservation, thresholds, diversity and final choice of each request.

    candidates: (query_id, node_id, paper, dimensions array, score, vec, want_papers array, want_dimensions array).
    One request's bounded pool is one group.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "node_id"], ascending=[False, True], kind="stable")
        papers, dimensions = list(pool["want_papers"].iloc[0]), list(pool["want_dimensions"].iloc[0])
        rows = [{**r, "dimensions": list(r["dimensions"])} for r in pool[["node_id", "paper", "dimensions", "score", "vec"]].to_dict("records")]
        rows = reserve(rows, papers, dimensions, limits)
        floor = max(limits.floor, rows[0]["score"] - limits.window) if len(papers) <= 1 else limits.floor
        rows = diversify([r for r in rows if r.get("protected") or r["score"] >= floor], limits)
        rows = choose(rows, papers, dimensions, limits)
        return pd.DataFrame({"query_id": pool["query_id"].iloc[0], "node_id": [r["node_id"] for r in rows], "paper": [r["paper"] for r in rows], "score": [r["score"] for r in rows], "rank": range(1, len(rows) + 1)})

    return bounded_pool(candidates.withColumn("query_id", F.col("query_id").cast("string")), limits).groupBy("query_id").applyInPandas(run, SELECTED)
