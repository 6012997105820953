"""Recall channels, fusion and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import each, keyword_terms, keyword_tokens
from ..storage import stash
from . import pools
from .vectors import block_hits

K1, B = 1.2, 0.75
RRF_CONSTANT = 60


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; the window becomes a group limit before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def query_terms(queries: DataFrame, key: str, text: str, most: int = 12) -> DataFrame:
    return each(queries, [F.col(key).alias("query_id")], keyword_terms(F.col(text), most), "ord", "term")


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(node_id, dl, term, tf): one row per distinct token of a node that is a query's term; dl counts all its tokens."""
    tokens = docs.select(F.col(key).alias("node_id"), keyword_tokens(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens"))
    exploded = each(tokens, ["node_id", "dl"], F.col("tokens"), "ord", "term").drop("ord")
    asked = exploded.join(terms.select("term").distinct(), "term", "left_semi")
    return asked.groupBy("node_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).where("tf > 0")


def pool_sizes(hits: DataFrame) -> DataFrame:
    """(query_id, n, avgdl) of each query's pool, the nodes that hold one of its terms."""
    return hits.select("query_id", "node_id", "dl").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def substring_pool(terms: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, node_id) of the nodes whose raw text holds one of a query's terms, case and all, also inside words.

    All terms are looked for in a text at once, where it lies; a node goes on with its queries in one row.
    """
    found = [pools.members(docs, key, text, asked, terms.schema["query_id"].dataType) for asked in pools.asked_blocks(terms)]
    return reduce(DataFrame.unionByName, found) if found else terms.select("query_id").limit(0).crossJoin(docs.select(F.col(key).alias("node_id")).limit(0))


#: Query terms up to which their weights are sent to all postings; more are joined by shuffle.
SENT_TERMS = 200_000


def bm25(terms: DataFrame, posts: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, node_id, score, matched): BM25 over each query's pool, the nodes that hold one of its terms.

    posts are read several times and should be stored. They are dealt by node once; a few query terms' weights go to them, so a node's hits
    are counted and summed where its postings lie. Every node with a term is in its query's pool, so frequencies are the postings' own.
    """
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = terms.select("query_id", "term").join(df, "term")
    sent = F.broadcast if terms.count() <= SENT_TERMS else (lambda small: small)
    hits = posts.repartition("node_id").join(sent(asked), "term").select("query_id", "node_id", "dl", "tf", "df")
    scored = hits.join(sent(pool_sizes(hits)), "query_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", "node_id").agg(F.sum(part).alias("raw"), F.count(F.lit(1)).alias("matched"))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores over the query's best."""
    best = scores.groupBy("query_id").agg(F.max("raw").alias("best"))
    return scores.join(best, "query_id").withColumn("score", F.round(F.col("raw") / F.col("best"), 6)).drop("raw", "best")


def keyword_top_k(queries: DataFrame, docs: DataFrame, qkey: str, dkey: str, k: int = 10) -> DataFrame:
    terms = query_terms(queries, qkey, "text")
    posts = stash(postings(docs, dkey, "text", terms), "postings")  # read for frequencies, pools and scores; texts are tokenised once
    scores = normalised(bm25(terms, posts))
    return top_k(scores, ["query_id"], [F.col("score").desc(), F.col("node_id")], k).select("query_id", "node_id", "score", "matched", "rank")


def pooled_top_k(queries: DataFrame, docs: DataFrame, qkey: str, dkey: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, node_id, score, matched_terms, rank): BM25 over the nodes whose raw text holds a term of the query, case and all, also inside words.

    Lengths, their mean and frequencies are the pool's: a node that holds a term only inside a word counts in all of them and has no hit
    of it. matched_terms are in the query's order.
    """
    terms = query_terms(queries, qkey, "text")
    out = None
    for asked in pools.asked_blocks(terms):
        facts = stash(pools.facts(docs, dkey, "text", asked), "facts")  # read for sizes, scores and matched terms
        scores = normalised(stash(pools.best(facts, asked, terms.schema["query_id"].dataType, k, k1, b), "scores"))
        first = stash(top_k(scores, ["query_id"], [F.col("score").desc(), F.col("node_id")], k), "first")
        held = facts.join(F.broadcast(first.select("node_id").distinct()), "node_id", "left_semi").select("node_id", F.explode("terms").alias("at"))  # k nodes of a block's queries at most
        named = docs.sparkSession.createDataFrame(list(enumerate(asked.terms)), "at int, term string")
        said = first.join(held, "node_id").join(F.broadcast(named), "at").join(terms, ["query_id", "term"]).groupBy("query_id", "node_id").agg(F.collect_set(F.struct("ord", "term")).alias("said"))
        part = first.join(said, ["query_id", "node_id"]).select("query_id", "node_id", "score", F.transform(F.array_sort("said"), lambda x: x["term"]).alias("matched_terms"), "rank")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return terms.limit(0).crossJoin(docs.limit(0)).select("query_id", F.col(dkey).alias("node_id"), F.lit(0.0).alias("score"), F.array("term").alias("matched_terms"), F.lit(0).cast("long").alias("rank"))
    return out


def vector_top_k(queries: DataFrame, nodes: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Exact cosine top-k of each (query_id, qvec) over nodes (node_id, vec, ...), per group of `by`: query_id, node_id, by, score, rank."""
    by = by or []
    return top_k(block_hits(queries, nodes, k, by), ["query_id", *by], [F.col("score").desc(), F.col("node_id")], k)


def rrf(channels: DataFrame, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, channel, node_id, rank), over the request's best."""
    fused = channels.groupBy("query_id", "node_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("raw"), F.count(F.lit(1)).alias("channels"))
    return normalised(fused)


def ranking_score(recall: Column, fused: Column, section: Column, paper: Column, lexical: Column, weight: float = 0.20) -> Column:
    return 0.50 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), recall + weight * fused)) + 0.25 * section + 0.15 * paper + 0.10 * lexical


def within_window(scores: DataFrame, floor: float = 0.20, window: float = 0.18) -> DataFrame:
    """Rows at or above the floor and within a window below their query's best. A query has the few rows of a top-k."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return scores.withColumn("best", best).where(F.col("score") >= F.greatest(F.lit(floor), F.col("best") - window)).drop("best")
