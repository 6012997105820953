"""Queries on candidates: hybrid recall, expansion, context scores, selection, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.text import hash_vector
from .operators import chunking, library, retrieval, selection
from .registry import BM25, DOC_TOKENS, ITEM_TOKENS, LINES, STOP, query, table, texts
from .storage import stash

_DIM = "('0x' || substr(md5(term), 31, 2))::INT % 64 AS dim, count(*)::DOUBLE AS c"
_VEC = f"""dv AS (SELECT id, {_DIM} FROM ({DOC_TOKENS}) GROUP BY ALL), qv AS (SELECT id, {_DIM} FROM ({ITEM_TOKENS}) GROUP BY ALL),
 dn AS (SELECT id, sqrt(sum(c * c)) AS n FROM dv GROUP BY ALL), qn AS (SELECT id, sqrt(sum(c * c)) AS n FROM qv GROUP BY ALL),
 sim AS (SELECT q.id AS query_id, d.id AS node_id, round(sum(q.c * d.c) / (any_value(qn.n) * any_value(dn.n)), 6) AS score FROM qv q JOIN dv d ON q.dim = d.dim JOIN qn ON qn.id = q.id JOIN dn ON dn.id = d.id GROUP BY ALL),
 vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM sim QUALIFY rank <= 12)"""
_MERGED = f"""{BM25}, {_VEC}, mg AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.node_id, b.node_id) AS node_id, coalesce(v.score, 0) AS vector_score, b.score AS keyword_score,
 CASE WHEN v.node_id IS NULL THEN 'keyword' ELSE 'vector' END AS source, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS raw FROM vec v FULL JOIN bm b ON v.query_id = b.query_id AND v.node_id = b.node_id)"""
_KIDS = f"""{_MERGED}, {LINES}, n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM lines),
 kids AS (SELECT doc_id, n, line FROM n WHERE doc_id IN (SELECT node_id FROM mg)),
 kv AS (SELECT doc_id, n, {_DIM} FROM (SELECT doc_id, n, lower(t) AS term FROM (SELECT doc_id, n, unnest(regexp_extract_all(line, '[A-Za-z0-9]+')) AS t FROM kids) WHERE length(t) >= 2 AND lower(t) NOT IN ({STOP})) GROUP BY ALL),
 kn AS (SELECT doc_id, n, sqrt(sum(c * c)) AS norm FROM kv GROUP BY ALL),
 ks AS (SELECT m.query_id, k.doc_id, k.n, round(sum(q.c * k.c) / (any_value(qn.n) * any_value(kn.norm)), 6) AS score FROM mg m JOIN kv k ON k.doc_id = m.node_id JOIN qv q ON q.id = m.query_id AND q.dim = k.dim JOIN qn ON qn.id = m.query_id JOIN kn ON kn.doc_id = k.doc_id AND kn.n = k.n GROUP BY ALL),
 ex AS (SELECT m.query_id, k.doc_id, printf('%d:section:%04d', k.doc_id, k.n) AS node_id, k.line, coalesce(ks.score, 0) AS score, row_number() OVER (PARTITION BY m.query_id, k.doc_id ORDER BY coalesce(ks.score, 0) DESC, printf('%d:section:%04d', k.doc_id, k.n)) AS rank
 FROM mg m JOIN kids k ON k.doc_id = m.node_id LEFT JOIN ks ON ks.query_id = m.query_id AND ks.doc_id = k.doc_id AND ks.n = k.n QUALIFY rank <= 8)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), hash_vector(F.col("text")).alias("qvec"))


def _vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = chunking.vectors(texts(spark, sf_dir), "doc_id", "text")
    hits = retrieval.vector_top_k(_queries(spark, sf_dir).select("query_id", "qvec"), nodes, 12)
    return hits.where("score > 0").select("query_id", "node_id", "score", "rank")


def _keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_top_k(table(spark, sf_dir, "benchmark"), texts(spark, sf_dir), "item_id", "doc_id")


@query(f"WITH {_MERGED} SELECT query_id, node_id, vector_score, keyword_score, source, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS fused_score FROM mg")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.merged(_vector_hits(spark, sf_dir), _keyword_hits(spark, sf_dir))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, parent) of the candidates. Stored: they choose what is embedded, and are joined with it."""
    return stash(candidate_merge(spark, sf_dir).select("query_id", F.col("node_id").alias("parent")), "anchors")


def _expanded(spark: SparkSession, sf_dir: str, anchors: DataFrame) -> DataFrame:
    found = texts(spark, sf_dir).join(anchors.select(F.col("parent").alias("doc_id")).distinct(), "doc_id", "left_semi")
    children = library.section_nodes(found).select(F.col("doc_id").alias("parent"), "node_id", F.col("line").alias("text"), hash_vector(F.col("line")).alias("vec"))
    return selection.expanded(anchors, children, _queries(spark, sf_dir).select("query_id", "qvec"))


@query(f"WITH {_KIDS} SELECT query_id, node_id, doc_id AS parent, score, rank FROM ex")
def tree_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, _anchors(spark, sf_dir)).select("query_id", "node_id", "parent", "score", "rank")


def _terms(text: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda t: length(t) > 1), lambda t: lower(t)))"


@query(f"""WITH {_KIDS} SELECT ex.query_id, ex.node_id, coalesce(sim.score, 0) AS paper_score,
 round(0.5 * ex.score + 0.25 * coalesce(sim.score, 0) + 0.15 * coalesce(sim.score, 0) + 0.1 * len(list_intersect({_terms("i.text")}, {_terms("ex.line")})) / len({_terms("i.text")}), 9) AS ranking
 FROM ex JOIN benchmark i ON i.item_id = ex.query_id LEFT JOIN sim ON sim.query_id = ex.query_id AND sim.node_id = ex.doc_id""")
def ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _anchors(spark, sf_dir)
    found = texts(spark, sf_dir).join(anchors.select(F.col("parent").alias("doc_id")).distinct(), "doc_id", "left_semi")
    roots = chunking.vectors(found, "doc_id", "text").select(F.col("node_id").alias("parent"), F.col("vec").alias("root_vec"))
    ranked = selection.in_context(_expanded(spark, sf_dir, anchors), _queries(spark, sf_dir).select("query_id", "query"), roots)
    return ranked.select("query_id", "node_id", "paper_score", "ranking")


@query()
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels merged, ranked and selected; a document's source is its paper, its language the dimension it answers."""
    docs = texts(spark, sf_dir)
    found = candidate_merge(spark, sf_dir).join(docs.select(F.col("doc_id").alias("node_id"), F.coalesce("source", F.lit("")).alias("paper"), "lang", "text"), "node_id").withColumn("vec", hash_vector(F.col("text")))
    recall = F.greatest("vector_score", F.coalesce("keyword_score", F.lit(0.0)))
    rows = found.select("query_id", "node_id", "paper", F.array_compact(F.array("lang")).alias("dimensions"), F.round(0.5 * F.least(F.lit(1.0), recall + 0.2 * F.col("fused_score")) + 0.4 * F.col("vector_score"), 6).alias("score"), "vec")
    request = W.partitionBy("query_id")
    wants = rows.withColumn("want_papers", F.array_sort(F.collect_set("paper").over(request))).withColumn("want_dimensions", F.array_sort(F.array_distinct(F.flatten(F.collect_list("dimensions").over(request)))))
    return selection.select(wants)


def _case(name: str, hits: str) -> str:
    return f"{name} AS (SELECT h.query_id, count(*) AS hits, max(contains(lower(d.text), lower(substr(i.text, 1, 40)))::INT) AS recall FROM {hits} h JOIN documents d ON d.doc_id = h.node_id JOIN benchmark i ON i.item_id = h.query_id GROUP BY ALL)"


@query(f"""WITH {BM25}, {_VEC}, {_case("b", "bm")}, {_case("c", "vec")} SELECT query_id, b.hits AS baseline_hits, c.hits AS current_hits, c.recall - b.recall AS recall_delta,
 CASE WHEN c.recall < b.recall THEN 'regression' WHEN c.recall > b.recall THEN 'improvement' ELSE 'same' END AS verdict FROM b JOIN c USING (query_id)""")
def eval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = table(spark, sf_dir, "benchmark"), texts(spark, sf_dir)
    return library.compared(library.anchors_found(items, _keyword_hits(spark, sf_dir), docs), library.anchors_found(items, _vector_hits(spark, sf_dir), docs))


@query("""WITH r AS (SELECT conv_id, count(DISTINCT conv_id % 3 + turn % 2)::INT AS p, count(*) FILTER (role = 'user')::INT AS q, count(DISTINCT role)::INT AS d FROM conversations GROUP BY ALL),
 s AS (SELECT *, CASE WHEN p > 1 THEN 'multi_paper' WHEN q > 1 OR d > 1 THEN 'corpus_survey' ELSE 'single_paper' END AS strategy FROM r)
 SELECT conv_id, strategy, least(24, CASE strategy WHEN 'multi_paper' THEN greatest(8, p * greatest(2, d), 2 * q) WHEN 'corpus_survey' THEN greatest(8, 16) ELSE greatest(8, 2 * q) END)::INT AS final_top_k FROM s""")
def strategy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation stands for a request: its user turns are sub-questions, its roles dimensions."""
    r = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_distinct(F.col("conv_id") % 3 + F.col("turn") % 2).cast("int").alias("p"), F.count_if(F.col("role") == "user").cast("int").alias("q"), F.count_distinct("role").cast("int").alias("d"))
    p, q, d = F.col("p"), F.col("q"), F.col("d")
    kind = selection.strategy(p, q, d)
    return r.select("conv_id", kind.alias("strategy"), selection.final_top_k(kind, p, q, d).alias("final_top_k"))
