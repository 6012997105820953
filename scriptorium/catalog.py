"""All registered queries of the library proper, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_agents, catalog_documents, catalog_evaluation, catalog_hierarchy, catalog_layout, catalog_metadata, catalog_planning, catalog_reading, catalog_retrieval, catalog_structure  # noqa: F401  (they register their queries)
from .functions.text import keyword_terms, keyword_tokens, lexical_terms, preview, short_hash, slug
from .operators import library, retrieval, runs
from .registry import BM25, DOC_TOKENS, KNN, LINES, LOG, ORACLE_SQL, QUERIES, TERMS, embedded, query, table, texts


@query(f"WITH {BM25} SELECT query_id, node_id, score, matched, rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_top_k(table(spark, sf_dir, "benchmark"), texts(spark, sf_dir), "item_id", "doc_id")


flagship = bm25_topk


@query(f"WITH {BM25} SELECT query_id, n AS pool, round(avgdl, 6) AS avgdl FROM pool")
def keyword_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    hits = terms.join(retrieval.postings(texts(spark, sf_dir), "doc_id", "text", terms), "term")
    return retrieval.pool_sizes(hits).select("query_id", F.col("n").alias("pool"), F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT id AS doc_id, count(*) AS tokens, count(DISTINCT term) AS terms FROM ({DOC_TOKENS}) GROUP BY ALL")
def keyword_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = texts(spark, sf_dir).select("doc_id", keyword_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return tokens.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


@query(f"SELECT query_id, string_agg(term, ' ' ORDER BY term) AS terms FROM ({TERMS}) GROUP BY ALL")
def keyword_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.array_sort(keyword_terms(F.col("text"))), " ").alias("terms"))


@query("SELECT doc_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: length(t) > 1), lambda t: lower(t))))::INT AS terms FROM documents")
def lexical_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.size(lexical_terms(F.col("text"))).alias("terms"))


@query("""SELECT doc_id, CASE WHEN length(text) > 240 THEN rtrim(substr(text, 1, 240), ' ') || '…' ELSE text END AS preview,
 coalesce(nullif(rtrim(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-'), ''), 'paper') AS slug, substr(sha256(doc_id::VARCHAR || '|' || text), 1, 12) AS id FROM documents""")
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", preview(F.col("text")).alias("preview"), slug(F.col("text")).alias("slug"), short_hash(F.col("doc_id").cast("string"), F.col("text")).alias("id"))


@query(f"WITH {KNN} SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 12")
def knn_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, queries = embedded(spark, sf_dir)
    return retrieval.vector_top_k(queries, nodes, 12).select("query_id", "node_id", "score", "rank")


@query(f"WITH {KNN} SELECT query_id, label, node_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 3")
def knn_per_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, queries = embedded(spark, sf_dir)
    return retrieval.vector_top_k(queries, nodes, 3, ["label"]).select("query_id", "label", "node_id", "score", "rank")


@query(f"WITH {KNN} SELECT query_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM (SELECT query_id, label, max(score) AS score FROM s GROUP BY ALL) QUALIFY rank <= 5")
def route_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, queries = embedded(spark, sf_dir)
    best = retrieval.vector_top_k(queries, nodes, 1, ["label"]).select("query_id", "label", "score")
    return retrieval.top_k(best, ["query_id"], [F.col("score").desc(), F.col("label")], 5)


@query(f"""WITH {KNN}, g AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 12),
 p AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 3),
 f AS (SELECT query_id, node_id, sum(1.0::DOUBLE / (60 + rank)) AS raw, count(*) AS channels FROM (SELECT * FROM g UNION ALL SELECT * FROM p) GROUP BY ALL)
 SELECT query_id, node_id, channels, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM f""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = knn_global(spark, sf_dir).select("query_id", "node_id", "rank").unionByName(knn_per_paper(spark, sf_dir).select("query_id", "node_id", "rank"))
    return retrieval.rrf(both)


@query(f"WITH {BM25}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM bm) SELECT query_id, node_id, score, matched, rank FROM b WHERE score >= greatest(0.2, best - 0.18)")
def threshold_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.within_window(bm25_topk(spark, sf_dir))


@query(f"WITH {BM25} SELECT query_id, count(*) AS hits, count(*) FILTER (contains(lower(d.text), lower(substr(i.text, 1, 40)))) AS with_anchor FROM bm JOIN documents d ON d.doc_id = node_id JOIN benchmark i ON i.item_id = query_id GROUP BY ALL")
def eval_anchor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.anchors_found(table(spark, sf_dir, "benchmark"), bm25_topk(spark, sf_dir), texts(spark, sf_dir))


@query(f"""WITH {BM25}, a AS (SELECT query_id, count(*) AS hits, count(*) FILTER (contains(lower(d.text), lower(substr(i.text, 1, 40)))) AS w FROM bm JOIN documents d ON d.doc_id = node_id JOIN benchmark i ON i.item_id = query_id GROUP BY ALL)
 SELECT count(*) AS cases, round(avg((w > 0)::INT), 6) AS evidence_recall, round(avg(w / hits), 6) AS evidence_precision FROM a""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = eval_anchor_hits(spark, sf_dir)
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("with_anchor") > 0).cast("int")), 6).alias("evidence_recall"), F.round(F.avg(F.col("with_anchor") / F.col("hits")), 6).alias("evidence_precision"))


@query(f"WITH {LINES}, p AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL) SELECT source, line, count(DISTINCT doc_id) AS on_pages FROM lines JOIN p USING (source) WHERE length(line) BETWEEN 3 AND 120 GROUP BY source, line, pages HAVING count(DISTINCT doc_id) >= greatest(2, ceil(0.6 * pages))")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.repeated_lines(texts(spark, sf_dir))


@query(f"WITH {LINES}, p AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL) SELECT source, line, count(DISTINCT doc_id) AS on_pages FROM lines JOIN p USING (source) WHERE length(line) BETWEEN 3 AND 120 GROUP BY source, line, pages HAVING count(DISTINCT doc_id) >= greatest(2, ceil(0.02 * pages))")
def frequent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines with a share that the sources' boilerplate reaches."""
    return library.repeated_lines(texts(spark, sf_dir), 0.02)


@query("""SELECT source, doc_id, least(length(text), 60000 - before)::BIGINT AS taken, length(text) > 60000 - before AS cut FROM (
 SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 60000""")
def page_text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.page_text(texts(spark, sf_dir), 60_000)


@query(f"""WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM lines)
 SELECT printf('%d:section:%04d', doc_id, n) AS node_id, printf('%d:root', doc_id) AS parent_id, 1 AS level, substr(sha256(line), 1, 16) AS content_hash FROM n""")
def tree_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.sections(texts(spark, sf_dir))


@query(f"""WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM lines), s AS (SELECT printf('%d:section:%04d', doc_id, n) AS node_id, printf('%d:root', doc_id) AS parent_id FROM n)
 SELECT parent_id AS node_id, count(*) AS children, min(node_id) AS first_child, max(node_id) AS last_child FROM s GROUP BY parent_id""")
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.tree(texts(spark, sf_dir))


@query("""SELECT source, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT source, doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '-\\s*\n\\s*', '', 'g'), '\\s+', ' ', 'g'), ' ') AS k FROM documents) GROUP BY source, k""")
def dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.distinct_texts(texts(spark, sf_dir))


@query("SELECT source, count(*) AS indexed, count(*) FILTER (quality = 0) AS needing_rebuild, count(*) FILTER (quality IS NULL) AS without_fingerprint FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def library_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.health(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_CELLS = """cells AS (SELECT source, lang, CASE WHEN best = 1 THEN 'covered' WHEN best = 0 THEN 'missing' WHEN candidates > 0 THEN 'candidate' ELSE 'empty' END AS status, coalesce(candidates, 0) AS candidates
 FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT DISTINCT lang FROM documents) LEFT JOIN (SELECT source, lang, max(quality) AS best, count(*) AS candidates FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL) USING (source, lang))"""


@query(f"WITH {_CELLS} SELECT * FROM cells")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(f"WITH {_CELLS} SELECT source, count(*) AS cells, count(*) FILTER (status = 'covered') AS covered, round(count(*) FILTER (status = 'covered') / count(*), 6) AS coverage_ratio, round(count(*) FILTER (status <> 'empty') / count(*), 6) AS candidate_ratio FROM cells GROUP BY ALL")
def coverage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.coverage_ratios(coverage_matrix(spark, sf_dir))


@query("SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.html_headings(table(spark, sf_dir, "pages"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.event_log(table(spark, sf_dir, "events"))


@query(f"WITH {LOG} SELECT run_id, sequence::INT AS sequence, event_type, event_id, ts, duration_ms FROM log QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) <= 3")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest(_log(spark, sf_dir))


@query(f"WITH {LOG}, l AS (SELECT *, greatest(max(sequence) OVER (PARTITION BY run_id) - 40, 0) AS dropped FROM log) SELECT run_id, sequence::INT AS sequence, event_type, 10 < dropped AS gap FROM l WHERE sequence > 10 AND sequence > dropped")
def replay_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.replay(_log(spark, sf_dir), 10, 40)


@query(f"WITH {LOG} SELECT run_id, max(sequence)::INT AS last_sequence, arg_max(event_type, sequence) AS last_event, arg_max(event_type, sequence) FILTER (event_type IN ('run.completed', 'run.failed')) AS last_terminal, count(*) FILTER (event_type = 'tool.completed') AS tool_calls FROM log GROUP BY ALL")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.state(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT run_id % 20 AS conversation_id, count(*) FILTER (event_type IN ('run.completed', 'run.failed')) AS run_count, coalesce(sum(duration_ms) FILTER (event_type IN ('run.completed', 'run.failed')), 0)::BIGINT AS duration_ms, count(*) FILTER (event_type = 'tool.completed') AS tool_calls FROM log GROUP BY ALL")
def conversation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.metrics(_log(spark, sf_dir), 20)


@query(f"WITH {LOG} SELECT event_type, round(avg(duration_ms), 6) AS mean_ms, round(quantile_cont(duration_ms, 0.5), 6)::DOUBLE AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6)::DOUBLE AS p95_ms FROM log GROUP BY ALL")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.percentiles(_log(spark, sf_dir))


@query("""WITH s AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12)
 SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns, count(*) AS n FROM s GROUP BY ALL""")
def context_last12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.context(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, turn, question_turn FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question_turn FROM conversations) WHERE role = 'assistant'""")
def question_of_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.questions_of_answers(table(spark, sf_dir, "conversations"))


@query(f"WITH {LOG} SELECT run_id, sequence, CASE event_type WHEN 'run.started' THEN 'signup' WHEN 'stage.started' THEN 'view' WHEN 'tool.completed' THEN 'click' WHEN 'run.completed' THEN 'purchase' ELSE 'error' END AS event_type, event_id FROM log")
def stream_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.events import run_available

    return run_available(spark, f"{sf_dir}/events.parquet", "sequence")
