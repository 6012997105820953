"""Queries on a reader's rounds. Benchmark items are requests; the first five BM25 hits are round 1, those from the fourth on round 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .operators import evidence, library, reading, retrieval
from .registry import BM25, TERMS, query, table, texts

_ROUNDS = f"""{BM25}, h AS (SELECT query_id AS request, round, rank AS ord, node_id, source AS paper, lang AS dimension, score, text FROM bm JOIN documents ON doc_id = node_id CROSS JOIN (SELECT unnest([1, 2]) AS round)
 WHERE source IS NOT NULL AND lang IS NOT NULL AND query_id % 9 < 8 AND ((round = 1 AND rank <= 5) OR (round = 2 AND rank >= 4))),
 m AS (SELECT rr.request, rr.round, s.paper, row_number() OVER (PARTITION BY rr.request, rr.round ORDER BY s.paper) AS ord FROM (SELECT DISTINCT request, round FROM h) rr JOIN (SELECT DISTINCT request, paper FROM h) s USING (request)
 WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.request = rr.request AND h.round = rr.round AND h.paper = s.paper))"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = table(spark, sf_dir, "benchmark"), texts(spark, sf_dir)
    found = retrieval.keyword_top_k(items.where("item_id % 9 < 8"), docs, "item_id", "doc_id")
    named = docs.where("source is not null and lang is not null").select(F.col("doc_id").alias("node_id"), F.col("source").alias("paper"), F.col("lang").alias("dimension"), "text")
    rounds = found.withColumn("round", F.explode(F.array(F.lit(1), F.lit(2)))).where("round = 1 and rank <= 5 or round = 2 and rank >= 4")
    return rounds.join(named, "node_id").select(F.col("query_id").alias("request"), "round", F.col("rank").alias("ord"), "node_id", "paper", "dimension", "score", "text")


def _reports(hits: DataFrame) -> DataFrame:
    """Per round: its strategy, and the papers of other rounds that it did not return."""
    papers = lambda *by: hits.groupBy(*by).agg(F.array_sort(F.collect_set("paper")).alias("of_" + by[-1]))
    strategy = F.when(F.col("round") == 1, "single_paper").when(F.col("request") % 3 > 0, "multi_paper")
    return papers("request", "round").join(papers("request"), "request").select("request", "round", strategy.alias("strategy"), F.array_except("of_request", "of_round").alias("missing"))


@query(f"""WITH {_ROUNDS}, f AS (SELECT request, node_id::VARCHAR AS chunk_id, any_value(paper) AS paper, any_value(text) AS text, any_value(score) AS score FROM h GROUP BY request, node_id),
 x AS (SELECT item_id AS request, url AS paper, html AS text FROM benchmark JOIN pages ON page_id = item_id WHERE item_id % 2 = 0 AND item_id NOT IN (SELECT request FROM h)),
 e AS (SELECT * FROM f UNION ALL SELECT request, paper || ':pdf-extraction', paper, text, 1.0 FROM x
 UNION ALL SELECT item_id, 'item:metadata', 'item', text, 1.0 FROM benchmark WHERE item_id NOT IN (SELECT request FROM h) AND item_id NOT IN (SELECT request FROM x))
 SELECT request, 'E-' || substr(sha256(chunk_id), 1, 12) AS evidence_id, paper, chunk_id, sha256(text) AS text_sha256, score::DOUBLE AS score FROM e""")
def evidence_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand for extracted texts, items for metadata."""
    items, pages = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "pages")
    extracts = items.where("item_id % 2 = 0").join(pages, F.col("item_id") == F.col("page_id")).select(F.col("item_id").alias("request"), F.col("url").alias("paper"), F.col("html").alias("text"))
    metadata = items.select(F.col("item_id").alias("request"), F.lit("item").alias("paper"), "text")
    return reading.evidence_library(_hits(spark, sf_dir), extracts, metadata).select("request", "evidence_id", "paper", "chunk_id", F.sha2("text", 256).alias("text_sha256"), "score")


@query(f"""WITH {_ROUNDS}, u AS (SELECT request, count(DISTINCT node_id) AS unique_hits, max(round) AS last FROM h GROUP BY ALL),
 mm AS (SELECT request, string_agg(paper, ',' ORDER BY round, paper) AS missing FROM (SELECT request, paper, min(round) AS round FROM m GROUP BY ALL) GROUP BY request)
 SELECT request, unique_hits, coalesce(missing, '') AS missing, CASE WHEN last = 2 AND request % 3 > 0 THEN 'multi_paper' WHEN EXISTS (SELECT 1 FROM h WHERE h.request = u.request AND round = 1) THEN 'single_paper' END AS latest_strategy FROM u LEFT JOIN mm USING (request)""")
def rounds_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return reading.rounds_summary(_reports(hits), hits).withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH {_ROUNDS}, c AS (SELECT request, round, paper, dimension, min(ord) AS ord FROM h GROUP BY ALL),
 pp AS (SELECT request, paper, min(k) AS k FROM (SELECT request, paper, round * 1000 + ord AS k FROM c UNION ALL SELECT request, paper, round * 1000 + 500 + ord FROM m) GROUP BY ALL),
 dd AS (SELECT request, dimension, min(round * 1000 + ord) AS k FROM c WHERE request % 4 > 0 GROUP BY ALL UNION ALL SELECT DISTINCT request, p.d, p.k FROM h, (VALUES ('fr', 1), ('en', 2)) p(d, k) WHERE request % 4 = 0),
 ev AS (SELECT request, paper, dimension, string_agg('E-' || substr(sha256(node_id::VARCHAR), 1, 12), ',' ORDER BY k) AS evidence FROM (SELECT request, paper, dimension, node_id, min(round * 1000 + ord) AS k FROM h GROUP BY ALL) GROUP BY ALL)
 SELECT pp.request, pp.paper, dd.dimension, row_number() OVER (PARTITION BY pp.request, dd.dimension ORDER BY pp.k)::INT AS paper_pos, row_number() OVER (PARTITION BY pp.request, pp.paper ORDER BY dd.k)::INT AS dimension_pos,
 CASE WHEN evidence IS NULL THEN 'empty' ELSE 'candidate' END AS status, coalesce(evidence, '') AS evidence FROM pp JOIN dd ON dd.request = pp.request LEFT JOIN ev ON ev.request = pp.request AND ev.paper = pp.paper AND ev.dimension = dd.dimension""")
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are papers, languages dimensions; every fourth request plans two of its own."""
    hits = _hits(spark, sf_dir)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id"))), lambda x: evidence.evidence_id(x["node_id"].cast("string")))
    cells = hits.groupBy("request", "round", "paper", "dimension").agg(F.min("ord").alias("ord"), ids.alias("evidence"))
    missing = _reports(hits).select("request", "round", F.posexplode("missing").alias("pos", "paper")).select("request", "round", F.col("pos").cast("long").alias("ord"), "paper")
    planned = hits.select("request").distinct().where("request % 4 = 0").select("request", F.posexplode(F.array(F.lit("fr"), F.lit("en"))).alias("ord", "dimension"))
    return reading.merged_coverage(cells, missing, planned).withColumn("evidence", F.array_join("evidence", ","))


@query("""WITH c AS (SELECT conv_id AS answer_id, turn AS ord, 'E-' || substr(sha256(conv_id || '|' || turn), 1, 12) AS evidence_id, role = 'user' AS known, turn % 3 AS v FROM conversations),
 r AS (SELECT *, known AND sum(known::INT) OVER (PARTITION BY answer_id ORDER BY ord) <= 2 AS checked FROM c)
 SELECT answer_id, ord, evidence_id, known, checked, checked AND v = 0 AS supported, CASE WHEN NOT known THEN 'unknown_evidence_id' WHEN checked AND v <> 0 THEN 'unsupported_claim' END AS issue FROM r""")
def citation_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation cites all its messages and holds those of its user; two are checked, every third message has no verdict."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("ord"), evidence.evidence_id(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("evidence_id"), (F.col("role") == "user").alias("known"))
    verdicts = said.where("ord % 3 < 2").select("answer_id", "evidence_id", (F.col("ord") % 3 == 0).alias("supported"))
    return reading.verified_citations(said, verdicts, 2)


@query("""WITH r AS (SELECT conv_id AS report_id, turn AS ord, 'E-' || substr(sha256(conv_id || '|' || turn), 1, 12) AS evidence_id, role = 'user' OR conv_id % 5 = 0 AS known FROM conversations),
 g AS (SELECT report_id, coalesce(string_agg(evidence_id, ',' ORDER BY ord) FILTER (known), '') AS kept, count(*) FILTER (NOT known) AS removed, CASE WHEN report_id % 2 = 0 THEN list_transform(range(0, report_id % 10), lambda i: 'limit ' || i) ELSE [] END AS l FROM r GROUP BY report_id)
 SELECT report_id, kept, removed, array_to_string(CASE WHEN removed > 0 THEN list_append(l, 'Removed ' || removed || ' evidence reference(s) not present in the library')[1:8] ELSE l END, ',') AS limitations FROM g""")
def report_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, c = table(spark, sf_dir, "conversations"), F.col("conv_id")
    marked = said.select(c.alias("report_id"), F.col("turn").alias("ord"), evidence.evidence_id(c.cast("string"), F.col("turn").cast("string")).alias("evidence_id"), "role")
    held = marked.where("role = 'user' or report_id % 5 = 0").select("evidence_id")
    some = F.when(c % 10 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(c % 10 - 1, F.lit(0))), lambda i: F.concat(F.lit("limit "), i.cast("string"))))
    limits = said.where(c % 2 == 0).select(c.alias("report_id"), some.alias("limitations")).distinct()
    return reading.valid_references(marked.drop("role"), held, limits).withColumns({"kept": F.array_join("kept", ","), "limitations": F.array_join("limitations", ",")})


@query(f"SELECT query_id, count(DISTINCT doc_id) AS pool FROM ({TERMS}) JOIN documents ON contains(text, term) GROUP BY ALL")
def substring_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text").drop("ord")
    return retrieval.substring_pool(terms, texts(spark, sf_dir), "doc_id", "text").groupBy("query_id").agg(F.count(F.lit(1)).alias("pool"))


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(\w)-(\w)', '\1 \2', 'g'), '(\w)-(\w)', '\1 \2', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM benchmark")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", values.search_text(F.col("text")).alias("text"))


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/]*)', 1)) AS paper, regexp_extract(url, '([^/]*)$', 1) AS file FROM pages)
 SELECT page_id, CASE WHEN regexp_full_match(paper, '[a-z0-9][a-z0-9._-]{0,127}') AND regexp_full_match(file, '[A-Za-z0-9._-]{1,255}') AND file NOT IN ('.', '..') THEN 'assets/' || paper || '/' || file END AS path FROM p""")
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's host stands for the paper, the last part of its url for the file."""
    paper, file = F.lower(F.regexp_extract("url", "://([^/]*)", 1)), F.regexp_extract("url", "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", values.asset_path(F.lit("assets"), paper, file).alias("path"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(coalesce(source, '') || ' ' || coalesce(substr(text, 1, 240), '')), 'ma')")
def matching_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a list shows them: of one kind, with a text in their title or preview."""
    docs = texts(spark, sf_dir)
    return library.matching(docs, F.col("lang"), "en", [F.col("source"), F.substring("text", 1, 240)], "MA").select("doc_id")


@query("""SELECT source, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT source, doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '-\\s*\n\\s*', '', 'g'), '\\s+', ' ', 'g'), ' ') AS k FROM documents) GROUP BY source, k""")
def dedup_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by their compatibility forms and full case folding; the test data holds no characters in which this differs from lower case but ß."""
    return library.distinct_texts(texts(spark, sf_dir), values.folded_text)
