"""Queries on evaluation runs. Benchmark items are cases; documents of their number are what is expected, others what two runs return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation
from .registry import query, table

#: Documents that the baseline and the current run return.
RUNS = {"baseline": "doc_id % 3 <> 0", "current": "doc_id % 4 <> 0"}


def _run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    i, d = F.col("item_id"), F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    items = table(spark, sf_dir, "benchmark").select("item_id")
    known = items.join(docs.withColumn("k", d % 400), i == F.col("k"))
    case = i.alias("case_id")
    expected = known.select(case, F.col("source").alias("paper")).distinct()
    dimensions = known.where("lang is not null").select(case, F.col("lang").alias("dimension")).distinct()
    anchors = known.select(case, d.alias("anchor_id"), F.col("source").alias("paper"), F.when(d % 3 > 0, F.col("lang")).alias("dimension"), F.substring("text", 3, 25).alias("anchor"))
    found = items.where(i % 9 < 8).withColumn("m", i % 200).join(docs.where(RUNS[name]).withColumn("m", d % 200), "m")
    hits = found.select(case, d.alias("node_id"), F.col("source").alias("paper"), "text", "lang")
    cells = hits.where("lang is not null").select("case_id", "paper", F.col("lang").alias("dimension"))
    names = F.array(*map(F.lit, ("single_paper", "multi_paper", "corpus_survey")))
    counted = hits.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    cases = items.select(case, (i % 5 != 0).alias("expects_answer"), F.when(i % 4 > 0, F.element_at(names, (i % 4).cast("int"))).alias("expected_strategy"), F.element_at(names, (i % 3 + 1).cast("int")).alias("strategy"))
    cases = cases.join(counted, "case_id", "left").withColumn("latency_ms", (F.col("case_id") * 7 % 100 + F.coalesce("n", F.lit(0))).cast("double")).drop("n")
    return evaluation.case_results(cases, expected, dimensions, anchors, hits.drop("lang"), cells)


def _sql(name: str) -> str:
    p = name[0]
    return f"""{p}_d AS (SELECT * FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), {p}_k AS (SELECT item_id AS case_id, d.* FROM benchmark JOIN {p}_d d ON d.doc_id % 400 = item_id),
 {p}_h AS (SELECT item_id AS case_id, doc_id AS node_id, source AS paper, d.text, lang FROM benchmark JOIN {p}_d d ON d.doc_id % 200 = item_id % 200 WHERE item_id % 9 < 8 AND {RUNS[name]}),
 {p}_e AS (SELECT DISTINCT case_id, source AS paper FROM {p}_k), {p}_a AS (SELECT case_id, doc_id AS anchor_id, source AS paper, CASE WHEN doc_id % 3 > 0 THEN lang END AS dimension, substr(text, 3, 25) AS anchor FROM {p}_k),
 {p}_f AS (SELECT a.case_id, anchor_id, node_id FROM {p}_a a JOIN {p}_h h ON h.case_id = a.case_id AND h.paper = a.paper AND contains(lower(h.text), lower(a.anchor))),
 {p}_r AS (SELECT i.item_id AS case_id, i.item_id % 5 <> 0 AS expects_answer, (['single_paper', 'multi_paper', 'corpus_survey'])[i.item_id % 3 + 1] AS strategy, CASE i.item_id % 4 WHEN 1 THEN 'single_paper' WHEN 2 THEN 'multi_paper' WHEN 3 THEN 'corpus_survey' END AS expected_strategy,
 (SELECT count(*) FROM {p}_h h WHERE h.case_id = i.item_id) AS hit_count, (SELECT count(*) FROM {p}_e e WHERE e.case_id = i.item_id) AS ne, (SELECT count(*) FROM {p}_e e WHERE e.case_id = i.item_id AND EXISTS (SELECT 1 FROM {p}_h h WHERE h.case_id = e.case_id AND h.paper = e.paper)) AS nr,
 (SELECT count(*) FROM {p}_a a WHERE a.case_id = i.item_id) AS na, (SELECT count(DISTINCT anchor_id) FROM {p}_f f WHERE f.case_id = i.item_id) AS nm, (SELECT count(DISTINCT node_id) FROM {p}_f f WHERE f.case_id = i.item_id) AS nright,
 (SELECT count(*) FROM {p}_h h WHERE h.case_id = i.item_id AND EXISTS (SELECT 1 FROM {p}_e e WHERE h.case_id = e.case_id AND h.paper = e.paper)) AS nsource,
 (SELECT count(DISTINCT (paper, dimension)) FROM {p}_a a WHERE a.case_id = i.item_id AND dimension IS NOT NULL) AS nc, (SELECT count(DISTINCT (paper, dimension)) FROM {p}_a a JOIN {p}_f f ON f.case_id = a.case_id AND f.anchor_id = a.anchor_id WHERE a.case_id = i.item_id AND dimension IS NOT NULL) AS ns,
 (SELECT count(*) FROM {p}_e e, (SELECT DISTINCT case_id, lang FROM {p}_k WHERE lang IS NOT NULL) m WHERE e.case_id = i.item_id AND m.case_id = i.item_id) AS nw,
 (SELECT count(*) FROM {p}_e e, (SELECT DISTINCT case_id, lang FROM {p}_k WHERE lang IS NOT NULL) m WHERE e.case_id = i.item_id AND m.case_id = i.item_id AND EXISTS (SELECT 1 FROM {p}_h h WHERE h.case_id = i.item_id AND h.paper = e.paper AND h.lang = m.lang)) AS nheld,
 (SELECT coalesce(list_sort(list(paper)), []) FROM {p}_e e WHERE e.case_id = i.item_id AND NOT EXISTS (SELECT 1 FROM {p}_h h WHERE h.case_id = e.case_id AND h.paper = e.paper)) AS missing,
 (SELECT coalesce(list_sort(list(paper || ':' || anchor)), []) FROM {p}_a a WHERE a.case_id = i.item_id AND NOT EXISTS (SELECT 1 FROM {p}_f f WHERE f.case_id = a.case_id AND f.anchor_id = a.anchor_id)) AS unmatched FROM benchmark i),
 {p}_c AS (SELECT case_id, expects_answer, strategy, hit_count, (case_id * 7 % 100 + hit_count)::DOUBLE AS latency_ms, nr / nullif(ne, 0) AS target_paper_recall, nm / nullif(na, 0) AS evidence_recall, CASE WHEN na > 0 THEN CASE WHEN hit_count = 0 THEN 0 ELSE nright / hit_count END END AS evidence_precision,
 CASE WHEN ne > 0 THEN CASE WHEN hit_count = 0 THEN 0 ELSE nsource / hit_count END END AS paper_source_accuracy, nheld / nullif(nw, 0) AS candidate_dimension_coverage, ns / nullif(nc, 0) AS dimension_support_rate, strategy = expected_strategy AS strategy_matched,
 CASE WHEN NOT expects_answer THEN hit_count > 0 END AS false_recall, CASE WHEN NOT expects_answer THEN EXISTS (SELECT 1 FROM {p}_h h WHERE h.case_id = {p}_r.case_id AND h.lang IS NOT NULL) END AS false_candidate, missing, unmatched FROM {p}_r),
 {p}_s AS (SELECT count(*) AS case_count, count(*) FILTER (expects_answer) AS answerable_case_count, count(*) FILTER (NOT expects_answer) AS unanswerable_case_count, avg(target_paper_recall) FILTER (expects_answer) AS target_paper_recall, avg(evidence_recall) FILTER (expects_answer) AS evidence_recall, avg(evidence_precision) FILTER (expects_answer) AS evidence_precision,
 avg(paper_source_accuracy) FILTER (expects_answer) AS paper_source_accuracy, avg(candidate_dimension_coverage) FILTER (expects_answer) AS candidate_dimension_coverage, avg(dimension_support_rate) FILTER (expects_answer) AS dimension_support_rate, avg(strategy_matched::INT) AS strategy_accuracy,
 avg(false_recall::INT) FILTER (NOT expects_answer) AS false_recall_rate, avg(false_candidate::INT) FILTER (NOT expects_answer) AS false_candidate_rate, avg(latency_ms) AS mean_latency_ms, quantile_cont(latency_ms, 0.5) AS latency_p50_ms, quantile_cont(latency_ms, 0.95) AS latency_p95_ms FROM {p}_c)"""


_RATES = evaluation.METRICS[:6]


@query(f"WITH {_sql('baseline')} SELECT case_id, expects_answer, strategy, hit_count, latency_ms, {', '.join(f'round({c}, 9) AS {c}' for c in _RATES)}, strategy_matched, false_recall, false_candidate, array_to_string(missing, ',') AS missing_paper_ids, sha256(array_to_string(unmatched, ',')) AS unmatched_sha256 FROM b_c")
def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, sf_dir, "baseline")
    return found.select("case_id", "expects_answer", "strategy", "hit_count", "latency_ms", *[F.round(c, 9).alias(c) for c in _RATES], "strategy_matched", "false_recall", "false_candidate", F.array_join("missing_paper_ids", ",").alias("missing_paper_ids"), F.sha2(F.array_join("unmatched_anchors", ","), 256).alias("unmatched_sha256"))


@query(f"WITH {_sql('baseline')} SELECT case_count, answerable_case_count, unanswerable_case_count, {', '.join(f'round({c}, 9) AS {c}' for c in evaluation.METRICS)} FROM b_s")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.summary(_run(spark, sf_dir, "baseline"))
    return found.select("case_count", "answerable_case_count", "unanswerable_case_count", *[F.round(c, 9).alias(c) for c in evaluation.METRICS])


@query(f"WITH {_sql('baseline')} SELECT case_id, unnest(missing) AS paper FROM b_c")
def missing_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "baseline").select("case_id", F.explode("missing_paper_ids").alias("paper"))


@query(f"WITH {_sql('baseline')}, {_sql('current')}, u AS (SELECT unnest([{', '.join(repr(m) for m in evaluation.METRICS)}]) AS metric, unnest([{', '.join('b_s.' + m for m in evaluation.METRICS)}]) AS b, unnest([{', '.join('c_s.' + m for m in evaluation.METRICS)}]) AS c FROM b_s, c_s) SELECT metric, round(b, 9) AS baseline, round(c, 9) AS current, round(c - b, 9) AS delta FROM u")
def eval_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.metric_deltas(*[evaluation.summary(_run(spark, sf_dir, name)) for name in RUNS])
    return found.select("metric", *[F.round(c, 9).alias(c) for c in ("baseline", "current", "delta")])


def _minus(x: str, y: str) -> str:
    return f"list_filter({x}, lambda v: NOT list_contains({y}, v))"


@query(f"""WITH {_sql('baseline')}, {_sql('current')}, j AS (SELECT c.case_id, b.hit_count AS baseline_hit_count, c.hit_count AS current_hit_count, {_minus('c.missing', 'b.missing')} AS gm, {_minus('b.missing', 'c.missing')} AS lm, {_minus('c.unmatched', 'b.unmatched')} AS la, {_minus('b.unmatched', 'c.unmatched')} AS ga,
 coalesce(c.target_paper_recall < b.target_paper_recall, FALSE) OR coalesce(c.evidence_recall < b.evidence_recall, FALSE) AS lower, coalesce(c.target_paper_recall > b.target_paper_recall, FALSE) OR coalesce(c.evidence_recall > b.evidence_recall, FALSE) AS higher FROM c_c c JOIN b_c b USING (case_id))
 SELECT case_id, baseline_hit_count, current_hit_count, array_to_string(gm, ',') AS gained_missing_paper_ids, array_to_string(lm, ',') AS lost_missing_paper_ids, len(la)::INT AS lost_anchors, len(ga)::INT AS gained_anchors, len(gm) > 0 OR len(la) > 0 OR lower AS regression, (len(lm) > 0 OR len(ga) > 0 OR higher) AND NOT (len(gm) > 0 OR len(la) > 0 OR lower) AS improvement FROM j""")
def eval_case_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.case_deltas(*[_run(spark, sf_dir, name) for name in RUNS])
    listed = [F.array_join(c, ",").alias(c) for c in ("gained_missing_paper_ids", "lost_missing_paper_ids")]
    return found.select("case_id", "baseline_hit_count", "current_hit_count", *listed, *[F.size(c).alias(c) for c in ("lost_anchors", "gained_anchors")], "regression", "improvement")
