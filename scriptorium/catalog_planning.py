"""Queries on plans and budgets of requests, merged sub-questions, scopes, runs and conversations, and small values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .functions.text import lexical_terms
from .operators import planning, retrieval, runs, vectors
from .registry import BM25, query, table, texts
from .streaming import retention

_REQUESTS = """rq AS (SELECT conv_id AS request, 'about ' || conv_id AS query, 'fact' AS mode, CASE WHEN conv_id % 3 = 0 THEN []::BIGINT[] ELSE [conv_id % 7] END AS papers FROM (SELECT DISTINCT conv_id FROM conversations)),
 sq AS (SELECT conv_id AS request, turn AS ord, lower(substr(text, 1, 2)) AS query, (['fact', 'summary', 'method', 'compare', 'synthesis'])[turn % 5 + 1] AS mode, CASE WHEN turn % 3 = 0 THEN []::BIGINT[] ELSE list_distinct([conv_id % 7, turn % 4]) END AS papers, CASE WHEN turn % 4 > 0 THEN 'd' || (turn % 4) END AS dimension FROM conversations WHERE role = 'user' AND conv_id % 5 > 0),
 pl0 AS (SELECT r.request, coalesce(s.ord, 0) AS ord, coalesce(s.query, r.query) AS query, coalesce(s.mode, r.mode) AS mode, list_sort(CASE WHEN s.ord IS NULL OR len(s.papers) = 0 THEN r.papers ELSE s.papers END) AS papers, s.dimension FROM rq r LEFT JOIN sq s USING (request)),
 pl AS (SELECT request, query, mode, papers, dimension, min(ord) AS ord FROM pl0 GROUP BY ALL)"""


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A conversation is a request, its user turns are sub-questions."""
    said, c, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    none = F.array().cast("array<bigint>")
    requests = said.select("conv_id").distinct().select(c.alias("request"), F.concat(F.lit("about "), c.cast("string")).alias("query"), F.lit("fact").alias("mode"), F.when(c % 3 == 0, none).otherwise(F.array((c % 7).cast("long"))).alias("papers"))
    mode = F.element_at(F.array(*map(F.lit, ("fact", "summary", "method", "compare", "synthesis"))), (t % 5 + 1).cast("int"))
    papers = F.when(t % 3 == 0, none).otherwise(F.array_sort(F.array_distinct(F.array((c % 7).cast("long"), (t % 4).cast("long")))))
    questions = said.where((F.col("role") == "user") & (c % 5 > 0)).select(c.alias("request"), t.alias("ord"), F.lower(F.substring("text", 1, 2)).alias("query"), mode.alias("mode"), papers.alias("papers"), F.when(t % 4 > 0, F.concat(F.lit("d"), (t % 4).cast("string"))).alias("dimension"))
    return requests, questions


@query(f"WITH {_REQUESTS} SELECT request, ord, query, mode, array_to_string(papers, ',') AS papers, dimension FROM pl")
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.planned(*_requests(spark, sf_dir)).select("request", "ord", "query", "mode", F.array_join(F.transform("papers", lambda p: p.cast("string")), ",").alias("papers"), "dimension")


@query(f"""WITH {_REQUESTS}, g AS (SELECT request, list_sort(list_distinct(list_concat(any_value(r.papers), flatten(list(p.papers))))) AS targets, count(*) AS q, count(DISTINCT dimension) AS d, bool_or(p.mode IN ('summary', 'method', 'compare', 'synthesis')) AS expands FROM rq r JOIN pl p USING (request) GROUP BY request),
 s AS (SELECT *, greatest(len(targets), 1) AS p, greatest(2, d, 1) AS pp, CASE WHEN len(targets) > 1 THEN 'multi_paper' WHEN q > 1 OR d > 1 THEN 'corpus_survey' ELSE 'single_paper' END AS strategy FROM g)
 SELECT request, array_to_string(targets, ',') AS targets, strategy, expands, CASE strategy WHEN 'multi_paper' THEN greatest(5, p) WHEN 'corpus_survey' THEN 20 ELSE 5 END::INT AS max_papers, CASE strategy WHEN 'single_paper' THEN greatest(3, least(q, 6)) ELSE 3 END::INT AS sections_per_paper,
 CASE strategy WHEN 'multi_paper' THEN greatest(12, 3 * p) WHEN 'corpus_survey' THEN 20 ELSE greatest(12, 3 * q) END::INT AS initial_top_k, CASE strategy WHEN 'multi_paper' THEN greatest(6, 2 * p) WHEN 'corpus_survey' THEN 12 ELSE 6 END::INT AS global_fallback_top_k,
 CASE strategy WHEN 'multi_paper' THEN greatest(10, 2 * p) WHEN 'corpus_survey' THEN 12 ELSE 10 END::INT AS keyword_top_k, 8::INT AS max_expanded_per_hit, CASE strategy WHEN 'multi_paper' THEN greatest(30, 3 * p * pp) WHEN 'corpus_survey' THEN 40 ELSE 30 END::INT AS rerank_candidate_limit,
 CASE strategy WHEN 'multi_paper' THEN pp WHEN 'corpus_survey' THEN 2 ELSE 3 END::INT AS max_chunks_per_paper, least(24, CASE strategy WHEN 'multi_paper' THEN greatest(8, p * pp, 2 * q) WHEN 'corpus_survey' THEN 16 ELSE greatest(8, 2 * q) END)::INT AS final_top_k FROM s""")
def retrieval_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, questions = _requests(spark, sf_dir)
    found = planning.budgets(requests, planning.planned(requests, questions))
    return found.withColumn("targets", F.array_join(F.transform(F.array_sort("targets"), lambda p: p.cast("string")), ","))


_HITS = f"""{BM25}, shits AS (SELECT query_id % 40 AS request, query_id // 40 AS ord, 'keyword' AS channel, node_id, score, rank, 'q' || query_id AS query, CASE WHEN query_id % 3 > 0 THEN 'd' || (query_id % 3) END AS dimension FROM bm
 UNION ALL SELECT query_id % 40, query_id // 40, 'vector', node_id, score / 2, rank, 'q' || query_id, CASE WHEN query_id % 3 > 0 THEN 'd' || (query_id % 3) END FROM bm WHERE rank <= 4),
 cand AS (SELECT request, node_id, coalesce(max(score) FILTER (channel = 'vector'), 0) AS vector_score, max(score) FILTER (channel = 'keyword') AS keyword_score, arg_min(channel, ord * 2 + (channel = 'keyword')::INT) AS source, list_distinct(list(query)) AS qs, sum(1.0::DOUBLE / (60 + rank)) AS raw FROM shits GROUP BY ALL),
 uq AS (SELECT request, node_id, string_agg(query, ',' ORDER BY o) AS queries FROM (SELECT request, node_id, query, min(ord) AS o FROM shits GROUP BY ALL) GROUP BY ALL),
 ud AS (SELECT request, node_id, string_agg(dimension, ',' ORDER BY o) AS dimensions FROM (SELECT request, node_id, dimension, min(ord) AS o FROM shits WHERE dimension IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's sub-questions are five benchmark items; the first hits stand for a second channel as well."""
    q = F.col("query_id")
    found = retrieval.keyword_top_k(table(spark, sf_dir, "benchmark"), texts(spark, sf_dir), "item_id", "doc_id")
    base = found.select((q % 40).alias("request"), F.floor(q / 40).alias("ord"), "node_id", "score", "rank", F.concat(F.lit("q"), q.cast("string")).alias("query"), F.when(q % 3 > 0, F.concat(F.lit("d"), (q % 3).cast("string"))).alias("dimension"))
    channels = F.when(F.col("rank") <= 4, F.array(F.lit("keyword"), F.lit("vector"))).otherwise(F.array(F.lit("keyword")))
    hits = base.withColumn("channel", F.explode(channels)).withColumn("score", F.when(F.col("channel") == "vector", F.col("score") / 2).otherwise(F.col("score")))
    return planning.merged_hits(hits)


@query(f"WITH {_HITS} SELECT request, node_id, vector_score, keyword_score, source, queries, coalesce(dimensions, '') AS dimensions, round(raw / max(raw) OVER (PARTITION BY request), 6) AS fused_score FROM cand JOIN uq USING (request, node_id) LEFT JOIN ud USING (request, node_id)")
def merged_subquestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _merged(spark, sf_dir)
    return found.select("request", "node_id", "vector_score", "keyword_score", "source", F.array_join("queries", ",").alias("queries"), F.array_join("dimensions", ",").alias("dimensions"), "fused_score")


@query(f"""WITH {_HITS}, p AS (SELECT h.request, d.source AS parent, node_id, query, dimension, ord FROM shits h JOIN documents d ON d.doc_id = node_id WHERE d.source IS NOT NULL),
 q AS (SELECT request, parent, query, min((node_id, ord)) AS o FROM p GROUP BY ALL), m AS (SELECT request, parent, dimension, min((node_id, ord)) AS o FROM p WHERE dimension IS NOT NULL GROUP BY ALL)
 SELECT request, parent, string_agg(query, ',' ORDER BY o) AS queries, coalesce((SELECT string_agg(dimension, ',' ORDER BY o) FROM m WHERE m.request = q.request AND m.parent = q.parent), '') AS dimensions FROM q GROUP BY request, parent""")
def section_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _merged(spark, sf_dir).join(texts(spark, sf_dir).select(F.col("doc_id").alias("node_id"), F.col("source").alias("parent")), "node_id")
    return planning.provenance(found).select("request", "parent", F.array_join("queries", ",").alias("queries"), F.array_join("dimensions", ",").alias("dimensions"))


_SIM = """v AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS vec, label FROM embeddings), q AS (SELECT node_id AS query_id, vec AS qvec FROM v WHERE node_id % 20 = 0),
 s AS (SELECT query_id, node_id, label, round(list_dot_product(qvec, vec) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(vec, vec))), 6) AS score FROM q, v),
 f AS (SELECT query_id % 100 AS request, label, max(score) AS score FROM s GROUP BY ALL)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"), "label")
    return nodes, nodes.where(F.col("node_id") % 20 == 0).select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, queries = _vectors(spark, sf_dir)
    best = retrieval.vector_top_k(queries, nodes, 1, ["label"]).withColumn("request", F.col("query_id") % 100)
    return planning.folded(best, ["label"])


@query(f"WITH {_SIM} SELECT * FROM f")
def folded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose ids end alike are the embeddings of one request; labels are papers."""
    return _routed(spark, sf_dir)


@query(f"""WITH {_SIM}, r AS (SELECT request, label FROM f QUALIFY row_number() OVER (PARTITION BY request ORDER BY score DESC, label) <= 2)
 SELECT s.query_id, s.label, node_id, s.score, row_number() OVER (PARTITION BY s.query_id, s.label ORDER BY s.score DESC, node_id) AS rank FROM s JOIN r ON r.request = s.query_id % 100 AND r.label = s.label QUALIFY rank <= 3""")
def scoped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the two papers that a request is routed to, three a paper and embedding."""
    nodes, queries = _vectors(spark, sf_dir)
    routed = retrieval.top_k(_routed(spark, sf_dir), ["request"], [F.col("score").desc(), F.col("label")], 2).select("request", "label")
    scope = queries.select("query_id", (F.col("query_id") % 100).alias("request")).join(routed, "request")
    hits = vectors.scope_hits(queries, scope, nodes, 3, "label")
    return retrieval.top_k(hits, ["query_id", "label"], [F.col("score").desc(), F.col("node_id")], 3).select("query_id", "label", "node_id", "score", "rank")


_LEX = "list_distinct(list_concat(list_transform(list_filter(regexp_extract_all({t}, '[A-Za-z0-9]+'), lambda t: length(t) > 1), lambda t: lower(t)), regexp_extract_all({t}, '[一-鿿]')))"


@query(f"WITH t AS (SELECT doc_id, {_LEX.format(t='text')} AS t FROM documents WHERE text IS NOT NULL) SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END, 9)::DOUBLE AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1")
def term_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each document and the next by their terms."""
    t = texts(spark, sf_dir).where("text is not null").select("doc_id", lexical_terms(F.col("text")).alias("t"))
    after = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return t.join(after, "doc_id").select("doc_id", F.round(planning.jaccard(F.col("t"), F.col("u")), 9).alias("jaccard"))


@query(f"WITH {BM25} SELECT query_id AS request, node_id, rerank_score, rank FROM (SELECT query_id, node_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, node_id) AS rank FROM (SELECT query_id, node_id, round(len(list_intersect({_LEX.format(t='i.text')}, {_LEX.format(t='d.text')})) / len({_LEX.format(t='i.text')}), 9)::DOUBLE AS rerank_score FROM bm JOIN benchmark i ON i.item_id = query_id JOIN documents d ON d.doc_id = node_id)) WHERE rank <= 5")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits in another order: by the share of the query's terms that a text has, in place of a model."""
    items, docs = table(spark, sf_dir, "benchmark"), texts(spark, sf_dir)
    found = retrieval.keyword_top_k(items, docs, "item_id", "doc_id")
    rows = found.join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id").join(docs.select(F.col("doc_id").alias("node_id"), "text"), "node_id").withColumnRenamed("query_id", "request")
    share = lambda q, t: F.round(F.size(F.array_intersect(lexical_terms(q), lexical_terms(t))) / F.size(lexical_terms(q)), 9)
    return planning.reranked(rows, share, 5).select("request", "node_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


_LOG = """lg AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, CASE WHEN event_type = 'signup' THEN 'run.started' WHEN event_type = 'view' THEN CASE WHEN value < 20 THEN 'run.resumed' ELSE 'stage.started' END WHEN event_type = 'click' THEN 'tool.completed'
 WHEN event_type = 'purchase' THEN CASE WHEN value > 80 THEN 'run.completed' ELSE 'tool.started' END ELSE CASE WHEN value > 90 THEN 'run.cancelled' WHEN value > 70 THEN 'run.failed' ELSE 'tool.failed' END END AS event_type, ts, floor(value)::BIGINT AS duration_ms FROM events),
 st AS (SELECT run_id, coalesce(replace(arg_min(event_type, sequence) FILTER (event_type IN ('run.completed', 'run.failed', 'run.cancelled')), 'run.', ''), 'running') AS status, min(ts) FILTER (event_type IN ('run.completed', 'run.failed', 'run.cancelled')) AS ended,
 count(*) FILTER (event_type = 'stage.started') AS llm_calls, count(*) FILTER (event_type = 'tool.completed') AS tool_calls, sum(duration_ms)::BIGINT AS duration_ms, sum(length(event_type))::BIGINT AS input_tokens, count(*) AS output_tokens FROM lg GROUP BY run_id)"""


def _event_name(kind: str) -> Column:
    """A run event's name, by an event's type and value."""
    v, kind = F.col("value"), F.col(kind)
    name = F.when(kind == "signup", "run.started").when(kind == "view", F.when(v < 20, "run.resumed").otherwise("stage.started")).when(kind == "click", "tool.completed").when(kind == "purchase", F.when(v > 80, "run.completed").otherwise("tool.started"))
    return F.coalesce(name, F.when(v > 90, "run.cancelled").when(v > 70, "run.failed").otherwise("tool.failed"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with cancelled runs and notices of resumed connections."""
    log = runs.event_log(table(spark, sf_dir, "events")).join(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "value"), "event_id")
    return log.withColumn("event_type", _event_name("kind")).drop("kind", "value")


@query(f"WITH {_LOG} SELECT run_id, sequence::INT AS sequence, event_type FROM lg WHERE event_type <> 'run.resumed'")
def persisted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stored(_log(spark, sf_dir)).select("run_id", "sequence", "event_type")


@query(f"WITH {_LOG} SELECT run_id, sequence::INT AS sequence, event_type, TRUE AS gap FROM lg WHERE event_type <> 'run.resumed' AND sequence > 25")
def fallback_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.fallback_replay(_log(spark, sf_dir), 25)


@query(f"WITH {_LOG} SELECT run_id, status, ended, llm_calls, tool_calls, duration_ms FROM st")
def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.finished(_log(spark, sf_dir)).select("run_id", "status", "ended", "llm_calls", "tool_calls", "duration_ms")


def _conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.finished(_log(spark, sf_dir)).withColumn("conversation_id", (F.col("run_id") % 300).cast("long"))


@query(f"WITH {_LOG} SELECT c.conv_id AS conversation_id, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(input_tokens + output_tokens), 0)::BIGINT AS total_tokens, coalesce(sum(llm_calls), 0)::BIGINT AS llm_calls, coalesce(sum(tool_calls), 0)::BIGINT AS tool_calls, coalesce(sum(duration_ms), 0)::BIGINT AS duration_ms, count(run_id) AS run_count FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN st ON st.run_id % 300 = c.conv_id AND status <> 'running' GROUP BY c.conv_id")
def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rollup(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conversation_id")), _conversation_runs(spark, sf_dir))


_RETAINED = f"WITH {_LOG} SELECT run_id, status FROM st WHERE ended IS NULL OR epoch(date_trunc('second', (SELECT max(ts) FROM events)))::BIGINT - epoch(date_trunc('second', ended))::BIGINT < 2000000"


@query(_RETAINED)
def retained_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers still held at the time of the last event, 23 days after a run's end."""
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    return runs.retained(runs.finished(_log(spark, sf_dir)).crossJoin(F.broadcast(now)), F.col("now"), 2_000_000).select("run_id", "status")  # one row


@query(_RETAINED)
def stream_retained_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that a stream with a timer for each has not forgotten."""
    gone = retention.run_stateful(spark, f"{sf_dir}/events.parquet", "forgotten", lambda e: retention.forgotten(e.withColumn("event_type", _event_name("event_type")), 2_000_000))
    return runs.finished(_log(spark, sf_dir)).join(gone, "run_id", "left_anti").select("run_id", "status")


@query(f"""WITH {_LOG}, e AS (SELECT run_id, min(sequence) FILTER (event_type IN ('run.completed', 'run.failed', 'run.cancelled')) AS finish FROM lg GROUP BY ALL), s AS (SELECT run_id, finish, run_id * 10 + k AS subscriber, k * 3 AS after FROM e, range(3) r(k))
 SELECT subscriber, run_id, sequence, event_type FROM s JOIN lg USING (run_id) WHERE sequence > after AND (finish IS NULL OR sequence <= finish) UNION ALL SELECT subscriber, run_id, finish + 1, 'closed' FROM s WHERE finish IS NOT NULL""")
def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run has three subscribers, who have seen none, three and six of its events."""
    run = F.col("user_id")
    seen = table(spark, sf_dir, "events").select(run).distinct().select(run.alias("run_id"), F.posexplode(F.array(*map(F.lit, (0, 3, 6)))).alias("k", "after"))
    subscribers = seen.select((F.col("run_id") * 10 + F.col("k")).alias("subscriber"), "run_id", "after")
    return retention.run_stateful(spark, f"{sf_dir}/events.parquet", "deliveries", lambda e: retention.delivered(e.withColumn("event_type", _event_name("event_type")), subscribers))



@query("SELECT user_id AS conversation_id, max(ts) AS updated_at FROM events GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 25")
def recent_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.recent(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("conversation_id")).agg(F.max("ts").alias("updated_at")), 25)


@query(f"WITH {_LOG} SELECT run_id, run_id % 300 AS conversation_id, status FROM st WHERE run_id % 300 = run_id % 7")
def owned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run is asked for in the conversation of its number modulo 7."""
    found = _conversation_runs(spark, sf_dir)
    wanted = found.select("run_id", (F.col("run_id") % 7).cast("long").alias("conversation_id"))
    return runs.owned(found.select("run_id", "conversation_id", "status"), wanted).select("run_id", "conversation_id", "status")


@query("""WITH m AS (SELECT conv_id AS conversation_id, turn AS sequence, conv_id * 1000 + turn AS run_id, turn % 2 = 1 AS succeeded, CASE WHEN role = 'assistant' AND turn % 5 > 2 THEN turn - 1 END AS replaces FROM conversations)
 SELECT conversation_id, sequence, (SELECT arg_min(t.run_id, t.sequence) FROM m t WHERE t.conversation_id = m.conversation_id AND t.replaces IS NOT NULL AND ((t.succeeded AND m.sequence >= t.replaces AND m.sequence < t.sequence) OR (NOT t.succeeded AND t.run_id = m.run_id))) AS superseded_by FROM m""")
def regenerated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some answers are second attempts at the message before; those of even turns failed."""
    c, t = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    rows = table(spark, sf_dir, "conversations").select(c.alias("conversation_id"), t.alias("sequence"), (c * 1000 + t).alias("run_id"), (t % 2 == 1).alias("succeeded"), F.when((F.col("role") == "assistant") & (t % 5 > 2), t - 1).alias("replaces"))
    return runs.regenerated(rows).select("conversation_id", "sequence", "superseded_by")


@query(r"""SELECT page_id, '| ' || array_to_string(list_transform([url, regexp_extract(html, '<title>([^<]*)</title>', 1), replace(substr(html, 1, 20), '<', '|'), ''], lambda c: replace(trim(regexp_replace(coalesce(c, ''), '\s+', ' ', 'g'), ' '), '|', '\|')), ' | ') || ' |' AS "row", substr(html, 1, 280) AS excerpt, CASE WHEN length(html) > 1000 THEN rtrim(substr(html, 1, 997), ' ') || '...' ELSE html END AS summary FROM pages""")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    cells = F.array("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.replace(F.substring("html", 1, 20), F.lit("<"), F.lit("|")))
    return table(spark, sf_dir, "pages").select("page_id", values.markdown_row(cells, F.lit(4)).alias("row"), values.excerpt(html).alias("excerpt"), values.compact(html).alias("summary"))


@query("SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as JSON, plain or in blocks, and back."""
    said = table(spark, sf_dir, "conversations").where("text is not null")
    half = F.floor(F.length("text") / 2).cast("int")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.to_json(F.array(block("text", F.substring("text", F.lit(1), half)), block("image", F.lit("none")), block("text", F.substring("text", half + 1, F.length("text")))))
    plain = F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    return said.select("conv_id", "turn", values.message_text(F.when(F.col("turn") % 2 == 0, blocks).otherwise(plain)).alias("text"))


@query("""SELECT item_id, CASE WHEN k <> '' AND v <> '' THEN k END AS key, CASE WHEN k <> '' AND v <> '' THEN v END AS value FROM (SELECT item_id, CASE WHEN instr(t, '=') > 0 THEN trim(substr(t, 1, instr(t, '=') - 1), ' ') ELSE '' END AS k, CASE WHEN instr(t, '=') > 0 THEN trim(substr(t, instr(t, '=') + 1), ' ') ELSE '' END AS v
 FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN substr(text, 1, 5) || '=' || substr(text, 7, 9) || '=' WHEN 1 THEN '=' || text WHEN 2 THEN replace(text, '=', ' ') ELSE text || ' = ' END AS t FROM benchmark))""")
def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("item_id"), F.col("text")
    said = F.when(i % 4 == 0, F.concat(F.substring(t, 1, 5), F.lit("="), F.substring(t, 7, 9), F.lit("="))).when(i % 4 == 1, F.concat(F.lit("="), t)).when(i % 4 == 2, F.replace(t, F.lit("="), F.lit(" "))).otherwise(F.concat(t, F.lit(" = ")))
    return table(spark, sf_dir, "benchmark").select("item_id", values.assignment(said).alias("a")).select("item_id", "a.key", "a.value")


@query("SELECT doc_id, substr(sha256(coalesce(lang, 'none') || '|' || (n_chars % 3) || '|chunks-1|lines-1|' || (doc_id % 4)), 1, 16) AS fingerprint FROM documents")
def index_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand for models; the versions are fixed values."""
    model = F.coalesce("lang", F.lit("none"))
    return texts(spark, sf_dir).select("doc_id", values.index_fingerprint(model, F.nullif(F.col("n_chars") % 3, F.lit(0)), F.lit("chunks-1"), F.lit("lines-1"), F.col("doc_id") % 4).alias("fingerprint"))


@query("SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(list_dot_product(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))), list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS squared FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "embeddings").select("vec_id", values.unit(F.col("embedding")).alias("u"))
    return made.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))
