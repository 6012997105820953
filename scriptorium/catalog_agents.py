"""Queries on judgments, citations, runs, messages, policy and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evidence, runs
from .registry import LOG, query, table
from .sources import tables
from .storage import fresh_path
from .streaming import events as streams

_JUDGED = """j AS (SELECT doc_id AS paper, 'quality' AS dimension, 1 AS round, CASE quality WHEN 1 THEN 'covered' ELSE 'missing' END AS status, doc_id + doc_id % 2 AS cites FROM labels
 UNION ALL SELECT doc_id, 'quality', 2, 'not_stated', doc_id FROM labels WHERE toxic = 1),
 m AS (SELECT paper, dimension, arg_max(status, round) AS status, arg_max(cites, round) AS cites, min(round) AS first_round FROM j GROUP BY ALL)"""


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two rounds of verdicts; an odd document cites its neighbour's evidence, which does not count."""
    labels, none = table(spark, sf_dir, "labels"), F.lit("quality").alias("dimension")
    cite = lambda c: F.array(evidence.evidence_id(c.cast("string"))).alias("cited")
    first = labels.select(F.col("doc_id").alias("paper"), none, F.lit(1).alias("round"), F.when(F.col("quality") == 1, "covered").otherwise("missing").alias("status"), cite(F.col("doc_id") + F.col("doc_id") % 2))
    return first.unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("paper"), none, F.lit(2).alias("round"), F.lit("not_stated").alias("status"), cite(F.col("doc_id"))))


@query(f"WITH {_JUDGED} SELECT paper, dimension, status, first_round FROM m")
def judgment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.merged_judgments(_judgments(spark, sf_dir)).drop("cited")


@query(f"WITH {_JUDGED} SELECT paper, dimension, CASE WHEN status = 'covered' AND NOT (cites = paper AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = paper)) THEN 'missing' ELSE status END AS status, CASE WHEN status = 'covered' AND cites = paper AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = paper) THEN 1 ELSE 0 END::BIGINT AS verified FROM m")
def apply_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper"), evidence.evidence_id(F.col("doc_id").cast("string")).alias("evidence_id"))
    return evidence.applied_judgments(evidence.merged_judgments(_judgments(spark, sf_dir)), library)


@query("""WITH a AS (SELECT conv_id, turn, unnest([turn - 1, turn]) AS cites, unnest([0, 1]) AS ord FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user')
 SELECT a.conv_id || ':' || a.turn AS answer_id, ord, 'E-' || substr(sha256(a.conv_id || '|' || cites), 1, 12) AS evidence_id, u.turn IS NOT NULL AS known FROM a LEFT JOIN u ON u.conv_id = a.conv_id AND u.turn = a.cites""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages are evidence; each answer cites the message before it and itself."""
    said = table(spark, sf_dir, "conversations")
    mark = lambda turn: evidence.evidence_id(F.col("conv_id").cast("string"), turn.cast("string"))
    answers = said.where("role = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), F.concat(F.lit("see ["), mark(F.col("turn") - 1), F.lit("] and ["), mark(F.col("turn")), F.lit("]")).alias("text"))
    return evidence.checked_citations(answers, said.where("role = 'user'").select(mark(F.col("turn")).alias("evidence_id")))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS artifact, p_partkey // 3 AS source FROM part WHERE p_partkey >= 3 UNION ALL SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 3),
 c AS (SELECT p_partkey AS root, p_partkey AS artifact FROM part WHERE p_size = 1 UNION SELECT c.root, e.source FROM c JOIN e USING (artifact)) SELECT root, artifact FROM c""")
def artifact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for artifacts; part n rests on parts n/2 and n/3."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    edges = part.where(key >= 3).select(key.alias("artifact"), F.explode(F.array(F.floor(key / 2), F.floor(key / 3))).alias("source"))
    return evidence.closure(spark, edges, part.where("p_size = 1").select(key.alias("artifact")))


@query("SELECT d.doc_id AS paper, CASE WHEN l.doc_id IS NULL THEN 'irrelevant' WHEN quality = 1 THEN 'relevant' ELSE 'partial' END AS relevance FROM documents d LEFT JOIN labels l USING (doc_id)")
def screening_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper"), F.when(F.col("quality") == 1, "relevant").otherwise("partial").alias("relevance"), F.lit(0).alias("ord"))
    return evidence.screened(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper")), verdicts)


@query("""SELECT user_id AS search, CASE WHEN f = 0 THEN 'rate_limited' WHEN f IN (1, 2) THEN 'provider_error' WHEN f IS NOT NULL THEN 'failed' WHEN s > 0 AND a = 0 THEN 'no_matches' ELSE 'completed' END AS status
 FROM (SELECT user_id, arg_max(event_id % 4, event_id) FILTER (event_type = 'error' AND value > 90) AS f, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'purchase' AND value > 95) AS a FROM events GROUP BY ALL)""")
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events stand for a search: costly errors failed, views succeeded, high purchases were accepted."""
    failed = (F.col("event_type") == "error") & (F.col("value") > 90)
    kind = F.element_at(F.array(*map(F.lit, ("rate_limited", "provider_error", "network_error", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.when(failed, kind), F.when(failed, F.col("event_id"))).alias("f"), F.count_if(F.col("event_type") == "view").alias("s"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 95)).alias("a"))
    return s.select(F.col("user_id").alias("search"), evidence.search_status(F.col("f"), F.col("s"), F.col("a")).alias("status"))


@query("""WITH r AS (SELECT c_custkey AS request, p AS priority, CASE WHEN p = c_custkey % 4 THEN 1 ELSE 0 END AS found FROM customer, (SELECT unnest([0, 1, 2]) AS p))
 SELECT request, CASE min(priority) FILTER (found > 0) WHEN 0 THEN 'openalex' WHEN 1 THEN 'semantic_scholar' WHEN 2 THEN 'arxiv' END AS provider, coalesce(min(priority) FILTER (found > 0), 3)::INT AS empty_before FROM r GROUP BY request""")
def provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for requests; the provider number c_custkey mod 4 finds something, number 3 does not exist."""
    tried = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.posexplode(F.array(*map(F.lit, ("openalex", "semantic_scholar", "arxiv")))).alias("priority", "provider"))
    return evidence.first_provider(tried.withColumn("found", (F.col("priority") == F.col("request") % 4).cast("int")))


@query("""WITH t AS (SELECT o_orderkey AS task, o_orderkey % 4 AS targets, least(o_custkey % 3, o_orderkey % 4) AS local, o_orderkey % 5 > 1 AS source, o_orderkey % 5 > 2 AS known, o_custkey % 2 = 0 AS corpus FROM orders)
 SELECT task, CASE WHEN targets = 0 THEN CASE WHEN corpus THEN CASE WHEN source THEN 'global_local_reader_does_not_require_search_source' END WHEN NOT known THEN 'reader_requires_search_source' END
 WHEN local > 0 THEN CASE WHEN local < targets THEN 'reader_local_targets_only' WHEN source THEN 'local_reader_does_not_require_search_source' END
 WHEN NOT known THEN 'reader_requires_search_source' WHEN targets > 1 THEN 'external_reader_single_paper_only' END AS rule FROM t""")
def policy_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for reading tasks."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rule = evidence.reader_rule(o % 4, F.least(c % 3, o % 4), o % 5 > 1, o % 5 > 2, c % 2 == 0)
    return table(spark, sf_dir, "orders").select(o.alias("task"), rule.alias("rule"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.event_log(table(spark, sf_dir, "events"))


_STATUS = f"{LOG}, st AS (SELECT run_id, CASE arg_max(event_type, sequence) WHEN 'run.completed' THEN 'completed' WHEN 'run.failed' THEN 'failed' ELSE 'running' END AS status, sum(duration_ms)::BIGINT AS duration_ms FROM log GROUP BY ALL)"


@query(f"WITH {_STATUS} SELECT * FROM st")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_status(_log(spark, sf_dir))


@query(f"WITH {_STATUS} SELECT run_id % 20 AS conversation_id, count(*) AS running FROM st WHERE status = 'running' GROUP BY ALL HAVING count(*) > 1")
def busy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.busy(run_status(spark, sf_dir), 20)


@query("SELECT event_id, CASE WHEN event_type = 'click' AND json_extract_string(props, '$.k')::INT IS NOT NULL THEN '{}' ELSE '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' END AS payload FROM events")
def payload_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The keys of a finished tool's payload that are stored.
    keys = ("tool_call_id", "tool_name", "result_count", "initial_hit_count", "expanded_candidate_count", "hit_count", "extracted_pages", "duration_ms")
    return runs.persisted(table(spark, sf_dir, "events"), keys)


_ASKED = "q AS (SELECT * FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question_turn FROM conversations) WHERE role = 'assistant')"


@query(f"WITH {_ASKED} SELECT conv_id, turn, question_turn, nullif(max(turn) OVER (PARTITION BY conv_id, question_turn), turn) AS replaced_by FROM q")
def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.superseded(table(spark, sf_dir, "conversations"))


@query(f"WITH {_ASKED}, s AS (SELECT conv_id, turn FROM q QUALIFY max(turn) OVER (PARTITION BY conv_id, question_turn) > turn) SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = c.conv_id AND s.turn = c.turn)")
def active_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    gone = runs.superseded(said).where("replaced_by IS NOT NULL").select("conv_id", "turn")
    return said.join(gone, ["conv_id", "turn"], "left_anti").select("conv_id", "turn", "role")


@query("""SELECT conv_id, "group", count(*) AS messages, min(turn) AS first_turn, max(turn) AS last_turn FROM (SELECT *, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS "group" FROM conversations) GROUP BY ALL""")
def turn_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.turns(table(spark, sf_dir, "conversations"))


@query(f"WITH {_STATUS} SELECT run_id, count(*) AS events FROM log WHERE run_id NOT IN (SELECT run_id FROM st WHERE status = 'failed') GROUP BY ALL")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed runs go with their events."""
    left = runs.without_runs(_log(spark, sf_dir), run_status(spark, sf_dir).where("status = 'failed'"))
    return left.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"))


@query(f"""WITH {LOG} SELECT run_id, sequence::INT AS sequence, 'id: ' || sequence || chr(10) || 'event: ' || event_type || chr(10) || 'data: {{"run_id":' || run_id || ',"sequence":' || sequence || ',"event_type":"' || event_type || '"}}' || chr(10) || chr(10) AS frame FROM log""")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sse_frames(_log(spark, sf_dir))


@query("SELECT 'documents' AS name, count(*) AS rows, true AS consistent FROM documents UNION ALL SELECT 'labels', count(*), true FROM labels")
def backup_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "backup")
    tables.backup(spark, {name: table(spark, sf_dir, name) for name in ("documents", "labels")}, folder)
    return tables.verified(spark, folder)


@query("""WITH l AS (SELECT user_id AS run_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 SELECT run_id, sequence, event_type, greatest(n - 40, 0) AS dropped_through FROM l WHERE sequence > n - 40""")
def stream_replay_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.last_update(spark, f"{sf_dir}/events.parquet", "buffer", lambda e: streams.buffer_stream(e, 40), streams.BUFFER_SCHEMA)


@query("""SELECT user_id AS run_id, count(*) AS last_sequence, arg_max(event_type, (ts, event_id)) AS last_event, count(*) FILTER (event_type = 'click') AS tool_calls FROM events GROUP BY ALL""")
def stream_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.last_update(spark, f"{sf_dir}/events.parquet", "state", streams.state_stream, streams.STATE_SCHEMA)
