"""The registry of queries and SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import STOP_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer files is dealt anew before its texts are read.
FEW_FILES = 32


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, for queries that read whole texts.

    Such queries are bound by CPU, and a file of one row group is one task however it is split. A table of fewer files
    than cores (and than FEW_FILES) is dealt by doc_id, into as many parts as its size asks for; larger ones
    are read as they are. The hash keeps this apart from partitionings by doc_id, so that a later shuffle of small rows is still one that readers share.
    """
    docs = table(spark, sf_dir, "documents")
    return docs.repartition(F.xxhash64("doc_id")) if len(docs.inputFiles()) < min(FEW_FILES, spark.sparkContext.defaultParallelism) else docs


def embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, vec, label) of the embeddings and queries (query_id, qvec), those whose id is divisible by 20."""
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"), "label")
    return nodes, nodes.where(F.col("node_id") % 20 == 0).select(F.col("node_id").alias("query_id"), F.col("vec").alias("qvec"))


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: (id, ord, term) of keyword tokens; the test data holds no CJK characters.
TOKENS = """SELECT {id} AS id, lower(u.t) AS term, u.ord FROM (SELECT {id}, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+'), 1) AS ord FROM {table}) u
 WHERE length(u.t) >= 2 AND lower(u.t) NOT IN (""" + STOP + ")"
DOC_TOKENS, ITEM_TOKENS = TOKENS.format(id="doc_id", table="documents"), TOKENS.format(id="item_id", table="benchmark")
TERMS = f"SELECT id AS query_id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY min(ord)) AS n FROM ({ITEM_TOKENS}) GROUP BY id, term) WHERE n <= 12"
BM25 = f"""
 tok AS ({DOC_TOKENS}), post AS (SELECT id AS node_id, term, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT id AS node_id, count(*) AS dl FROM tok GROUP BY ALL),
 terms AS ({TERMS}), hits AS (SELECT query_id, term, node_id, dl, tf FROM terms JOIN post USING (term) JOIN len USING (node_id)),
 pool AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT query_id, node_id, dl FROM hits) GROUP BY ALL),
 df AS (SELECT query_id, term, count(*) AS df FROM hits GROUP BY ALL),
 raw AS (SELECT query_id, node_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw, count(*) AS matched FROM hits JOIN pool USING (query_id) JOIN df USING (query_id, term) GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT query_id, node_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, matched FROM raw) QUALIFY rank <= 10)"""
LOG = """log AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
 CASE event_type WHEN 'signup' THEN 'run.started' WHEN 'view' THEN 'stage.started' WHEN 'click' THEN 'tool.completed' WHEN 'purchase' THEN 'run.completed' WHEN 'error' THEN 'run.failed' END AS event_type,
 event_id, ts, floor(value)::BIGINT AS duration_ms FROM events)"""
LINES = "lines AS (SELECT source, doc_id, trim(line, ' ') AS line, ord FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents) WHERE trim(line, ' ') <> '')"
KNN = """v AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS vec, label FROM embeddings), q AS (SELECT node_id AS query_id, vec AS qvec FROM v WHERE node_id % 20 = 0),
 s AS (SELECT query_id, node_id, label, round(list_dot_product(qvec, vec) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(vec, vec))), 6) AS score FROM q, v)"""
