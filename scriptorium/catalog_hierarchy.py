"""Queries on recall along the tree, on the vector index and on collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_documents import _CHUNKS
from .functions.text import hash_vector
from .operators import chunking, hierarchy, library, retrieval, vectors
from .registry import KNN, STOP, embedded, query, table, texts
from .sources.collections import Collection, Signature
from .storage import fresh_path, stash

@query(f"WITH {KNN} SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s QUALIFY rank <= 12")
def knn_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with all its lists: what the exact search gives."""
    nodes, queries = embedded(spark, sf_dir)
    index, centroids = vectors.indexed(nodes, 16)
    hits = vectors.probed_hits(queries, index, centroids, 12, len(centroids))
    return retrieval.top_k(hits, ["query_id"], [F.col("score").desc(), F.col("node_id")], 12)


@query()
def knn_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with as many lists a query as 0.95 of the exact hits of a sample of queries need; its recall is measured in tests and in the README."""
    nodes, queries = embedded(spark, sf_dir)
    index, centroids = vectors.indexed(nodes)
    index = stash(index, "index")
    hits = vectors.probed_hits(queries, index, centroids, 12, vectors.probes_for(queries, nodes, index, centroids, 12))
    return retrieval.top_k(hits, ["query_id"], [F.col("score").desc(), F.col("node_id")], 12)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A document is a paper, its lines are sections, their packed sentences chunks. Stored once, as several steps read them."""
    docs = texts(spark, sf_dir)
    roots = docs.select(F.col("doc_id").alias("paper"), F.col("doc_id").cast("string").alias("node_id"), "text")
    sections = library.section_nodes(docs).select(F.col("doc_id").alias("paper"), "node_id", F.col("line").alias("text"))
    chunk = F.format_string("%d:section:%04d", "doc_id", "section")
    chunks = chunking.chunks(docs).select(F.col("doc_id").alias("paper"), chunk.alias("parent"), F.concat(chunk, F.format_string(":chunk:%04d", "chunk")).alias("node_id"), "text")
    return roots, stash(sections, "sections"), stash(chunks, "chunks")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third item asks about two papers only."""
    i = F.col("item_id")
    papers = F.when(i % 3 == 0, F.array(i * 5 % 200, (i * 7 + 1) % 200)).otherwise(F.array().cast("array<long>"))
    return table(spark, sf_dir, "benchmark").select(i.alias("query_id"), hash_vector(F.col("text")).alias("qvec"), F.array_distinct(papers).alias("papers"))


def _embedded(text: str) -> str:
    dims = f"list_transform(list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) >= 2 AND t NOT IN ({STOP})), lambda t: ('0x' || substr(md5(t), 31, 2))::INT % 64)"
    return f"list_transform(range(64), lambda d: len(list_filter({dims}, lambda x: x = d))::DOUBLE)"


_COS = "CASE WHEN list_sum(q.v) = 0 OR list_sum(n.v) = 0 THEN 0 ELSE round(list_dot_product(q.v, n.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(n.v, n.v))), 6) END"
_TREE = f"""{_CHUNKS}, roots AS (SELECT doc_id AS paper, doc_id::VARCHAR AS node_id, {_embedded('text')} AS v FROM documents),
 sects AS (SELECT doc_id AS paper, printf('%d:section:%04d', doc_id, section) AS node_id, {_embedded('text')} AS v FROM sec),
 chks AS (SELECT doc_id AS paper, printf('%d:section:%04d', doc_id, section) AS parent, printf('%d:section:%04d:chunk:%04d', doc_id, section, chunk) AS node_id, {_embedded('text')} AS v FROM chunks),
 q AS (SELECT item_id AS query_id, {_embedded('text')} AS v, CASE WHEN item_id % 3 = 0 THEN list_distinct([item_id * 5 % 200, (item_id * 7 + 1) % 200]) ELSE []::BIGINT[] END AS papers FROM benchmark),
 ra AS (SELECT query_id, n.node_id, paper, {_COS} AS score FROM q, roots n WHERE len(papers) = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n.node_id) <= 5),
 rp AS (SELECT query_id, paper FROM ra UNION SELECT query_id, unnest(papers) FROM q),
 rs AS (SELECT rp.query_id, rp.paper, n.node_id, {_COS} AS score FROM rp JOIN sects n USING (paper) JOIN q ON q.query_id = rp.query_id QUALIFY row_number() OVER (PARTITION BY rp.query_id, rp.paper ORDER BY score DESC, n.node_id) <= 3),
 rc AS (SELECT s.query_id, n.node_id, {_COS} AS score FROM (SELECT query_id, node_id AS parent FROM rs) s JOIN chks n USING (parent) JOIN q ON q.query_id = s.query_id QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, n.node_id) <= 12),
 rf AS (SELECT query_id, n.node_id, {_COS} AS score FROM q, chks n WHERE len(papers) = 0 OR list_contains(papers, n.paper) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n.node_id) <= 6),
 hits AS (SELECT query_id, node_id, max(score) AS score, max(channel) AS channel FROM (SELECT *, 'hierarchy' AS channel FROM rc UNION ALL SELECT *, 'fallback' FROM rf) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_TREE} SELECT DISTINCT query_id, paper FROM rp")
def routed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    roots = docs.select(F.col("doc_id").alias("paper"), F.col("doc_id").cast("string").alias("node_id"), "text")
    return hierarchy.routed_papers(_queries(spark, sf_dir), roots)


@query(f"WITH RECURSIVE {_TREE} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM hits")
def hierarchical_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.recalled(_queries(spark, sf_dir), *_tree(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TREE}, seed AS (SELECT query_id, node_id FROM hits UNION ALL SELECT query_id, node_id FROM ra), start AS (SELECT DISTINCT query_id, coalesce(c.parent, s.node_id) AS anchor FROM seed s LEFT JOIN chks c ON c.node_id = s.node_id),
 one AS (SELECT s.query_id, s.anchor, n.node_id, {_COS} AS score FROM start s JOIN chks n ON n.parent = s.anchor JOIN q ON q.query_id = s.query_id WHERE NOT EXISTS (SELECT 1 FROM seed h WHERE h.query_id = s.query_id AND h.node_id = n.node_id) QUALIFY row_number() OVER (PARTITION BY s.query_id, s.anchor ORDER BY score DESC, n.node_id) <= 8),
 next AS (SELECT DISTINCT s.query_id, c.node_id AS anchor FROM start s JOIN sects c ON c.paper::VARCHAR = s.anchor WHERE NOT EXISTS (SELECT 1 FROM start t WHERE t.query_id = s.query_id AND t.anchor = c.node_id)),
 two AS (SELECT s.query_id, s.anchor, n.node_id, {_COS} AS score FROM next s JOIN chks n ON n.parent = s.anchor JOIN q ON q.query_id = s.query_id WHERE NOT EXISTS (SELECT 1 FROM seed h WHERE h.query_id = s.query_id AND h.node_id = n.node_id) AND NOT EXISTS (SELECT 1 FROM one h WHERE h.query_id = s.query_id AND h.node_id = n.node_id) QUALIFY row_number() OVER (PARTITION BY s.query_id, s.anchor ORDER BY score DESC, n.node_id) <= 8)
 SELECT 1 AS levels, *, 1 AS level FROM one UNION ALL SELECT 2, *, 1 FROM one UNION ALL SELECT 2, *, 2 FROM two""")
def tree_expand_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From recalled chunks and the nearest papers, over one level and over two."""
    roots, sections, chunks = _tree(spark, sf_dir)
    queries = stash(_queries(spark, sf_dir), "queries")
    near = hierarchy._over_all(queries.where(F.size("papers") == 0), roots, 5).select("query_id", "node_id")
    hits = stash(hierarchy.recalled(queries, roots, sections, chunks).select("query_id", "node_id").unionByName(near), "hits")
    none = F.lit(None).cast("string")
    nodes = roots.select("node_id", none.alias("parent"), F.lit("root").alias("kind"), "text").unionByName(sections.select("node_id", F.col("paper").cast("string").alias("parent"), F.lit("section").alias("kind"), "text")).unionByName(chunks.select("node_id", "parent", F.lit("chunk").alias("kind"), "text"))
    return hierarchy.expanded_levels(queries, hits, nodes, 1).withColumn("levels", F.lit(1)).unionByName(hierarchy.expanded_levels(queries, hits, nodes, 2).withColumn("levels", F.lit(2)))


#: Documents as nodes of fifty papers: written, some papers replaced, some removed, one written again.
_COLLECTION = """d AS (SELECT doc_id % 50 AS paper, doc_id AS node_id, text FROM documents), fresh AS (SELECT * FROM d WHERE node_id % 3 = 2 AND paper < 20),
 a AS (SELECT * FROM d WHERE node_id % 3 < 2 AND paper NOT IN (SELECT paper FROM fresh) UNION ALL SELECT * FROM fresh), b AS (SELECT * FROM a WHERE paper % 10 <> 7 UNION ALL SELECT * FROM d WHERE paper = 7 AND node_id % 6 = 0)"""


def _collection(spark: SparkSession, sf_dir: str) -> Collection:
    d = texts(spark, sf_dir).select((F.col("doc_id") % 50).alias("paper"), F.col("doc_id").alias("node_id"), "text", hash_vector(F.col("text")).alias("vec"))
    held = Collection(spark, fresh_path(spark, "collection"), signature=Signature("hashing-64", 64, "chunks-1", "lines-1"))
    held.replace(d.where("node_id % 3 < 2"))
    held.replace(d.where("node_id % 3 = 2 and paper < 20"))
    held.delete(d.where("paper % 10 = 7"))
    held.compact()
    held.replace(d.where("paper = 7 and node_id % 6 = 0"))
    return held


@query(f"WITH {_COLLECTION} SELECT paper, node_id, sha256(text) AS text_sha256 FROM b")
def collection_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collection(spark, sf_dir).nodes().select("paper", "node_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {_COLLECTION}, q AS (SELECT item_id AS query_id, {_embedded('text')} AS v FROM benchmark), n AS (SELECT node_id, {_embedded('text')} AS v FROM b) SELECT query_id, n.node_id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n.node_id) AS rank FROM q, n QUALIFY rank <= 6")
def collection_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir).select("query_id", "qvec")
    return _collection(spark, sf_dir).similar(queries, 6)
