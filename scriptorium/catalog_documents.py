"""Queries on the structure of documents: sentences, chunks, line kinds, identifiers, replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import ABBREVIATIONS, doi, each, hash_vector, line_kind, paper_identifier, query_expression, semantic_role, sentences
from .operators import chunking, library
from .registry import DOC_TOKENS, LINES, query, table, texts

_SECTIONS = f"{LINES}, sec AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INT AS section, line AS text FROM lines)"


def _protected(column: str) -> str:
    for a in ABBREVIATIONS:
        column = f"regexp_replace({column}, '{a.replace('.', chr(92) + '.')}', '{a.replace('.', chr(1))}', 'gi')"
    return column


_SENTENCES = (
    f"{_SECTIONS}, cut AS (SELECT doc_id, section, string_split(regexp_replace({_protected('text')}, '([.!?。！？])\\s+', '\\1' || chr(2), 'g'), chr(2)) AS p FROM sec), "
    "sen AS (SELECT doc_id, section, ord, replace(s, chr(1), '.') AS text FROM (SELECT doc_id, section, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS s, generate_subscripts(p, 1) AS ord FROM cut) WHERE s <> '')"
)
_CHUNKS = f"""{_SENTENCES}, u0 AS (SELECT doc_id, section, ord AS sord, unnest(range(1, greatest(length(text), 1) + 1, 1800)) AS start, text FROM sen),
 u AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY sord, start) AS ord, substr(text, start, 1800) AS text, length(substr(text, start, 1800)) AS len FROM u0),
 pack AS (SELECT doc_id, section, ord, text, len AS cur, 1 AS chunk FROM u WHERE ord = 1 UNION ALL
 SELECT u.doc_id, u.section, u.ord, u.text, CASE WHEN p.cur + 1 + u.len > 1800 THEN u.len ELSE p.cur + 1 + u.len END, p.chunk + (p.cur + 1 + u.len > 1800)::INT FROM pack p JOIN u ON u.doc_id = p.doc_id AND u.section = p.section AND u.ord = p.ord + 1),
 own AS (SELECT doc_id, section, chunk, count(*) AS k, string_agg(text, ' ' ORDER BY ord) AS t, arg_max(text, ord) AS last FROM pack GROUP BY ALL),
 chunks AS (SELECT doc_id, section, chunk, (k + (l IS NOT NULL)::INT)::INT AS units, coalesce(l || ' ', '') || t AS text FROM (SELECT *, lag(last) OVER (PARTITION BY doc_id, section ORDER BY chunk) AS l FROM own))"""


@query(f"WITH {_SENTENCES} SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord)::INT AS n, text AS sentence FROM sen")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.section_rows(texts(spark, sf_dir))
    return each(rows, ["doc_id", "section"], sentences(F.col("text")), "pos", "sentence").select("doc_id", "section", (F.col("pos") + 1).alias("n"), "sentence")


@query(f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(texts(spark, sf_dir))


@query(f"""WITH RECURSIVE {_CHUNKS} SELECT printf('%d:section:%04d:chunk:%04d', c.doc_id, section, chunk) AS node_id, printf('%d:section:%04d', c.doc_id, section) AS parent_id, 2 AS level,
 substr(sha256(c.text), 1, 16) AS content_hash, sha256(substr(d.text, 1, 60) || chr(10) || substr(s.text, 1, 60) || chr(10) || c.text) AS embedding_sha256 FROM chunks c JOIN sec s USING (doc_id, section) JOIN documents d USING (doc_id)""")
def chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = chunking.chunk_nodes(texts(spark, sf_dir))
    return nodes.select("node_id", "parent_id", "level", "content_hash", F.sha2("embedding_text", 256).alias("embedding_sha256"))


@query(f"SELECT id AS doc_id, ('0x' || substr(md5(term), 31, 2))::INT % 64 AS dim, count(*)::DOUBLE AS weight FROM ({DOC_TOKENS}) GROUP BY ALL")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(texts(spark, sf_dir), ["doc_id"], hash_vector(F.col("text")), "dim", "weight").where("weight > 0")


# The patterns of a line's kind in SQL; l is the line with blanks collapsed.
KIND_SQL = r"""CASE WHEN regexp_matches(lower(l), '^(?:\d{1,4}|page\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*/\s*\d{1,4})$') THEN 'page number'
 WHEN contains(lower(l), 'nature | vol') OR contains(lower(l), 'proceedings of') OR contains(lower(l), 'arxiv preprint') OR lower(l) = 'article' THEN 'running matter'
 WHEN regexp_matches(l, '(?i)^\s*(?:extended\s+data\s+)?(?:table|figure|fig\.?)\s*[A-Z]?\d+(?:\.\d+)?\b') THEN 'caption'
 WHEN (regexp_extract(l, '^((?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3}))[.)]?\s+(\S.{1,159})$', 2) <> '' AND NOT regexp_matches(l, '^0*[1-9]\d+[.)]?\s')
 AND len(string_split(regexp_extract(l, '^((?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3}))[.)]?\s+(\S.{1,159})$', 2), ' ')) <= 16 AND NOT regexp_matches(l, '[.!]$')
 AND NOT regexp_matches(regexp_extract(l, '^((?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3}))[.)]?\s+(\S.{1,159})$', 2), '[←→∅∪=≤≥]') AND regexp_matches(regexp_extract(l, '^((?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3}))[.)]?\s+(\S.{1,159})$', 2), '^\p{Lu}'))
 OR rtrim(lower(l), ':') IN ('abstract', 'introduction', 'background', 'related work', 'method', 'methods', 'methodology', 'experiments', 'results', 'discussion', 'limitations', 'conclusion', 'conclusions', 'acknowledgments', 'references', 'appendix') THEN 'heading'
 WHEN length(l) <= 300 AND (len(regexp_extract_all(l, '[=≤≥∑∏∫√∞λθαβγμσ±×÷∈∉∪∩→←]')) >= 2 OR (len(regexp_extract_all(l, '[=≤≥∑∏∫√∞λθαβγμσ±×÷∈∉∪∩→←]')) >= 1 AND regexp_matches(l, '\([A-Z]?\d+(?:\.\d+)?\)\s*$'))) THEN 'equation' ELSE 'text' END"""


@query(f"WITH {LINES}, h AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ') AS l FROM lines) SELECT doc_id, ord::INT - 1 AS ord, {KIND_SQL} AS kind FROM h")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.lines(texts(spark, sf_dir)).select("doc_id", "ord", line_kind(F.col("line")).alias("kind"))


@query("""SELECT page_id, CASE WHEN regexp_matches(h, 'abstract') THEN 'abstract' WHEN regexp_matches(h, 'introduction|overview') THEN 'introduction' WHEN regexp_matches(h, 'related work|background|prior work') THEN 'related_work'
 WHEN regexp_matches(h, 'method|approach|architecture|implementation') THEN 'methods' WHEN regexp_matches(h, 'experiment|evaluation|benchmark|setup') THEN 'experiments' WHEN regexp_matches(h, 'result|analysis|finding') THEN 'results'
 WHEN regexp_matches(h, 'limitation|threats to validity') THEN 'limitations' WHEN regexp_matches(h, 'discussion') THEN 'discussion' WHEN regexp_matches(h, 'conclusion|future work') THEN 'conclusion'
 WHEN regexp_matches(h, 'references|bibliography') THEN 'references' WHEN regexp_matches(h, 'appendix|supplement') THEN 'appendix' END AS role FROM (SELECT page_id, lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS h FROM pages)""")
def section_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = library.html_headings(table(spark, sf_dir, "pages"))
    return headings.select("page_id", semantic_role(F.col("heading")).alias("role"))


@query(r"""SELECT doc_id, nullif(regexp_replace(regexp_extract(text, '(10\.\d{4,9}/[^\s"<>]+)', 1), '[.,;)\]]+$', ''), '') AS doi, nullif(regexp_extract(text, '(?:^|[^\d])(\d{4}\.\d{4,5})(?:[vV]\d+)?(?:[^\d]|$)', 1), '') AS arxiv_id FROM documents""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", doi(F.col("text")).alias("doi"), paper_identifier(F.col("text")).alias("arxiv_id"))


@query("""SELECT item_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '("[^"]+"|[^\\s"()]+)', 1), lambda p: upper(p) NOT IN ('AND', 'OR', 'NOT')), lambda p: 'all:' || p), ' AND ') AS expression FROM benchmark""".replace("\\\\", "\\"))
def query_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", query_expression(F.col("text")).alias("expression"))


@query("SELECT doc_id, array_to_string(w, ' ') AS abstract FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents) WHERE len(w) > 0")
def abstract_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.rebuilt(library.inverted(texts(spark, sf_dir)))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM lines)
 SELECT printf('%d:section:%04d', n.doc_id, n) AS node_id, n.doc_id, substr(sha256(CASE WHEN l.doc_id IS NULL THEN line ELSE 'v2 ' || line END), 1, 16) AS content_hash, l.doc_id IS NOT NULL AS replaced
 FROM n LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = n.doc_id WHERE l.doc_id IS NULL OR n <= 3""")
def replace_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents come again with a mark and three sections only: their old nodes go, also the stale ones."""
    docs, labels = texts(spark, sf_dir), table(spark, sf_dir, "labels")
    old = library.section_nodes(docs)
    fresh = library.section_nodes(docs.join(labels.where("quality = 1"), "doc_id", "left_semi")).where("n <= 3").withColumn("line", F.concat(F.lit("v2 "), F.col("line")))
    both = library.replaced(old.withColumn("replaced", F.lit(False)), fresh.withColumn("replaced", F.lit(True)), "doc_id")
    return both.select("node_id", "doc_id", F.substring(F.sha2("line", 256), 1, 16).alias("content_hash"), "replaced")


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 'REBUILD' WHEN quality IS NULL THEN 'unknown-fingerprint' ELSE 'ok' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.index_status(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def unknown_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.unknown(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")
