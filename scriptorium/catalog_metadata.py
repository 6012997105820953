"""Queries on what a paper says of itself, on the keyword pool by substrings, on chunks around atoms, on runs that a stop left behind and on restored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metadata
from .catalog_documents import _protected
from .operators import chunking, library, retrieval, runs
from .registry import DOC_TOKENS, ITEM_TOKENS, LINES, LOG, query, table, texts
from .sources import tables
from .storage import fresh_path


def first_pages(docs: DataFrame) -> DataFrame:
    """Documents as first pages: perhaps a venue, a title of one line or two, authors in four forms, a place, and what follows the abstract."""
    d = F.col("doc_id")
    line = lambda i, n: F.btrim(F.regexp_replace(F.substring(F.coalesce(F.get(F.split("text", "\n"), F.lit(i)), F.lit("")), 1, n), r"[^\p{L} ]", ""))
    venue = F.when(d % 3 == 0, "Proceedings of the meeting").when(d % 3 == 1, "12 - 14").otherwise("3 May 2021")
    who = F.when(d % 4 == 0, "Wenyu Tao1, Xiaofen Xing2 and Ann B. Lee*").when(d % 4 == 1, "Jo Ann Lee  Max Roe").when(d % 4 == 2, "Solo Name").otherwise("jo@x.org, Max Roe")
    place = F.when(d % 5 == 0, "  Some  University of X").otherwise("Somewhere, 3rd street, 12")
    tail = F.concat(F.lit("Abstract\n"), F.substring("text", 1, 200), F.when(d % 2 == 0, "\nKeywords: graph, retrieval; trees., graph").otherwise("\nINDEX TERMS — one; two"), F.when(d % 7 == 0, "\narXiv: 2405.01234v2").otherwise("\nsee 10.1000/abc.DEF(12);x)."))
    page = F.concat_ws("\n", venue, line(0, 60), F.when(d % 2 == 0, line(1, 30)), who, place, tail)
    return docs.select("doc_id", page.alias("page"))


_LINE = r"trim(regexp_replace(substr(coalesce(string_split(text, chr(10))[{i}], ''), 1, {n}), '[^\p{{L}} ]', '', 'g'), ' ')"
_NOISE = r"""({x} = '' OR regexp_matches(lower({x}), 'proceedings of|association for computational linguistics|copyright|©| pages |university|institute|school of|laboratory') OR contains({x}, '@') OR (length({x}) - length(replace({x}, ',', '')) >= 2 AND regexp_matches({x}, '\d'))
 OR regexp_matches(lower({x}), '\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b.*\b(?:19|20)\d{{2}}\b') OR regexp_full_match({x}, '[\d\W]+') AND NOT regexp_matches({x}, '\p{{L}}'))"""
_NAME = r"(len(list_filter(string_split({n}, ' '), lambda w: w <> '')) BETWEEN 2 AND 6 AND NOT regexp_matches({n}, '[@{{}}]') AND len(list_filter(string_split({n}, ' '), lambda w: w <> '' AND NOT regexp_matches(w, '\p{{L}}'))) = 0)"
_PARTS = r"list_filter(list_transform(regexp_split_to_array({x}, ',|\band\b'), lambda p: trim(p, ' ')), lambda p: p <> '')"
_BARE = r"trim(regexp_replace({p}, '[\d*†‡∗]+$', ''), ' ')"


def _author(x: str, following: str) -> str:
    parts = _PARTS.format(x=x)
    names = f"len(list_filter(list_transform({parts}, lambda p: {_BARE.format(p='p')}), lambda n: {_NAME.format(n='n')}))"
    return f"({x} <> '' AND NOT contains({x}, '@') AND NOT regexp_matches(lower({x}), 'university|institute|school|laboratory|college|department|proceedings|association|future house|align to innovate') AND {names} > 0 AND ({names} >= 2 AND len({parts}) > 1 OR regexp_matches(lower({following}), 'university|institute|school|laboratory|college|research|future house|align to innovate|department')))"


_PAGES = rf"""pg AS (SELECT doc_id, array_to_string(list_filter([CASE doc_id % 3 WHEN 0 THEN 'Proceedings of the meeting' WHEN 1 THEN '12 - 14' ELSE '3 May 2021' END, {_LINE.format(i=1, n=60)}, CASE doc_id % 2 WHEN 0 THEN {_LINE.format(i=2, n=30)} END,
  CASE doc_id % 4 WHEN 0 THEN 'Wenyu Tao1, Xiaofen Xing2 and Ann B. Lee*' WHEN 1 THEN 'Jo Ann Lee  Max Roe' WHEN 2 THEN 'Solo Name' ELSE 'jo@x.org, Max Roe' END, CASE doc_id % 5 WHEN 0 THEN '  Some  University of X' ELSE 'Somewhere, 3rd street, 12' END,
  'Abstract' || chr(10) || substr(text, 1, 200) || CASE doc_id % 2 WHEN 0 THEN chr(10) || 'Keywords: graph, retrieval; trees., graph' ELSE chr(10) || 'INDEX TERMS — one; two' END || CASE doc_id % 7 WHEN 0 THEN chr(10) || 'arXiv: 2405.01234v2' ELSE chr(10) || 'see 10.1000/abc.DEF(12);x).' END], lambda x: x IS NOT NULL), chr(10)) AS page FROM documents),
 l0 AS (SELECT doc_id, unnest(string_split(page, chr(10))) AS raw, generate_subscripts(string_split(page, chr(10)), 1) AS i FROM pg), l1 AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' ') AS x FROM l0 WHERE i <= 50),
 l2 AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY i), '') AS nx, coalesce(min(i) FILTER (lower(x) = 'abstract') OVER (PARTITION BY doc_id), 999) AS ab FROM l1),
 l3 AS (SELECT *, {_NOISE.format(x='x')} AS noise, {_author('x', 'nx')} AS who FROM l2 WHERE i < ab),
 l4 AS (SELECT *, NOT noise AND length(x) BETWEEN 8 AND 240 AND regexp_matches(x, '\p{{L}}') AND i <= 25 AS fits FROM l3),
 l5 AS (SELECT *, min(i) FILTER (fits) OVER (PARTITION BY doc_id) AS one FROM l4), l6 AS (SELECT *, coalesce(min(i) FILTER (i > one AND (noise OR who)) OVER (PARTITION BY doc_id), 999) AS stop FROM l5),
 ti AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS title FROM (SELECT * FROM l6 WHERE fits AND i < stop QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 3) GROUP BY doc_id),
 as1 AS (SELECT l3.*, coalesce(title, '') AS title, trim(coalesce(string_agg(CASE WHEN NOT noise THEN x END, ' ') OVER (PARTITION BY doc_id ORDER BY i), ''), ' ') AS sofar FROM l3 LEFT JOIN ti USING (doc_id)),
 as2 AS (SELECT *, coalesce(min(i) FILTER (NOT noise AND lower(sofar) = lower(title)) OVER (PARTITION BY doc_id), 999) AS eq FROM as1),
 as3 AS (SELECT *, coalesce(max(i) FILTER (NOT noise AND i <= eq AND contains(lower(title), lower(sofar))) OVER (PARTITION BY doc_id), 0) AS fin FROM as2),
 col AS (SELECT doc_id, i, k, c, CASE WHEN i + 1 < ab THEN nx ELSE '' END AS nx FROM (SELECT *, unnest(cs) AS c, generate_subscripts(cs, 1) AS k FROM (SELECT *, CASE WHEN len(list_filter(regexp_split_to_array(trim(raw, ' '), '\s\s+'), lambda p: p <> '')) > 1 THEN list_filter(regexp_split_to_array(trim(raw, ' '), '\s\s+'), lambda p: p <> '') ELSE [x] END AS cs FROM as3 WHERE i > fin))),
 nam AS (SELECT doc_id, i, k, unnest(ns) AS n, generate_subscripts(ns, 1) AS j FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(c, '\s*(?:,|;|\band\b)\s*'), lambda p: {_BARE.format(p='p')}), lambda n: n <> '' AND {_NAME.format(n='n')}) AS ns FROM col WHERE {_author('c', 'nx')})),
 who AS (SELECT doc_id, string_agg(n, '|' ORDER BY spot) AS authors FROM (SELECT doc_id, n, min((i, k, j)) AS spot FROM nam GROUP BY ALL) GROUP BY doc_id)"""


@query(rf"""WITH {_PAGES} SELECT pg.doc_id, title, coalesce(authors, '') AS authors, CASE doc_id % 2 WHEN 0 THEN 'graph|retrieval|trees' ELSE 'one|two' END AS keywords, rtrim(nullif(regexp_extract(page, '(?i)\b(10\.\d{{4,9}}/[-._;()/:A-Z0-9]+)', 1), ''), '.,;) ') AS doi, nullif(regexp_extract(page, '(?i)\barXiv:\s*(\d{{4}}\.\d{{4,5}})', 1), '') AS arxiv_id FROM pg LEFT JOIN ti USING (doc_id) LEFT JOIN who USING (doc_id)""")
def paper_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = first_pages(texts(spark, sf_dir)).withColumn("title", metadata.detected_title(F.col("page")))
    who = metadata.detected_authors(F.col("page"), F.coalesce("title", F.lit("")))
    return pages.select("doc_id", "title", F.array_join(who, "|").alias("authors"), F.array_join(metadata.keywords(F.col("page")), "|").alias("keywords"), F.inline(F.array(metadata.identifiers(F.col("page")))))


@query(f"""WITH tok AS ({DOC_TOKENS}), post AS (SELECT id AS node_id, term, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT doc_id AS node_id, count(term) AS dl FROM documents LEFT JOIN tok ON tok.id = doc_id GROUP BY ALL),
 terms AS (SELECT id AS query_id, term, n FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY min(ord)) AS n FROM ({ITEM_TOKENS}) GROUP BY id, term) WHERE n <= 12),
 pool AS (SELECT DISTINCT query_id, doc_id AS node_id FROM terms JOIN documents ON contains(text, term)), ps AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM pool JOIN len USING (node_id) GROUP BY ALL),
 hits AS (SELECT t.query_id, p.node_id, t.term, t.n AS ord, p.tf, len.dl FROM terms t JOIN post p USING (term) JOIN pool ON pool.query_id = t.query_id AND pool.node_id = p.node_id JOIN len ON len.node_id = p.node_id),
 df AS (SELECT query_id, term, count(*) AS df FROM hits GROUP BY ALL),
 raw AS (SELECT query_id, node_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw, string_agg(term, ' ' ORDER BY ord) AS matched_terms FROM hits JOIN ps USING (query_id) JOIN df USING (query_id, term) GROUP BY ALL)
 SELECT query_id, node_id, score, matched_terms, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT query_id, node_id, matched_terms, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM raw) QUALIFY rank <= 10""")
def pooled_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.pooled_top_k(table(spark, sf_dir, "benchmark"), texts(spark, sf_dir), "item_id", "doc_id")
    return found.withColumn("matched_terms", F.array_join("matched_terms", " "))


@query(rf"""WITH RECURSIVE {LINES}, blk AS (SELECT doc_id, ((ord - 1) // 10)::INT AS section, ord AS place, CASE (doc_id + ord) % 7 WHEN 3 THEN 'table' WHEN 5 THEN 'equation' ELSE 'text' END AS kind, line AS text FROM lines),
 rn AS (SELECT *, sum((kind <> 'text')::INT) OVER (PARTITION BY doc_id, section ORDER BY place) AS run FROM blk),
 cut AS (SELECT doc_id, section, run, place, string_split(regexp_replace({_protected('text')}, '([.!?。！？])\s+', '\1' || chr(2), 'g'), chr(2)) AS p FROM rn WHERE kind = 'text'),
 sen AS (SELECT doc_id, section, run, place, ord, replace(s, chr(1), '.') AS text FROM (SELECT * EXCLUDE (p), regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') AS s, generate_subscripts(p, 1) AS ord FROM cut) WHERE s <> ''),
 u0 AS (SELECT *, unnest(range(1, greatest(length(text), 1) + 1, 1800)) AS start FROM sen),
 u AS (SELECT doc_id, section, run, row_number() OVER (PARTITION BY doc_id, section, run ORDER BY place, ord, start) AS i, substr(text, start, 1800) AS text, length(substr(text, start, 1800)) AS len FROM u0),
 pack AS (SELECT doc_id, section, run, i, text, len AS cur, 1 AS pos FROM u WHERE i = 1 UNION ALL
  SELECT u.doc_id, u.section, u.run, u.i, u.text, CASE WHEN p.cur + 1 + u.len > 1800 THEN u.len ELSE p.cur + 1 + u.len END, p.pos + (p.cur + 1 + u.len > 1800)::INT FROM pack p JOIN u ON u.doc_id = p.doc_id AND u.section = p.section AND u.run = p.run AND u.i = p.i + 1),
 own AS (SELECT doc_id, section, run, pos, count(*) AS k, string_agg(text, ' ' ORDER BY i) AS t, arg_max(text, i) AS last FROM pack GROUP BY ALL),
 every AS (SELECT doc_id, section, run, pos, 'text' AS kind, k + (l IS NOT NULL)::INT AS units, coalesce(l || ' ', '') || t AS text FROM (SELECT *, lag(last) OVER (PARTITION BY doc_id, section, run ORDER BY pos) AS l FROM own) UNION ALL SELECT doc_id, section, run, 0, kind, 1, text FROM rn WHERE kind <> 'text')
 SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY run, pos) AS chunk, kind, units, sha256(text) AS text_sha256 FROM every""")
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines are a section; some stand for tables and equations."""
    lines, n = library.lines(texts(spark, sf_dir)), F.col("ord") + 1
    kind = F.when((F.col("doc_id") + n) % 7 == 3, "table").when((F.col("doc_id") + n) % 7 == 5, "equation").otherwise("text")
    blocks = lines.select("doc_id", F.floor(F.col("ord") / 10).cast("int").alias("section"), F.col("ord").alias("place"), kind.alias("kind"), F.col("line").alias("text"))
    return chunking.block_chunks(blocks).select("doc_id", "section", "chunk", "kind", "units", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {LOG}, e AS (SELECT run_id, arg_min(event_type, sequence) FILTER (event_type IN ('run.completed', 'run.failed')) AS finish, min(ts) FILTER (event_type IN ('run.completed', 'run.failed')) AS ended FROM log GROUP BY ALL)
 SELECT run_id, coalesce(replace(finish, 'run.', ''), 'cancelled') AS status, CASE WHEN finish IS NULL THEN 'Backend restarted before the run completed' END AS error, coalesce(ended, (SELECT max(ts) FROM events)) AS ended FROM e""")
def orphan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service starts again at the time of the last event."""
    events = table(spark, sf_dir, "events")
    log = runs.event_log(events)
    now = events.agg(F.max("ts").alias("now"))
    known = runs.finished(log).select("run_id", "status", F.lit(None).cast("string").alias("error"), "ended")
    return runs.orphans_ended(known.crossJoin(F.broadcast(now)), F.col("now")).drop("now")  # one row


@query("SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS rows, (SELECT count(*) FROM nation) AS restored, TRUE AS consistent UNION ALL SELECT 'conversations', (SELECT count(*) FROM conversations), (SELECT count(*) FROM conversations), TRUE UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), (SELECT count(*) FROM labels), TRUE")
def restored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "backup")
    tables.backup(spark, {name: table(spark, sf_dir, name) for name in ("nation", "conversations", "labels")}, folder)
    return tables.restore(spark, folder, fresh_path(spark, "restored"), force=True)
