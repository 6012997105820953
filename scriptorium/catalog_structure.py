"""Queries on the sections of plain texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import caption
from .operators import library, structure
from .registry import LINES, query, table, texts


def outlined(docs: DataFrame) -> DataFrame:
    """Documents as papers: every fifth line is a heading `1`, `1.1` ... with a title made of the line, others are hyphenated,
    emptied or kept, and an odd document begins with a named heading."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")

    def line(x, i):
        k = F.floor(i / 5)
        index = F.concat((k % 4 + 1).cast("string"), F.when(k % 3 > 0, F.concat(F.lit("."), (k % 3).cast("string"))).otherwise(""), F.when(k % 7 == 5, ".1.1").otherwise(""))
        head = F.concat(index, F.lit(" Section "), F.substring(x, 1, 40))
        return F.when(i % 5 == 0, head).when(i % 5 == 1, F.concat(x, F.lit("-"))).when(i % 5 == 3, "").otherwise(x)

    made = F.transform(lines, line)
    named = F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("Abstract:"))).otherwise(F.array().cast("array<string>"))
    plain = F.when(F.col("doc_id") % 5 == 4, F.transform(lines, lambda x: F.concat(F.lit("~ "), x))).otherwise(F.concat(named, made))
    return docs.select("doc_id", F.array_join(plain, "\n").alias("text"))


# The patterns of headings, in SQL: (doc_id, i, line) of the outlined documents, then their headings and sections.
OUTLINE = r"""src AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS ls FROM documents),
 made AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN list_transform(ls, lambda x: '~ ' || x) ELSE list_concat(CASE WHEN doc_id % 2 = 1 THEN ['Abstract:'] ELSE [] END, list_transform(ls, lambda x, i: CASE
 WHEN (i - 1) % 5 = 0 THEN ((i - 1) // 5 % 4 + 1) || CASE WHEN (i - 1) // 5 % 3 > 0 THEN '.' || ((i - 1) // 5 % 3) ELSE '' END || CASE WHEN (i - 1) // 5 % 7 = 5 THEN '.1.1' ELSE '' END || ' Section ' || substr(x, 1, 40)
 WHEN (i - 1) % 5 = 1 THEN x || '-' WHEN (i - 1) % 5 = 3 THEN '' ELSE x END)) END AS ls FROM src),
 txt AS (SELECT doc_id, string_split(array_to_string(ls, chr(10)), chr(10)) AS ls FROM made),
 lin AS (SELECT doc_id, trim(regexp_replace(unnest(ls), '\s+', ' ', 'g'), ' ') AS l, generate_subscripts(ls, 1) AS i FROM txt),
 num AS (SELECT *, regexp_extract(l, '^((?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3}))[.)]?\s+(\S.{1,159})$', 1) AS ix, regexp_extract(l, '^((?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3}))[.)]?\s+(\S.{1,159})$', 2) AS t FROM lin),
 nh AS (SELECT *, t <> '' AND NOT regexp_matches(ix, '^0*[1-9]\d+$') AND len(string_split(t, ' ')) <= 16 AND NOT regexp_matches(t, '[.!]$') AND NOT regexp_matches(t, '[←→∅∪=≤≥]') AND regexp_matches(t, '^\p{Lu}') AS numbered FROM num),
 hd AS (SELECT *, bool_or(numbered) OVER (PARTITION BY doc_id) AS anyn FROM nh),
 hh AS (SELECT *, numbered OR rtrim(lower(l), ':') IN ('abstract', 'references', 'limitations', 'acknowledgments') OR (NOT anyn AND rtrim(lower(l), ':') IN ('introduction', 'background', 'related work', 'method', 'methods', 'methodology', 'experiments', 'results', 'discussion', 'limitations', 'conclusion', 'conclusions', 'appendix')) AS head FROM hd),
 sn AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i)::INT AS n, max(head::INT) OVER (PARTITION BY doc_id) AS any_head FROM hh),
 sec AS (SELECT doc_id, n, CASE WHEN numbered THEN ix END AS "index", CASE WHEN numbered THEN t ELSE rtrim(l, ':') END AS title, CASE WHEN numbered THEN length(ix) - length(replace(ix, '.', '')) + 1 ELSE 1 END::INT AS level FROM sn WHERE head
 UNION ALL SELECT DISTINCT doc_id, 1, NULL, 'Document Body', 1 FROM sn WHERE any_head = 0),
 bod AS (SELECT doc_id, greatest(n, 1) AS n, string_agg(l, chr(10) ORDER BY i) AS b FROM sn WHERE NOT head AND (n > 0 OR any_head = 0) GROUP BY ALL),
 body AS (SELECT doc_id, n, replace(regexp_replace(regexp_replace(trim(regexp_replace(b, '-\n(\p{Ll})', '\1', 'g'), chr(10)), '\n\n+', chr(1), 'g'), '\n', ' ', 'g'), chr(1), chr(10) || chr(10)) AS body FROM bod)"""
_PARENTS = OUTLINE + """, par AS (SELECT s.*, CASE WHEN p.level = s.level - 1 THEN p.n END AS parent FROM sec s LEFT JOIN LATERAL (SELECT q.n, q.level FROM sec q WHERE q.doc_id = s.doc_id AND q.n < s.n AND q.level < s.level ORDER BY q.n DESC LIMIT 1) p ON TRUE)"""


@query(f"WITH {OUTLINE} SELECT sec.doc_id, sec.n, \"index\", title, level, sha256(coalesce(body, '')) AS body_sha256 FROM sec LEFT JOIN body USING (doc_id, n)")
def sections_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.parsed_sections(outlined(texts(spark, sf_dir)))
    return found.select("doc_id", "n", "index", "title", "level", F.sha2("body", 256).alias("body_sha256"))


@query(f"""WITH RECURSIVE {_PARENTS}, path AS (SELECT doc_id, n, parent, concat_ws(' ', "index", title) AS path FROM par WHERE parent IS NULL
 UNION ALL SELECT p.doc_id, p.n, p.parent, path.path || ' > ' || concat_ws(' ', p."index", p.title) FROM par p JOIN path ON path.doc_id = p.doc_id AND path.n = p.parent) SELECT * FROM path""")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.with_parents(structure.parsed_sections(outlined(texts(spark, sf_dir))))
    return found.select("doc_id", "n", "parent", F.array_join("path", " > ").alias("path"))


@query(f"WITH {_PARENTS} SELECT doc_id, parent, string_agg(n, ',' ORDER BY n) AS children FROM par GROUP BY ALL")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.with_parents(structure.parsed_sections(outlined(texts(spark, sf_dir))))
    return structure.children(found).select("doc_id", "parent", F.array_join("children", ",").alias("children"))


@query(f"WITH {OUTLINE} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ord, (sum(numbered::INT) OVER (PARTITION BY doc_id ORDER BY i))::INT AS section FROM nh WHERE l <> ''")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.assigned_lines(outlined(texts(spark, sf_dir)))


_BLOCKS = """blk AS (SELECT source, doc_id AS ord, CASE doc_id % 3 WHEN 0 THEN 'caption' ELSE 'object' END AS type, CASE doc_id % 2 WHEN 0 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 40)::VARCHAR END AS label FROM documents),
 lst AS (SELECT source, kind, label, max(ord) AS ord FROM blk WHERE type = 'object' AND label IS NOT NULL GROUP BY ALL)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as the blocks of a section: captions, tables and figures with labels."""
    d = F.col("doc_id")
    return texts(spark, sf_dir).select("source", d.alias("ord"), F.when(d % 3 == 0, "caption").otherwise("object").alias("type"), F.when(d % 2 == 0, "table").otherwise("figure").alias("kind"), F.when(d % 7 > 0, (d % 40).cast("string")).alias("label"))


@query(f"WITH {_BLOCKS} SELECT b.source, b.ord, c.caption_ord FROM blk b LEFT JOIN (SELECT l.source, l.ord, max(k.ord) AS caption_ord FROM lst l JOIN blk k ON k.type = 'caption' AND k.source = l.source AND k.kind = l.kind AND k.label = l.label GROUP BY ALL) c ON c.source = b.source AND c.ord = b.ord WHERE b.type = 'object'")
def caption_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.attached_captions(_blocks(spark, sf_dir), ["source"])[0].select("source", "ord", "caption_ord")


@query(f"WITH {_BLOCKS} SELECT source, ord, kind, label FROM blk k WHERE type = 'caption' AND NOT EXISTS (SELECT 1 FROM lst l WHERE l.source = k.source AND l.kind = k.kind AND l.label = k.label)")
def loose_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.attached_captions(_blocks(spark, sf_dir), ["source"])[1].select("source", "ord", "kind", "label")


@query(rf"""WITH {LINES}, c AS (SELECT doc_id, ord::INT - 1 AS ord, CASE ord % 3 WHEN 0 THEN 'Table' WHEN 1 THEN 'Extended Data Fig.' ELSE 'figures' END || ' ' || (doc_id % 30) || CASE WHEN ord % 2 = 0 THEN '.' || (ord % 9) ELSE '' END || ' ' || line AS l FROM lines),
 x AS (SELECT *, regexp_extract(l, '(?i)^\s*(?:extended\s+data\s+)?(table|figure|fig\.?)\s*([A-Z]?\d+(?:\.\d+)?)\b', 1) AS w, regexp_extract(l, '(?i)^\s*(?:extended\s+data\s+)?(table|figure|fig\.?)\s*([A-Z]?\d+(?:\.\d+)?)\b', 2) AS label FROM c)
 SELECT doc_id, ord, CASE WHEN lower(w) = 'table' THEN 'table' ELSE 'figure' END AS kind, label FROM x WHERE label <> ''""")
def caption_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines behind made-up captions; plurals are none."""
    n = F.col("ord") + 1
    word = F.when(n % 3 == 0, "Table").when(n % 3 == 1, "Extended Data Fig.").otherwise("figures")
    lines = library.lines(texts(spark, sf_dir))
    said = F.concat(word, F.lit(" "), (F.col("doc_id") % 30).cast("string"), F.when(n % 2 == 0, F.concat(F.lit("."), (n % 9).cast("string"))).otherwise(""), F.lit(" "), "line")
    return lines.select("doc_id", "ord", caption(said).alias("c")).where("c is not null").select("doc_id", "ord", "c.kind", "c.label")
