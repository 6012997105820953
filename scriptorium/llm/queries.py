"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, conversations, decontaminate, langid, lexical, line_dedup, ngram_join, packing, pii, quality, rlz, syncmers, warc
from .shared import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"))
    return back.select(F.expr("try_cast(page_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"), "intact")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), s AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  TRUE AS intact
FROM s
"""


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), n=4, t=85)


def op3_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS k, ws FROM w WHERE len(ws) >= 20),
 key AS (SELECT doc_id, k, sha256(array_to_string(ws[k:k + 19], ' ')) AS h FROM win),
 late AS (SELECT doc_id, k FROM key QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, k) > 1),
 gone AS (SELECT DISTINCT doc_id, k + d AS k FROM late, (SELECT unnest(range(0, 20)) AS d)),
 g AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id),
 word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS k FROM w),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality is not null").where(crc_mod(F.col("doc_id"), 3) != 1)
    model = quality.fit(docs, labels)
    return quality.score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op5_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edits(_table(spark, sf_dir, "documents"))


def op7_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_rmq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
 tok AS (SELECT r, doc_id, unnest(ws) AS w FROM t), tot AS (SELECT count(*)::BIGINT AS nd, sum(len(ws))::BIGINT AS l FROM t WHERE len(ws) > 0),
 item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
 post AS (SELECT r, doc_id, w, count(*)::BIGINT AS tf FROM tok WHERE w IN (SELECT w FROM item) GROUP BY ALL),
 wgt AS (SELECT w, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS wt FROM post, tot GROUP BY w, nd),
 m AS (SELECT r, (100 - 50 + ((50 * len(ws) * nd) // l))::BIGINT AS m FROM t, tot WHERE len(ws) > 0),
 imp AS (SELECT r, doc_id, w, wt * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS i FROM post JOIN wgt USING (w) JOIN m USING (r)),
 sc AS (SELECT item_id, r, doc_id, sum(i)::BIGINT AS score FROM item JOIN imp USING (w) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM sc WHERE score > 0 QUALIFY rank <= 50
"""


def op12_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversations.repaired(conversations.damaged(_table(spark, sf_dir, "conversations")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return out.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("turns")


#: The dynamic programme row by row instead of by halves; crc32 bit by bit.
OP12_SQL = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 how AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS h FROM src),
 dmg AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM how),
 seq AS (SELECT *, (row_number() OVER w)::INT AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, lag(role) OVER w AS prev FROM dmg WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
 fault AS (SELECT *, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS f FROM seq),
 tot AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, (count(*) FILTER (f = 'b'))::BIGINT AS blank, (count(*) FILTER (f = 'd'))::BIGINT AS duplicate, (count(*) FILTER (f = 't'))::BIGINT AS truncated,
  (count(*) FILTER (prev IS NOT NULL AND substr(prev, 1, 1) || r NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal, max(i) AS n FROM fault GROUP BY conv_id),
 -- v: for each state (0 nothing yet, 1 after system, 2 after user, 3 after assistant) the cheapest, least audit and what it gives
 dp(conv_id, i, v) AS (SELECT DISTINCT conv_id, 0, [{c: 0, a: '', s: 0, o: []::VARCHAR[]}] FROM src
 UNION ALL SELECT conv_id, i, list_filter([list_sort(list_filter(x, lambda e: e.s = 0))[1], list_sort(list_filter(x, lambda e: e.s = 1))[1], list_sort(list_filter(x, lambda e: e.s = 2))[1], list_sort(list_filter(x, lambda e: e.s = 3))[1]], lambda e: e IS NOT NULL)
  FROM (SELECT dp.conv_id, fault.i, list_concat(
    list_transform(w, lambda e: {c: e.c + 4, a: e.a || 'D', s: e.s, o: e.o}),
    CASE WHEN f IN ('b', 'd') THEN [] ELSE list_concat(
     list_transform(list_filter(w, lambda e: (e.s::VARCHAR || r) IN ('0s', '0u', '1u', '3u', '2a')), lambda e: {c: e.c + 3 * (f = 't')::INT, a: e.a || 'K', s: CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, o: list_append(e.o, role || ':' || text)}),
     list_transform(w, lambda e: {c: e.c + 3 + 3 * (f = 't')::INT, a: e.a || 'R', s: CASE e.s WHEN 2 THEN 3 ELSE 2 END, o: list_append(e.o, CASE e.s WHEN 2 THEN 'assistant:' ELSE 'user:' END || text)})) END) AS x
   FROM (SELECT conv_id, i, list_concat(y, list_transform(z, lambda e: {c: e.c + 3, a: e.a || 'I', s: CASE e.s WHEN 2 THEN 3 ELSE 2 END, o: list_append(e.o, CASE e.s WHEN 2 THEN 'assistant:' ELSE 'user:' END)})) AS w
     FROM (SELECT conv_id, i, list_concat(v, z) AS y, z FROM (SELECT conv_id, i, v, list_transform(v, lambda e: {c: e.c + 3, a: e.a || 'I', s: CASE e.s WHEN 2 THEN 3 ELSE 2 END, o: list_append(e.o, CASE e.s WHEN 2 THEN 'assistant:' ELSE 'user:' END)}) AS z FROM dp))) dp
   JOIN fault ON fault.conv_id IS NOT DISTINCT FROM dp.conv_id AND fault.i = dp.i + 1)),
 ends AS (SELECT dp.conv_id, list_sort(list_filter(list_concat(v, list_transform(list_filter(v, lambda e: e.s = 2), lambda e: {c: e.c + 3, a: e.a || 'I', s: 3, o: list_append(e.o, 'assistant:')}), list_transform(list_filter(v, lambda e: e.s = 1), lambda e: {c: e.c + 6, a: e.a || 'II', s: 3, o: list_concat(e.o, ['user:', 'assistant:'])})), lambda e: e.s IN (0, 3)))[1] AS e
  FROM dp LEFT JOIN tot ON tot.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(tot.n, 0))
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.c::BIGINT AS cost, e.a AS audit, sha256(array_to_string(e.o, chr(10))) AS repaired_sha256
FROM ends LEFT JOIN tot ON tot.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.report(_table(spark, sf_dir, "documents"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH lines AS (SELECT rowid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT row_number() OVER () AS rowid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
 keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
 common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rowid) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (k IN (FROM common)))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k NOT IN (FROM common)), '')) AS kept_sha256 FROM keyed GROUP BY rowid, doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_segments, op2_ngram_jaccard, op3_relative_lz, op4_attention_quality, op5_bwt_merge, op6_closed_syncmers, op7_zstd_language, op8_anchor_pii, op9_fm_decontamination, op10_best_fit_packing, op11_rmq_search, op12_hirschberg_repair, op13_line_runs)
}
ORACLE_SQL: dict[str, str] = {"op1_warc_segments": OP1_SQL, "op3_relative_lz": OP3_SQL, "op11_rmq_search": OP11_SQL, "op12_hirschberg_repair": OP12_SQL, "op13_line_runs": OP13_SQL}
