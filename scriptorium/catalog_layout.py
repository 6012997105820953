"""Queries on page layout: joins by position, reading order, merged lines, paragraphs, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import NAMED_HEADINGS, ROLES
from .operators import layout, library
from .registry import LINES, query, texts

WIDTH, HEIGHT, SLOTS = 600.0, 800.0, 40


def laid_out(docs: DataFrame) -> DataFrame:
    """A document's lines on pages of forty places: two pages of three have two columns with a title and a parting line, the third has one.

    Ids and places decide what a line is: numbered titles, captions with what continues them, numbers detached from their titles,
    formulas, lower-cased and hyphenated text; and its fonts.
    """
    rows = library.lines(docs).select("doc_id", "ord", "line", (F.floor(F.col("ord") / SLOTS) + 1).cast("int").alias("page"), (F.col("ord") % SLOTS).alias("s"))
    rows = rows.select("*", ((F.col("doc_id") * 7 + F.col("ord") * 13) % 11).alias("k"), ((F.col("doc_id") + F.col("ord")) % 9).alias("kind"), ((F.col("doc_id") + F.col("page")) % 3 > 0).alias("two"))
    k, kind, s, two, line = (F.col(c) for c in ("k", "kind", "s", "two", "line"))
    part = lambda at, n: F.substring(line, at, n)
    number = F.concat((k % 5 + 1).cast("string"), F.when(k % 2 == 1, F.concat(F.lit("."), (k % 4).cast("string"))).otherwise(""))
    text = (
        F.when(kind == 0, F.concat(number, F.lit(" "), part(1, 24))).when(kind == 1, F.concat(F.when(k % 2 == 0, "Figure ").otherwise("Table "), k.cast("string"), F.lit(": "), part(1, 40)))
        .when(kind == 2, part(1, 30)).when(kind == 3, F.when(k == 4, "Related Work").when(k % 3 == 1, "Algorithm of it").otherwise(part(1, 20))).when(kind == 4, number).when(kind == 5, part(1, 30))
        .when(kind == 6, F.concat(F.lit("x = y + "), k.cast("string"), F.lit(" ("), k.cast("string"), F.lit(")"))).when(kind == 7, F.lower(part(5, 60))).otherwise(F.concat(part(1, 80), F.when(k % 2 == 0, "-").otherwise("")))
    )
    wide = two & s.isin(0, 19)
    slot = F.when(kind == 5, F.greatest(s - 1, F.lit(0))).otherwise(s)
    y0 = F.when(two & (s == 0), 30.0).when(wide, 240.0 + 5 * (F.col("doc_id") % 2)).when(two & (s < 19), 60.0 + 19 * (slot - 1)).when(two, 60.0 + 19 * (slot - 20)).otherwise(30.0 + 19 * slot)
    x0 = F.when(wide | ~two, 50.0).when(s < 19, 50.0).otherwise(310.0) + F.when((kind == 5) & ~wide, 25.0).otherwise(0.0) + F.when(k == 9, 14.0).otherwise(0.0)
    x1 = F.when(wide, 550.0).when(kind == 4, x0 + 20).when(two, x0 + 130 + 8 * k).otherwise(x0 + 120 + 30 * k)
    base = F.when((kind == 0) & (k % 3 == 0), 14.0).when(kind.isin(0, 3, 4), 12.0).when(kind == 6, 8.0).otherwise(10.0)
    bold = kind.isin(0, 3) & (k != 6)
    half = F.floor(F.length("text") / 2).cast("int")
    span = lambda t, size, b: F.struct(t.alias("text"), size.alias("size"), b.alias("bold"), (kind == 7).alias("italic"))
    spans = F.array(span(F.substring(F.col("text"), F.lit(1), half), base, bold), span(F.substring(F.col("text"), half + 1, F.length("text")), base - 0.5 * (k % 2), bold & (k != 2)))
    rows = rows.select("*", F.btrim(text).alias("text"), y0.alias("y0"), x0.alias("x0"), x1.alias("x1")).where("text <> ''")
    return rows.select("doc_id", "page", "ord", "text", "x0", "y0", "x1", (F.col("y0") + 12).alias("y1"), F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height"), spans.alias("spans"), F.floor(s / 4).alias("block"))


#: The same lines in SQL, with font, bold and italic.
LAY = LINES + rf""", l0 AS (SELECT doc_id, (ord - 1)::INT AS ord, line, ((ord - 1) // 40 + 1)::INT AS page, (ord - 1) % 40 AS s FROM lines),
 l1 AS (SELECT *, (doc_id * 7 + ord * 13) % 11 AS k, (doc_id + ord) % 9 AS kind, (doc_id + page) % 3 > 0 AS two FROM l0),
 l2 AS (SELECT *, (k % 5 + 1) || CASE WHEN k % 2 = 1 THEN '.' || (k % 4) ELSE '' END AS num, two AND s IN (0, 19) AS wide, CASE kind WHEN 5 THEN greatest(s - 1, 0) ELSE s END AS slot FROM l1),
 l3 AS (SELECT *, trim(CASE kind WHEN 0 THEN num || ' ' || substr(line, 1, 24) WHEN 1 THEN CASE k % 2 WHEN 0 THEN 'Figure ' ELSE 'Table ' END || k || ': ' || substr(line, 1, 40) WHEN 2 THEN substr(line, 1, 30)
  WHEN 3 THEN CASE k WHEN 4 THEN 'Related Work' ELSE CASE WHEN k % 3 = 1 THEN 'Algorithm of it' ELSE substr(line, 1, 20) END END WHEN 4 THEN num WHEN 5 THEN substr(line, 1, 30) WHEN 6 THEN 'x = y + ' || k || ' (' || k || ')' WHEN 7 THEN lower(substr(line, 5, 60)) ELSE substr(line, 1, 80) || CASE k % 2 WHEN 0 THEN '-' ELSE '' END END, ' ') AS text,
  CASE WHEN two AND s = 0 THEN 30 WHEN wide THEN 240 + 5 * (doc_id % 2) WHEN two AND s < 19 THEN 60 + 19 * (slot - 1) WHEN two THEN 60 + 19 * (slot - 20) ELSE 30 + 19 * slot END::DOUBLE AS y0,
  (CASE WHEN wide OR NOT two OR s < 19 THEN 50 ELSE 310 END + CASE WHEN kind = 5 AND NOT wide THEN 25 ELSE 0 END + CASE k WHEN 9 THEN 14 ELSE 0 END)::DOUBLE AS x0 FROM l2),
 l4 AS (SELECT *, CASE WHEN wide THEN 550 WHEN kind = 4 THEN x0 + 20 WHEN two THEN x0 + 130 + 8 * k ELSE x0 + 120 + 30 * k END::DOUBLE AS x1, y0 + 12 AS y1,
  CASE WHEN kind = 0 AND k % 3 = 0 THEN 14 WHEN kind IN (0, 3, 4) THEN 12 WHEN kind = 6 THEN 8 ELSE 10 END::DOUBLE AS base, kind IN (0, 3) AND k <> 6 AS b1, s // 4 AS block, length(trim(substr(text, 1, length(text) // 2), ' ')) AS n1, length(trim(substr(text, length(text) // 2 + 1), ' ')) AS n2 FROM l3 WHERE text <> ''),
 lay AS (SELECT doc_id, page, ord, text, x0, y0, x1, y1, block, base, k, n1, n2, base - 0.5 * (k % 2) AS base2, CASE WHEN k % 2 = 1 AND greatest(n2, 1) > greatest(n1, 1) THEN base - 0.5 ELSE base END::DOUBLE AS font,
  n1 + n2 > 0 AND (n1 * b1::INT + n2 * (b1 AND k <> 2)::INT) / greatest(n1 + n2, 1) >= 0.8::DOUBLE AS bold, kind = 7 AS italic FROM l4)"""
_NUMBER = r"'^((?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3}))[.)]?\s+(\S.{1,159})$'"


def _numbered(text: str) -> str:
    """Whether a line is a numbered heading, in SQL."""
    i, t = f"regexp_extract({text}, {_NUMBER}, 1)", f"rtrim(regexp_extract({text}, {_NUMBER}, 2), ' ')"
    return rf"({t} <> '' AND NOT regexp_matches({i}, '^0*[1-9]\d+$') AND len(list_filter(string_split({t}, ' '), lambda w: w <> '')) <= 16 AND NOT regexp_matches({t}, '[.!]$') AND NOT regexp_matches({t}, '[←→∅∪=≤≥]') AND regexp_matches({t}, '^\p{{Lu}}'))"


def _caption(text: str) -> str:
    return rf"regexp_matches({text}, '(?i)^\s*(?:extended\s+data\s+)?(?:table|figure|fig\.?)\s*[A-Z]?\d+(?:\.\d+)?\b')"


def _equation(text: str) -> str:
    n = rf"len(regexp_extract_all({text}, '[=≤≥∑∏∫√∞λθαβγμσ±×÷∈∉∪∩→←]'))"
    return rf"(length({text}) <= 300 AND ({n} >= 2 OR ({n} >= 1 AND regexp_matches({text}, '\([A-Z]?\d+(?:\.\d+)?\)\s*$'))))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid_out(texts(spark, sf_dir))


def _boxes(lines: DataFrame) -> DataFrame:
    """Four boxes on every page, in places that depend on the document."""
    d, i = F.col("doc_id"), F.col("ord")
    pages = lines.select(*layout.PAGE, "page_width", "page_height").distinct().withColumn("ord", F.explode(F.array(*map(F.lit, range(4)))))
    x0, y0 = 20.0 + 140 * (i % 3) + 10 * (d % 7), 50.0 + 90 * i + 30 * (d % 5)
    return pages.select("*", F.when(i % 2 == 0, "table").otherwise("figure").alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + 150 + 40 * (i % 2) + 30 * (d % 4)).alias("x1"), (y0 + 60 + 25 * (d % 3)).alias("y1"))


_BOXES = """, box AS (SELECT *, x0 + 150 + 40 * (ord % 2) + 30 * (doc_id % 4) AS x1, y0 + 60 + 25 * (doc_id % 3) AS y1 FROM (SELECT doc_id, page, ord, CASE ord % 2 WHEN 0 THEN 'table' ELSE 'figure' END AS kind,
 (20 + 140 * (ord % 3) + 10 * (doc_id % 7))::DOUBLE AS x0, (50 + 90 * ord + 30 * (doc_id % 5))::DOUBLE AS y0 FROM (SELECT DISTINCT doc_id, page FROM lay), range(4) r(ord)))"""
_HELD = "l.doc_id = b.doc_id AND l.page = b.page AND l.x0 >= b.x0 - 2 AND l.x1 <= b.x1 + 2 AND l.y0 >= b.y0 - 2 AND l.y1 <= b.y1 + 2"
_CENTRE = "l.doc_id = b.doc_id AND l.page = b.page AND (l.x0 + l.x1) / 2 BETWEEN b.x0 AND b.x1 AND (l.y0 + l.y1) / 2 BETWEEN b.y0 AND b.y1"


@query(f"WITH {LAY}{_BOXES} SELECT l.doc_id, l.page, l.ord, b.ord::INT AS box FROM lay l JOIN box b ON {_HELD}")
def boxed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.in_boxes(lines, _boxes(lines)).select("doc_id", "page", "ord", "box")


@query(rf"WITH {LAY}{_BOXES} SELECT l.doc_id, l.page, b.ord::INT AS box, sha256(string_agg(l.text, chr(10) ORDER BY l.ord)) AS text_sha256 FROM lay l JOIN box b ON {_HELD} GROUP BY ALL HAVING bool_or(regexp_matches(l.text, '(?i)^(algorithm|procedure|function)\b'))")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.code_blocks(lines, _boxes(lines)).select("doc_id", "page", "box", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {LAY}{_BOXES} SELECT doc_id, page, ord FROM lay l WHERE EXISTS (SELECT 1 FROM box b WHERE {_CENTRE})")
def object_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.inside_objects(lines, _boxes(lines)).select("doc_id", "page", "ord")


@query(f"WITH {LAY}{_BOXES} SELECT doc_id, page, ord FROM lay l WHERE NOT EXISTS (SELECT 1 FROM box b WHERE {_CENTRE})")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.inside_objects(lines, _boxes(lines), "left_anti").select("doc_id", "page", "ord")


@query(f"""WITH {LAY}{_BOXES}, img AS (SELECT doc_id, page, ord, x0 + 25 * (ord % 2) AS x0, y0 - 20 AS y0, x1 + 60 AS x1, y1 AS y1 FROM box), p AS (SELECT f.doc_id, f.page, f.ord, i.ord AS image, greatest(least(f.x1, i.x1) - greatest(f.x0, i.x0), 0) * greatest(least(f.y1, i.y1) - greatest(f.y0, i.y0), 0) AS area FROM box f JOIN img i USING (doc_id, page) WHERE f.kind = 'figure')
 SELECT f.doc_id, f.page, f.ord::INT AS ord, b.image::INT AS image FROM box f LEFT JOIN (SELECT * FROM p WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY area DESC, image) = 1) b USING (doc_id, page, ord) WHERE f.kind = 'figure'""")
def figure_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and the images of their page; the images are the boxes, moved and wider."""
    boxes = _boxes(_lines(spark, sf_dir))
    images = boxes.select("doc_id", "page", "ord", (F.col("x0") + 25 * (F.col("ord") % 2)).alias("x0"), (F.col("y0") - 20).alias("y0"), (F.col("x1") + 60).alias("x1"), "y1", "page_width", "page_height")
    return layout.matched_images(boxes.where("kind = 'figure'"), images).select("doc_id", "page", "ord", "image")


@query(rf"""WITH {LAY}{_BOXES}, cap AS (SELECT *, CASE lower(regexp_extract(text, '(?i)^\s*(table|figure|fig)', 1)) WHEN 'table' THEN 'table' ELSE 'figure' END AS kind FROM lay WHERE {_caption('text')}),
 near AS (SELECT b.doc_id, b.page, b.ord, c.ord AS caption_ord, least(abs(c.y0 - b.y1), abs(b.y0 - c.y1)) AS d FROM box b JOIN cap c USING (doc_id, page, kind) QUALIFY row_number() OVER (PARTITION BY b.doc_id, b.page, b.ord ORDER BY d, c.ord) = 1)
 SELECT b.doc_id, b.page, b.ord::INT AS ord, n.caption_ord, n.d AS distance FROM box b LEFT JOIN (SELECT * FROM near WHERE d <= 800 * 0.15::DOUBLE) n USING (doc_id, page, ord)""")
def nearest_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.nearest_captions(_boxes(lines), layout.captions_of(lines)).select("doc_id", "page", "ord", "caption_ord", "distance")


#: Reading order by parting lines and the bands between them.
_ORDERED = LAY + """, sided AS (SELECT *, x1 - x0 < 600 * 0.62::DOUBLE AND x1 <= 300 * 1.08::DOUBLE AS l, x1 - x0 < 600 * 0.62::DOUBLE AND x0 >= 300 * 0.92::DOUBLE AS r FROM lay),
 pg AS (SELECT doc_id, page, count(*) FILTER (l) >= 4 AND count(*) FILTER (r) >= 4 AS two FROM sided GROUP BY ALL),
 sep AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord) AS j FROM sided JOIN pg USING (doc_id, page) WHERE two AND NOT l AND NOT r),
 band AS (SELECT doc_id, page, j, coalesce(lag(y1) OVER w, '-inf'::DOUBLE) AS lower, y0 AS upper FROM sep WINDOW w AS (PARTITION BY doc_id, page ORDER BY j)
  UNION ALL SELECT doc_id, page, coalesce(max(j), 0) + 1, coalesce(arg_max(y1, j), '-inf'::DOUBLE), 'inf'::DOUBLE FROM pg LEFT JOIN sep USING (doc_id, page) WHERE pg.two GROUP BY doc_id, page),
 keyed AS (SELECT s.doc_id, s.page, s.ord, s.y0, b.j AS k1, 0 AS k2, 0 AS k3, s.y0 AS k4, 0::DOUBLE AS k5 FROM sided s JOIN band b ON b.doc_id = s.doc_id AND b.page = s.page AND s.y0 >= lower AND s.y0 < upper WHERE s.l
  UNION ALL SELECT s.doc_id, s.page, s.ord, s.y0, b.j, 0, 1, s.y0, 0 FROM sided s JOIN band b ON b.doc_id = s.doc_id AND b.page = s.page AND s.y0 >= lower AND s.y0 < upper WHERE s.r
  UNION ALL SELECT doc_id, page, ord, y0, j, 1, 0, 0, 0 FROM sep UNION ALL SELECT doc_id, page, ord, y0, 0, 0, 0, y0, x0 FROM sided JOIN pg USING (doc_id, page) WHERE NOT two),
 placed AS (SELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY k1, k2, k3, k4, k5, ord)::INT AS place FROM keyed),
 read AS (SELECT *, coalesce(greatest(y0 - lag(y1) OVER (PARTITION BY doc_id, page, x0 < 300 ORDER BY place), 0), 0) AS gap FROM placed JOIN lay USING (doc_id, page, ord))"""


@query(f"WITH {_ORDERED} SELECT doc_id, page, ord, place, gap AS gap_before FROM read")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_lines(spark, sf_dir)).select("doc_id", "page", "ord", "place", "gap_before")


@query(f"WITH {LAY}, sz AS (SELECT doc_id, unnest([base, base2]) AS size, unnest([n1, n2]) AS n, page, ord, unnest([0, 1]) AS i FROM lay WHERE y0 BETWEEN 32 AND 768) SELECT doc_id, arg_min(size, (-n, first))::DOUBLE AS body FROM (SELECT doc_id, size, sum(n) AS n, min((page, ord, i)) AS first FROM sz GROUP BY ALL) GROUP BY doc_id")
def body_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_fonts(_lines(spark, sf_dir))


@query(f"WITH {LAY} SELECT doc_id, page, ord, font, bold, italic FROM lay")
def line_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.styled(_lines(spark, sf_dir)).select("doc_id", "page", "ord", "font", "bold", "italic")


_NAMES = ", ".join(f"'{n}'" for n in NAMED_HEADINGS)
_SCORED = _ORDERED + rf""", sz AS (SELECT doc_id, unnest([base, base2]) AS size, unnest([n1, n2]) AS n, page, ord, unnest([0, 1]) AS i FROM lay WHERE y0 BETWEEN 32 AND 768),
 bod AS (SELECT doc_id, arg_min(size, (-n, first))::DOUBLE AS body FROM (SELECT doc_id, size, sum(n) AS n, min((page, ord, i)) AS first FROM sz GROUP BY ALL) GROUP BY doc_id),
 q0 AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM read),
 q1 AS (SELECT *, coalesce(body, 10) AS b, font / greatest(coalesce(body, 10), 0.1) AS ratio, {_numbered('t')} AS numbered, rtrim(lower(t), ':') IN ({_NAMES}) AS named, len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS words, regexp_replace(t, '[^\p{{L}}]', '', 'g') AS letters, count(*) OVER (PARTITION BY doc_id, font, bold, italic, round_even(x0 / 12, 0)) AS alike FROM q0 LEFT JOIN bod USING (doc_id)),
 scored AS (SELECT *, CASE WHEN ratio >= 1.14::DOUBLE THEN 3 WHEN ratio >= 1.04::DOUBLE THEN 1 ELSE 0 END + 2 * bold::INT + 3 * numbered::INT + 3 * named::INT + 2 * (gap >= b * 0.8::DOUBLE)::INT + (alike BETWEEN 2 AND 80)::INT + (length(t) <= 100)::INT AS score FROM q1
  WHERE length(t) BETWEEN 3 AND 180 AND words <= 22 AND letters <> '' AND font >= b * 0.8::DOUBLE AND NOT {_caption('t')} AND NOT {_equation('t')} AND NOT regexp_matches(t, '[.!;-]$') AND NOT (contains(t, '. ') AND words > 8) AND (numbered OR named OR length(t) <= 75) AND NOT (numbered AND ratio < 1.02::DOUBLE AND NOT bold AND upper(letters) <> letters))"""


@query(f"WITH {_SCORED} SELECT doc_id, page, ord, score::DOUBLE AS score FROM scored")
def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.reading_order(layout.styled(_lines(spark, sf_dir)))
    return layout.heading_scores(lines).where("score is not null").select("doc_id", "page", "ord", "score")


_ROLE = " OR ".join(f"contains(lower(text), '{hint}')" for _, hints in ROLES for hint in hints)
_HEADS = _SCORED + rf""", c AS (SELECT *, (page, place) AS spot, min((page, place)) FILTER ({_numbered('text')} OR {_ROLE}) OVER (PARTITION BY doc_id) AS anchor FROM scored WHERE score >= 5 AND NOT (contains(lower(t), 'nature | vol') OR contains(lower(t), 'proceedings of') OR contains(lower(t), 'arxiv preprint') OR lower(t) = 'article')),
 f AS (SELECT *, CASE WHEN font >= b * 1.02::DOUBLE THEN font END AS large FROM c WHERE anchor IS NULL OR (anchor[1] = 1 AND spot >= anchor) OR (anchor[1] > 1 AND page > 1)),
 g AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY large DESC NULLS LAST) AS rank, count(DISTINCT large) OVER (PARTITION BY doc_id) AS sizes FROM f),
 heads AS (SELECT doc_id, page, place, ord, text, CASE WHEN {_numbered('text')} THEN length(regexp_extract(text, {_NUMBER}, 1)) - length(replace(regexp_extract(text, {_NUMBER}, 1), '.', '')) + 1 WHEN large IS NOT NULL THEN least(rank, 4) WHEN bold THEN least(sizes + 1, 4) ELSE 1 END::INT AS level FROM g)"""


@query(f"WITH {_HEADS} SELECT * FROM heads")
def layout_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.reading_order(layout.styled(_lines(spark, sf_dir)))
    return layout.headings(layout.heading_scores(lines))


def _fold_sql(name: str, source: str, keys: str, order: str, joins: str, merge: str) -> str:
    """A recursive fold in SQL: s is the merged row so far, x the next one; a new row starts where `joins` is false."""
    on = " AND ".join(f"x.{k} = s.{k}" for k in keys.split(", "))
    return f""", {name}_in AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order})::INT AS i FROM {source}),
 {name}_f AS (SELECT *, 1 AS run FROM {name}_in WHERE i = 1 UNION ALL SELECT {merge} FROM (SELECT s AS s, x AS x, {joins} AS j FROM {name}_f s JOIN {name}_in x ON {on} AND x.i = s.i + 1)),
 {name} AS (SELECT * EXCLUDE (i, run) FROM {name}_f QUALIFY row_number() OVER (PARTITION BY {keys}, run ORDER BY i DESC) = 1)"""


def _merge_sql(**changed: str) -> str:
    """The columns of a merged line; else, of the next one."""
    same = {"text": "s.text || ' ' || x.text", "x0": "least(s.x0, x.x0)", "y0": "s.y0", "x1": "greatest(s.x1, x.x1)", "y1": "x.y1", "block": "s.block", "font": "s.font", "bold": "s.bold", "italic": "s.italic"} | changed
    columns = [f"CASE WHEN j THEN {v} ELSE x.{c} END AS {c}" for c, v in same.items()]
    return ", ".join(["x.doc_id", "x.page", "CASE WHEN j THEN s.ord ELSE x.ord END AS ord", *columns, "x.i", "s.run + (NOT j)::INT AS run"])


_MOST = {"font": "greatest(s.font, x.font)", "bold": "s.bold OR x.bold", "italic": "s.italic OR x.italic", "block": "x.block"}
_MERGED = (
    LAY
    + ", plain AS (SELECT doc_id, page, ord, text, x0, y0, x1, y1, block, font, bold, italic FROM lay)"
    + _fold_sql("adj", "plain", "doc_id, page", "ord", r"x.block = s.block AND x.x0 - s.x1 BETWEEN 0 AND greatest(30, x.font * 3) AND abs(x.y0 - s.y0) <= 2.5 AND (abs(x.font - s.font) <= 1 OR regexp_full_match(trim(s.text), '(?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3})[.)]?'))",
                _merge_sql(text=r"s.text || CASE WHEN regexp_matches(s.text, '[\p{L}\p{N}]$') AND regexp_matches(x.text, '^[\p{L}\p{N}]') THEN ' ' ELSE '' END || x.text", x0="s.x0", x1="x.x1", y0="least(s.y0, x.y0)", y1="greatest(s.y1, x.y1)", **_MOST))
    + _fold_sql("wrp", "adj", "doc_id, page", "ord", f"{_numbered('s.text')} AND x.block = s.block AND abs(x.font - s.font) <= 1 AND x.bold = s.bold AND x.y0 - s.y1 <= x.font * 0.9::DOUBLE AND len(list_filter(string_split(x.text, ' '), lambda w: w <> '')) <= 8", _merge_sql())
    + _fold_sql("cpt", "wrp", "doc_id, page", "ord", f"{_caption('s.text')} AND NOT {_caption('x.text')} AND NOT {_equation('x.text')} AND NOT {_numbered('x.text')} AND abs(x.x0 - s.x0) <= 12 AND abs(x.font - s.font) <= 1.5 AND x.y0 - s.y1 BETWEEN -x.font AND x.font * 1.5", _merge_sql(**_MOST))
)


@query(f"WITH RECURSIVE {_MERGED} SELECT doc_id, page, ord, text, x0, y0, x1, y1, font, bold, italic, block FROM cpt")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.merged_lines(layout.styled(_lines(spark, sf_dir)))
    return lines.select("doc_id", "page", "ord", "text", *layout.BOX, "font", "bold", "italic", "block")


_CONTINUES = r"""(rtrim(s.text, ' ') <> '' AND regexp_matches(x.text, '^\p{Ll}') AND NOT regexp_matches(rtrim(s.text, ' '), '[.!?。！？]["'')\]]*\s*$'))"""
_SAME = "(x.page = s.page AND abs(x.x0 - s.x0) <= 35)"
_PARAGRAPHS = _ORDERED + f""", blk AS (SELECT doc_id, page // 2 AS section, (page * 1000 + place)::INT AS place, CASE WHEN {_caption('text')} THEN 'caption' WHEN {_equation('text')} THEN 'equation' ELSE 'text' END AS kind, page, x0, y0, x1, y1, base AS font, text FROM read)""" + _fold_sql(
    "par", "blk", "doc_id, section", "place",
    f"s.kind = 'text' AND x.kind = 'text' AND CASE WHEN {_SAME} THEN x.y0 - s.y1 BETWEEN -1 AND x.font * 0.7::DOUBLE ELSE {_CONTINUES} END",
    ", ".join(["x.doc_id", "x.section", "CASE WHEN j THEN s.place ELSE x.place END AS place", "x.kind", "CASE WHEN j THEN s.page ELSE x.page END AS page",
               *[f"CASE WHEN j AND {_SAME} THEN {v} WHEN j THEN s.{c} ELSE x.{c} END AS {c}" for c, v in (("x0", "least(s.x0, x.x0)"), ("y0", "s.y0"), ("x1", "greatest(s.x1, x.x1)"), ("y1", "x.y1"))],
               "CASE WHEN j THEN s.font ELSE x.font END AS font", r"CASE WHEN NOT j THEN x.text WHEN regexp_matches(s.text, '-$') AND regexp_matches(x.text, '^\p{Ll}') THEN substr(s.text, 1, length(s.text) - 1) || x.text ELSE s.text || ' ' || x.text END AS text",
               "x.i", "s.run + (NOT j)::INT AS run"]),
)


@query(f"WITH RECURSIVE {_PARAGRAPHS} SELECT doc_id, section, place, kind, page, x0, y0, x1, y1, sha256(text) AS text_sha256 FROM par")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages are a section."""
    lines = layout.reading_order(_lines(spark, sf_dir))
    kind = F.when(layout.caption(F.col("text")).isNotNull(), "caption").when(layout.is_equation(F.col("text")), "equation").otherwise("text")
    blocks = lines.select("doc_id", F.floor(F.col("page") / 2).alias("section"), (F.col("page") * 1000 + F.col("place")).alias("place"), kind.alias("kind"), "page", *layout.BOX, F.coalesce(F.get("spans", F.lit(0))["size"], F.lit(layout.NO_FONT)).alias("font"), "text")
    return layout.paragraphs(blocks).select("doc_id", "section", "place", "kind", "page", *layout.BOX, F.sha2("text", 256).alias("text_sha256"))
