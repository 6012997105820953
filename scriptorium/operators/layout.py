"""Pages as lines with boxes: joins by position, reading order, merged lines, paragraphs, fonts and headings.

A line has doc_id, page, ord (its place as read from the page), text, x0, y0, x1, y1, page_width, page_height, spans
(array<struct<text, size, bold, italic>>) and block (the source block it came from); `styled` adds font, bold and italic. Boxes of
tables, figures and images have doc_id, page, ord, x0 .. y1, page_width and page_height. Pages are partitions, so windows over them share
one exchange; only joins by position need a grid as well, because a page may hold any number of boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NAMED_HEADINGS, caption, is_equation, is_running_matter, numbered_heading, semantic_role, squeezed
from ..functions.values import overlap_area

PAGE = ["doc_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]
#: Cells of a page's grid in either direction; what lies off the page counts to cells beside it.
GRID = 16
# The layout rules' distances, in points or as shares of the page or the font.
BOX_PAD = 2.0
CAPTION_SHARE = 0.15
NARROW, LEFT_END, RIGHT_START, COLUMN_LINES = 0.62, 1.08, 0.92, 4
STYLE_SHARE, NO_FONT = 0.8, 10.0
PARAGRAPH_COLUMN, PARAGRAPH_GAP = 35.0, 0.7
HEADING_SCORE = 5.0
NUMBER_ALONE = r"^(?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3})[.)]?$"
SENTENCE_END = r"""[.!?。！？]["')\]]*\s*$"""


# joins by position


def _cell(value: Column, of: Column) -> Column:
    return F.least(F.greatest(F.floor(value / of * GRID), F.lit(-1)), F.lit(GRID)).cast("int")


def _cells(rows: DataFrame, pad: float = 0.0) -> DataFrame:
    """A row for each (cx, cy) that the box, padded, lies in: at most (GRID + 2)^2."""
    span = lambda a, b, of: F.sequence(_cell(F.col(a) - pad, F.col(of)), F.greatest(_cell(F.col(a) - pad, F.col(of)), _cell(F.col(b) + pad, F.col(of))))
    across = rows.withColumn("cx", F.explode(span("x0", "x1", "page_width")))
    return across.withColumn("cy", F.explode(span("y0", "y1", "page_height")))


def _at(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    return rows.withColumn("cx", _cell(x, F.col("page_width"))).withColumn("cy", _cell(y, F.col("page_height")))


def _near(points: DataFrame, boxes: DataFrame, pad: float, holds: Callable[[Callable[[str], Column]], Column], how: str) -> DataFrame:
    """points (with cx, cy) joined with the boxes of their cell that hold them: equal page and cell first, then the exact test.
    A point lies in one cell and so meets a box once."""
    near = _cells(boxes, pad).select(*PAGE, "cx", "cy", F.col("ord").alias("box"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    l, b = points.alias("l"), near.alias("b")
    same = [F.col(f"l.{c}") == F.col(f"b.{c}") for c in (*PAGE, "cx", "cy")]
    met = l.join(b, [*same, holds(lambda c: F.col(f"b.b_{c}"))], how)
    return met.select("l.*", *(["b.box"] if how == "inner" else [])).drop("cx", "cy")


def in_boxes(lines: DataFrame, boxes: DataFrame, how: str = "inner", pad: float = BOX_PAD) -> DataFrame:
    """Lines that lie in a box, `pad` points beside it allowed; how: inner adds `box` (its ord), left_semi or left_anti choose lines."""
    holds = lambda b: (F.col("l.x0") >= b("x0") - pad) & (F.col("l.x1") <= b("x1") + pad) & (F.col("l.y0") >= b("y0") - pad) & (F.col("l.y1") <= b("y1") + pad)
    return _near(_at(lines, F.col("x0"), F.col("y0")), boxes, pad, holds, how)


def inside_objects(lines: DataFrame, objects: DataFrame, how: str = "left_semi") -> DataFrame:
    """Lines whose centre lies in a table or figure (left_semi), or those of the running text (left_anti)."""
    x, y = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    holds = lambda b: x.between(b("x0"), b("x1")) & y.between(b("y0"), b("y1"))
    return _near(_at(lines, (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2), objects, 0.0, holds, how)


def code_blocks(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, page, box, text): boxes in which a line begins with algorithm, procedure or function, with their lines joined."""
    found = in_boxes(lines, boxes)
    titled = F.max(F.trim("text").rlike(r"(?i)^(algorithm|procedure|function)\b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return found.groupBy(*PAGE, "box").agg(titled.alias("titled"), F.btrim(text).alias("text")).where("titled").drop("titled")


def matched_images(figures: DataFrame, images: DataFrame) -> DataFrame:
    """figures with `image`: the ord of the image that shares the largest area with it, of equal ones the first; null where none does.

    Both sides are spread over the cells they touch; a pair is taken only in the cell where their common part begins.
    """
    box = lambda t: F.struct(*[F.col(f"{t}.{c}").alias(c) for c in BOX])
    f, i = _cells(figures.select(*PAGE, "ord", *BOX, "page_width", "page_height")).alias("f"), _cells(images.select(*PAGE, "ord", *BOX, "page_width", "page_height")).alias("i")
    begins = [F.col(f"f.{c}") == _cell(F.greatest(F.col(f"f.{v}"), F.col(f"i.{v}")), F.col(f"f.{of}")) for c, v, of in (("cx", "x0", "page_width"), ("cy", "y0", "page_height"))]
    pairs = f.join(i, [F.col(f"f.{c}") == F.col(f"i.{c}") for c in (*PAGE, "cx", "cy")] + begins)
    pairs = pairs.select(*[F.col(f"f.{c}") for c in (*PAGE, "ord")], F.col("i.ord").alias("image"), overlap_area(box("f"), box("i")).alias("area")).where("area > 0")
    best = pairs.groupBy(*PAGE, "ord").agg(F.min_by("image", F.struct(-F.col("area"), "image")).alias("image"))
    return figures.join(best, [*PAGE, "ord"], "left")


def captions_of(lines: DataFrame) -> DataFrame:
    """Lines that are captions, with kind and label."""
    return lines.withColumn("c", caption(F.col("text"))).where("c is not null").select("*", "c.kind", "c.label").drop("c")


def nearest_captions(objects: DataFrame, captions: DataFrame) -> DataFrame:
    """objects (with kind) with caption_ord, label and distance: the nearest caption of their kind on the page, above or below, of equally near
    ones the first; null beyond CAPTION_SHARE of the page's height.

    A caption counts by its upper edge, an object below it by its lower one, and the reverse. Both are put in bands as high as the
    farthest distance, so only neighbouring bands meet.
    """
    reach = F.col("page_height") * CAPTION_SHARE
    band = lambda v: F.floor(F.col(v) / reach)
    edges = F.array(F.struct(F.lit("below").alias("side"), band("y0").alias("band")), F.struct(F.lit("above").alias("side"), band("y1").alias("band")))
    c = captions.select(*PAGE, "kind", F.col("ord").alias("caption_ord"), "label", F.col("y0").alias("c0"), F.col("y1").alias("c1"), F.inline(edges))
    near = lambda side, v: F.transform(F.sequence(band(v) - 1, band(v) + 1), lambda b: F.struct(F.lit(side).alias("side"), b.alias("band")))
    o = objects.select(*PAGE, "kind", "ord", "y0", "y1", reach.alias("reach"), F.inline(F.concat(near("below", "y1"), near("above", "y0"))))
    distance = F.least(F.abs(F.col("c0") - F.col("y1")), F.abs(F.col("y0") - F.col("c1")))
    met = o.join(c, [*PAGE, "kind", "side", "band"]).withColumn("distance", distance).where("distance <= reach")
    best = met.groupBy(*PAGE, "kind", "ord").agg(F.min_by(F.struct("caption_ord", "label", "distance"), F.struct("distance", "caption_ord")).alias("best"))
    return objects.join(best.select(*PAGE, "kind", "ord", "best.*"), [*PAGE, "kind", "ord"], "left")


# order


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with place, from 1 on each page, and gap_before, the distance to the line before in the same column.

    A page has two columns if four lines end left of its middle and four begin right of it (narrow ones). Then the lines in neither column,
    by (y0, x0), part the page into bands, in each of which the left column comes before the right one; else lines go by (y0, x0). As
    the rule has it, a line beside a parting line and not above its end is left out, and one that counts to both columns comes twice.
    Bands need no join: a line's band is the number of parting lines that begin no lower than it.
    """
    page = W.partitionBy(*PAGE)
    middle, narrow = F.col("page_width") / 2, F.col("x1") - F.col("x0") < F.col("page_width") * NARROW
    left, right = narrow & (F.col("x1") <= middle * LEFT_END), narrow & (F.col("x0") >= middle * RIGHT_START)
    many = lambda side: F.count(F.when(side, 1)).over(page) >= COLUMN_LINES
    sides = F.when(~F.col("two"), F.array(F.lit(0))).when(left | right, F.filter(F.array(F.when(left, 0), F.when(right, 1)), lambda s: s.isNotNull())).otherwise(F.array(F.lit(2)))
    rows = lines.withColumn("two", many(left) & many(right)).withColumn("side", F.explode(sides))
    parting = F.when(F.col("side") == 2, F.struct("y0", "x0", "ord", "y1"))
    so_far = page.orderBy("y0").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("*", F.count(parting).over(so_far).alias("begun"), F.max(parting).over(so_far).alias("last"), F.count(parting).over(page.orderBy("y0", "x0", "ord").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    band = F.when(F.col("side") == 2, F.col("before")).otherwise(F.col("begun"))
    rows = rows.withColumn("band", band).where((F.col("side") == 2) | F.col("last").isNull() | (F.col("last.y1") <= F.col("y0")))
    order = page.orderBy("band", (F.col("side") == 2).cast("int"), "side", "y0", F.when(~F.col("two"), F.col("x0")), "ord")
    rows = rows.withColumn("place", F.row_number().over(order))
    column = W.partitionBy(*PAGE, F.col("x0") < middle).orderBy("place")
    gap = F.greatest(F.lit(0.0), F.col("y0") - F.lag("y1").over(column))
    return rows.withColumn("gap_before", F.coalesce(F.when(F.lag("y1").over(column).isNotNull(), gap), F.lit(0.0))).drop("two", "side", "begun", "last", "before", "band")


# folds


def folded(rows: DataFrame, keys: list[str], order: list[str], apart: Callable[[Callable[[str], Column]], Column], joins: Callable[[Column, Column], Column], merge: Callable[[Column, Column], dict[str, Column]], fields: list[str]) -> DataFrame:
    """Rows merged in order, each with the merged row before it.

    joins(state, row) decides and merge(state, row) gives the changed fields. What the rules ask of a row and its own
    predecessor alone is `apart`, in terms of lag: wherever it holds no merge can be, so rows are parted there by a window and only what lies between is
    collected and folded. Keys and order are kept, those of the first merged row.
    """
    by = W.partitionBy(*keys).orderBy(*order)
    starts = F.coalesce(apart(lambda c: F.lag(c).over(by)), F.lit(True)).cast("int")
    parted = rows.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(by))
    row = F.struct(*order, *fields)
    runs = parted.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(row), lambda a, b: _compare(a, b, order)).alias("_rows"))
    kind = runs.schema["_rows"].dataType.simpleString()
    start = F.struct(F.expr(f"cast(array() as {kind})").alias("done"), F.get("_rows", F.lit(0)).alias("state"))

    def step(acc: Column, x: Column) -> Column:
        state = acc["state"]
        new = merge(state, x)
        merged = F.struct(*[state[c].alias(c) for c in order], *[new.get(c, state[c]).alias(c) for c in fields])
        both = joins(state, x)
        return F.struct(F.when(both, acc["done"]).otherwise(F.concat(acc["done"], F.array(state))).alias("done"), F.when(both, merged).otherwise(x).alias("state"))

    rest = F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(1)))
    done = F.when(F.size("_rows") == 1, F.col("_rows")).otherwise(F.aggregate(rest, start, step, lambda acc: F.concat(acc["done"], F.array(acc["state"]))))
    return runs.select(*keys, F.explode(done).alias("_row")).select(*keys, "_row.*")


def _compare(a: Column, b: Column, order: list[str]) -> Column:
    value = F.lit(0)
    for c in reversed(order):
        value = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(value)
    return value


LINE = ["text", *BOX, "page_width", "page_height", "spans", "font", "bold", "italic", "block"]


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _joined(state: Column, x: Column, **changed: Column) -> dict[str, Column]:
    return {"text": F.concat(state["text"], F.lit(" "), x["text"]), "x0": F.least(state["x0"], x["x0"]), "x1": F.greatest(state["x1"], x["x1"]), "y1": x["y1"], "spans": F.concat(state["spans"], x["spans"]), **changed}


def merge_adjacent(lines: DataFrame) -> DataFrame:
    """Pieces of one line joined: same block and base line, at most 30 points or three letters apart, like fonts or a number before its title."""

    def near(block: Column, end: Column, x: Callable[[str], Column]) -> Column:
        return (x("block") == block) & (x("x0") - end).between(F.lit(0.0), F.greatest(F.lit(30.0), x("font") * 3))

    def joins(s: Column, x: Column) -> Column:
        alike = (F.abs(x["font"] - s["font"]) <= 1.0) | F.trim(s["text"]).rlike(NUMBER_ALONE)
        return near(s["block"], s["x1"], lambda c: x[c]) & (F.abs(x["y0"] - s["y0"]) <= 2.5) & alike

    def merge(s: Column, x: Column) -> dict[str, Column]:
        blank = F.when(s["text"].rlike(r"[\p{L}\p{N}]$") & x["text"].rlike(r"^[\p{L}\p{N}]"), " ").otherwise("")
        font, bold, italic = F.greatest(s["font"], x["font"]), s["bold"] | x["bold"], s["italic"] | x["italic"]
        return _joined(s, x, text=F.concat(s["text"], blank, x["text"]), x0=s["x0"], x1=x["x1"], y0=F.least(s["y0"], x["y0"]), y1=F.greatest(s["y1"], x["y1"]), font=font, bold=bold, italic=italic, block=x["block"])

    return folded(lines, PAGE, ["ord"], lambda lag: ~near(lag("block"), lag("x1"), F.col), joins, merge, LINE)


def merge_wrapped_headings(lines: DataFrame) -> DataFrame:
    """Numbered headings with the short lines of their style that follow in the block."""

    def near(block: Column, end: Column, x: Callable[[str], Column]) -> Column:
        return (x("block") == block) & (x("y0") - end <= x("font") * 0.9) & (_words(x("text")) <= 8)

    def joins(s: Column, x: Column) -> Column:
        return near(s["block"], s["y1"], lambda c: x[c]) & numbered_heading(s["text"]).isNotNull() & (F.abs(x["font"] - s["font"]) <= 1.0) & (x["bold"] == s["bold"])

    return folded(lines, PAGE, ["ord"], lambda lag: ~near(lag("block"), lag("y1"), F.col), joins, _joined, LINE)


def merge_captions(lines: DataFrame) -> DataFrame:
    """Captions with the lines that continue them: close below, at the same left edge and of a like font, no caption, equation or heading of their own."""

    def plain(x: Callable[[str], Column]) -> Column:
        return caption(x("text")).isNull() & ~is_equation(x("text")) & numbered_heading(x("text")).isNull()

    def near(end: Column, x: Callable[[str], Column]) -> Column:
        return (x("y0") - end).between(-x("font"), x("font") * 1.5)

    def joins(s: Column, x: Column) -> Column:
        return near(s["y1"], lambda c: x[c]) & caption(s["text"]).isNotNull() & (F.abs(x["x0"] - s["x0"]) <= 12) & (F.abs(x["font"] - s["font"]) <= 1.5)

    def merge(s: Column, x: Column) -> dict[str, Column]:
        return _joined(s, x, font=F.greatest(s["font"], x["font"]), bold=s["bold"] | x["bold"], italic=s["italic"] | x["italic"], block=x["block"])

    return folded(lines, PAGE, ["ord"], lambda lag: ~(near(lag("y1"), F.col) & plain(F.col)), joins, merge, LINE)


def merged_lines(lines: DataFrame) -> DataFrame:
    """Styled lines after all three merges, as a page is read."""
    return merge_captions(merge_wrapped_headings(merge_adjacent(lines)))


def sentence_continues(before: Column, text: Column) -> Column:
    """A text that begins with a small letter goes on where the one before it ended without a full stop."""
    return (F.rtrim(before) != "") & text.rlike(r"^\p{Ll}") & ~F.rtrim(before).rlike(SENTENCE_END)


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc_id, section, place, kind, page, x0 .. y1, font, text) of a section's blocks in order, with text blocks that belong together joined.

    On one page and in one column lines join that follow closely; over columns and pages those that continue a sentence. A hyphen before a
    small letter goes. A paragraph keeps the page and, past its column, the box where it began. Texts are not blank.
    """

    def goes_on(page: Column, text: Column, kind: Column, x: Callable[[str], Column]) -> Column:
        return (kind == "text") & (x("kind") == "text") & ((x("page") == page) | sentence_continues(text, x("text")))

    def column(s: Column, x: Column) -> Column:
        return (x["page"] == s["page"]) & (F.abs(x["x0"] - s["x0"]) <= PARAGRAPH_COLUMN)

    def joins(s: Column, x: Column) -> Column:
        close = (x["y0"] - s["y1"]).between(F.lit(-1.0), x["font"] * PARAGRAPH_GAP)
        return (s["kind"] == "text") & (x["kind"] == "text") & F.when(column(s, x), close).otherwise(sentence_continues(s["text"], x["text"]))

    def merge(s: Column, x: Column) -> dict[str, Column]:
        cut = s["text"].endswith("-") & x["text"].rlike(r"^\p{Ll}")
        text = F.when(cut, F.concat(F.substring(s["text"], F.lit(1), F.length(s["text"]) - 1), x["text"])).otherwise(F.concat(s["text"], F.lit(" "), x["text"]))
        grown = {"x0": F.least(s["x0"], x["x0"]), "x1": F.greatest(s["x1"], x["x1"]), "y1": x["y1"]}
        return {"text": text, **{c: F.when(column(s, x), v).otherwise(s[c]) for c, v in grown.items()}}

    return folded(blocks, ["doc_id", "section"], ["place"], lambda lag: ~goes_on(lag("page"), lag("text"), lag("kind"), F.col), joins, merge, ["kind", "page", *BOX, "font", "text"])


# fonts and headings


def _size(span: Column) -> Column:
    return F.bround(span["size"], 1)


def _visible(span: Column) -> Column:
    return F.length(F.btrim(span["text"]))


def dominant_font(spans: Column) -> Column:
    """The font size of most characters, of equal ones the first; NO_FONT without sizes."""
    sized = F.filter(spans, lambda s: s["size"].isNotNull())
    sizes = F.array_distinct(F.transform(sized, _size))
    weight = lambda size: F.aggregate(F.filter(sized, lambda s: _size(s) == size), F.lit(0), lambda acc, s: acc + F.greatest(_visible(s), F.lit(1)))
    return F.coalesce(F.array_max(F.transform(sizes, lambda size, i: F.struct(weight(size).alias("w"), (-i).alias("i"), size.alias("size"))))["size"], F.lit(NO_FONT))


def style_ratio(spans: Column, style: str) -> Column:
    """The share of visible characters in bold or italic; 0 without any."""
    count = lambda chosen: F.aggregate(chosen, F.lit(0), lambda acc, s: acc + _visible(s))
    every = count(spans)
    return F.when(every == 0, F.lit(0.0)).otherwise(count(F.filter(spans, lambda s: s[style])) / every)


def styled(lines: DataFrame) -> DataFrame:
    """lines with font, bold and italic from their spans."""
    flag = lambda style: (style_ratio(F.col("spans"), style) >= STYLE_SHARE).alias(style)
    return lines.select("*", dominant_font(F.col("spans")).alias("font"), flag("bold"), flag("italic"))


def body_fonts(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the font size of most characters of a document between 4 and 96 % of its pages' height, of equal ones the first."""
    inner = lines.where(F.col("y0").between(F.col("page_height") * 0.04, F.col("page_height") * 0.96))
    spans = inner.select("doc_id", "page", "ord", F.posexplode("spans").alias("i", "s")).where("s.size is not null")
    sizes = spans.groupBy("doc_id", _size(F.col("s")).alias("size")).agg(F.sum(_visible(F.col("s"))).alias("weight"), F.min(F.struct("page", "ord", "i")).alias("first"))
    return sizes.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("weight"), "first")).alias("body"))


def heading_scores(lines: DataFrame) -> DataFrame:
    """Styled lines in reading order with body (the document's font size), numbered, named and score; score is null where a line can be no heading."""
    text = squeezed(F.col("text"))
    style = ["doc_id", F.bround("font", 1), "bold", "italic", F.rint(F.col("x0") / 12)]
    rows = lines.join(body_fonts(lines), "doc_id", "left").withColumn("body", F.coalesce("body", F.lit(NO_FONT)))
    rows = rows.withColumn("alike", F.count(F.lit(1)).over(W.partitionBy(*style)))
    rows = rows.withColumn("numbered", numbered_heading(text).isNotNull()).withColumn("named", F.rtrim(F.lower(text), F.lit(":")).isin(*NAMED_HEADINGS))
    n, words, ratio, letters = F.length(text), _words(text), F.col("font") / F.greatest("body", F.lit(0.1)), F.regexp_replace(text, r"[^\p{L}]", "")
    numbered, named = F.col("numbered"), F.col("named")
    possible = n.between(3, 180) & (words <= 22) & (letters != "") & (F.col("font") >= F.col("body") * 0.8) & caption(text).isNull() & ~is_equation(text)
    possible &= ~text.rlike("[.!;-]$") & ~(text.contains(". ") & (words > 8)) & (numbered | named | (n <= 75))
    possible &= ~(numbered & (ratio < 1.02) & ~F.col("bold") & (F.upper(letters) != letters))
    gain = lambda when, points: F.when(when, points).otherwise(0.0)
    score = F.when(ratio >= 1.14, 3.0).when(ratio >= 1.04, 1.0).otherwise(0.0) + gain(F.col("bold"), 2.0) + gain(numbered, 3.0) + gain(named, 3.0)
    score += gain(F.col("gap_before") >= F.col("body") * 0.8, 2.0) + gain(F.col("alike").between(2, 80), 1.0) + gain(n <= 100, 1.0)
    return rows.withColumn("score", F.when(possible, score)).drop("alike")


def headings(scored: DataFrame) -> DataFrame:
    """(doc_id, page, place, ord, text, level) of the headings among scored lines.

    Running matter is none. From the first heading with a number or a role on, if that is on page 1, else from page 2 on. A numbered one's level
    is its number's; another's the rank of its font among the larger ones (4 at most), or one more for bold ones of the body's font.
    """
    running = is_running_matter(F.col("text")) | ((F.col("page") > 1) & ((F.col("y0") < F.col("page_height") * 0.055) | (F.col("y1") > F.col("page_height") * 0.94)) & squeezed(F.col("text")).rlike(r"^\d{1,4}$"))
    rows = scored.where(F.col("score") >= HEADING_SCORE).where(~running)
    doc, here = W.partitionBy("doc_id"), F.struct("page", "place")
    anchor = F.min(F.when(numbered_heading(F.col("text")).isNotNull() | semantic_role(F.col("text")).isNotNull(), here)).over(doc)
    rows = rows.withColumn("anchor", anchor).where(F.col("anchor").isNull() | ((F.col("anchor.page") == 1) & (here >= F.col("anchor"))) | ((F.col("anchor.page") > 1) & (F.col("page") > 1)))
    large = F.when(F.col("font") >= F.col("body") * 1.02, F.bround("font", 1))
    rows = rows.withColumn("large", large).withColumn("rank", F.dense_rank().over(doc.orderBy(F.desc_nulls_last("large")))).withColumn("sizes", F.size(F.collect_set("large").over(doc)))
    level = F.coalesce(numbered_heading(F.trim("text"))["level"], F.when(F.col("large").isNotNull(), F.least("rank", F.lit(4))).when(F.col("bold"), F.least(F.col("sizes") + 1, F.lit(4))).otherwise(1))
    return rows.select("doc_id", "page", "place", "ord", "text", level.cast("int").alias("level"))
