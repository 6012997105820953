"""Layout rules on rows worked out by hand, folds against plain loops, and the plans of joins by position."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import layout

SPANS = "spans array<struct<text: string, size: double, bold: boolean, italic: boolean>>"
LINE = f"doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, {SPANS}, block int"


def line(ord_, text, x0, y0, x1, y1, size=10.0, bold=False, italic=False, block=0, doc=1, page=1):
    return (doc, page, ord_, text, float(x0), float(y0), float(x1), float(y1), 600.0, 800.0, [(text, size, bold, italic)], block)


@pytest.mark.parametrize(
    ("before", "text", "goes_on"),
    [("clustering issues due", "to the lack of clear subject.", True), ("This is a complete sentence.", "Next sentence starts here.", False), ("Ends here.", "lowercase fragment", False),
     ("ends without period", "Uppercase start", False), ('it said "no."', "then", False), ("完了。", "x", False), ("open (see", "below)", True), ("  ", "x", False), ("a", "", False)],
)
def test_sentences_over_a_break(spark, before, text, goes_on):
    assert spark.range(1).select(layout.sentence_continues(F.lit(before), F.lit(text)).alias("x")).first().x == goes_on


def test_heading_scores(spark):
    rows = [line(0, "Plain text of the body that goes on and on", 70, 50, 500, 60, block=9), line(1, "Failure Analysis Under Domain Shift", 70, 120, 290, 136, 12.0, True)]
    rows += [line(2, "Step 1: Retrieve K documents", 70, 160, 220, 172, 5.2, True), line(3, "It ends like a sentence.", 70, 200, 300, 212, 14.0, True), line(4, "Figure 2: A caption", 70, 230, 300, 242, 14.0, True)]
    rows += [line(5, "x = y + z ≤ 1", 70, 260, 300, 272, 14.0, True), line(6, "Another body line here to weigh the font", 70, 300, 500, 310), line(7, "2 not a title", 70, 320, 300, 330, 14.0, True)]
    scored = layout.heading_scores(layout.reading_order(layout.styled(spark.createDataFrame(rows, LINE))))
    got = {r.ord: r.score for r in scored.collect()}
    # ratio 1.2 gives 3, bold 2, the gap of 60 points 2, its length 1
    assert got[1] == 8.0 and [got[i] for i in (2, 3, 4, 5)] == [None] * 4
    assert [(r.ord, r.level) for r in layout.headings(scored).orderBy("ord").collect()] == [(1, 2), (7, 1)]


def test_weighted_modes(spark):
    spans = [[("aa", 9.04, True, False), ("bbb", 12.0, True, False), ("c", 9.0, False, True)], [("x", 8.0, False, False), ("y", 7.0, False, False)], [(" ", 3.0, True, True)], [("a", None, False, False)], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], f"i int, {SPANS}")
    got = df.select("i", layout.dominant_font(F.col("spans")).alias("f"), layout.style_ratio(F.col("spans"), "bold").alias("b")).orderBy("i").collect()
    assert [(r.f, r.b) for r in got] == [(9.0, 5 / 6), (8.0, 0.0), (3.0, 0.0), (10.0, 0.0), (10.0, 0.0)]


def plain_order(lines):
    """Band by band, as a loop over the parting lines."""
    narrow = [x for x in lines if x[6] - x[4] < 600 * 0.62]
    left, right = [x for x in narrow if x[6] <= 300 * 1.08], [x for x in narrow if x[4] >= 300 * 0.92]
    if len(left) < 4 or len(right) < 4:
        return sorted(lines, key=lambda x: (x[5], x[4]))
    wide = sorted((x for x in lines if x not in left and x not in right), key=lambda x: (x[5], x[4]))
    out, low = [], float("-inf")
    for part in [*wide, None]:
        high = part[5] if part else float("inf")
        for side in (left, right):
            out += sorted((x for x in lines if x in side and low <= x[5] < high), key=lambda x: x[5])
        if part:
            out.append(part)
            low = part[7]
    return out


def test_reading_order_against_a_loop(spark):
    r = random.Random(7)
    rows, want = [], {}
    for page in range(1, 25):
        lines = []
        for i in range(r.choice([1, 6, 14, 30])):
            x0 = r.choice([50, 50, 310, 320, 280])
            x1 = x0 + r.choice([20, 44, 180, 250]) if r.random() < 0.85 else x0 + 400
            y0 = r.choice(range(20, 700, 15))
            lines.append(line(i, f"t{i}", x0, y0, x1, y0 + r.choice([0, 10, 30]), page=page))
        rows += lines
        want[page] = [x[2] for x in plain_order(lines)]
    got = {}
    for x in layout.reading_order(spark.createDataFrame(rows, LINE).repartition(5)).orderBy("page", "place").collect():
        got.setdefault(x.page, []).append(x.ord)
    assert got == want


def test_merges(spark):
    rows = [line(0, "3.1", 50, 100, 70, 112, 12.0, True), line(1, "Method of", 80, 101, 180, 112, 14.0, True), line(2, "the work", 50, 118, 120, 130, 14.0, True), line(3, "Long text that has more words than a wrapped title can", 50, 134, 300, 146, 14.0, True)]
    rows += [line(4, "Table 2: What", 50, 200, 200, 210, block=1), line(5, "goes on", 55, 212, 220, 222, block=2), line(6, "and on", 60, 224, 200, 234, block=2), line(7, "Figure 3", 50, 236, 200, 246, block=3), line(8, "far away", 50, 300, 200, 310, block=3)]
    got = layout.merged_lines(layout.styled(spark.createDataFrame(rows, LINE))).orderBy("ord").collect()
    assert [(r.ord, r.text) for r in got] == [(0, "3.1 Method of the work"), (3, rows[3][3]), (4, "Table 2: What goes on and on"), (7, "Figure 3"), (8, "far away")]
    assert (got[0].x0, got[0].y0, got[0].x1, got[0].y1, got[0].font) == (50.0, 100.0, 180.0, 130.0, 14.0) and len(got[0].spans) == 3
    assert layout.merged_lines(layout.styled(spark.createDataFrame([], LINE))).count() == 0


def test_paragraphs_over_pages(spark):
    texts = [("text", 1, 50, 700, "It is a hyphen-"), ("text", 1, 50, 711, "ated word that"), ("text", 2, 50, 50, "goes on here"), ("text", 2, 300, 50, "and in the next column."), ("text", 2, 300, 62, "then"), ("caption", 2, 300, 74, "Figure 1"), ("text", 2, 300, 86, "after")]
    rows = [(1, 0, i, k, p, float(x), float(y), x + 100.0, y + 10.0, 10.0, t) for i, (k, p, x, y, t) in enumerate(texts)]
    got = layout.paragraphs(spark.createDataFrame(rows, "doc_id long, section int, place int, kind string, page int, x0 double, y0 double, x1 double, y1 double, font double, text string"))
    # past its column the paragraph keeps the page where it began, so `then` on page 2 would have to continue a sentence
    assert [(r.place, r.page, r.y1, r.text) for r in got.orderBy("place").collect()] == [(0, 1, 721.0, "It is a hyphenated word that goes on here and in the next column."), (4, 2, 72.0, "then"), (5, 2, 84.0, "Figure 1"), (6, 2, 96.0, "after")]


def boxes(n, r, kind="figure"):
    return [(1, 1 + i % 3, i, kind, float(x := r.randint(-50, 600)), float(y := r.randint(-50, 800)), float(x + r.randint(0, 300)), float(y + r.randint(0, 200)), 600.0, 800.0) for i in range(n)]


BOX = "doc_id long, page int, ord int, kind string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"


def test_joins_by_position_against_loops(spark):
    r = random.Random(3)
    lines = [line(i, "t", x := r.randint(-20, 600), y := r.randint(-20, 800), x + r.randint(1, 90), y + 10, page=1 + i % 3) for i in range(150)]
    objects = boxes(40, r)
    l, b = spark.createDataFrame(lines, LINE), spark.createDataFrame(objects, BOX)
    inside = {(x[2], o[2]) for x in lines for o in objects if x[1] == o[1] and x[4] >= o[4] - 2 and x[6] <= o[6] + 2 and x[5] >= o[5] - 2 and x[7] <= o[7] + 2}
    assert {(x.ord, x.box) for x in layout.in_boxes(l, b).collect()} == inside and inside
    assert layout.in_boxes(l, b, "left_semi").count() == len({i for i, _ in inside})
    centre = {x[2] for x in lines for o in objects if x[1] == o[1] and o[4] <= (x[4] + x[6]) / 2 <= o[6] and o[5] <= (x[5] + x[7]) / 2 <= o[7]}
    assert {x.ord for x in layout.inside_objects(l, b).collect()} == centre and {x.ord for x in layout.inside_objects(l, b, "left_anti").collect()} == {x[2] for x in lines} - centre
    images, want = boxes(60, r), {}
    area = lambda f, i: max(0, min(f[6], i[6]) - max(f[4], i[4])) * max(0, min(f[7], i[7]) - max(f[5], i[5]))
    for f in objects:
        best = max(((area(f, i), -i[2]) for i in images if i[1] == f[1]), default=(0, 0))
        want[f[2]] = -best[1] if best[0] > 0 else None
    assert {x.ord: x.image for x in layout.matched_images(b, spark.createDataFrame(images, BOX)).collect()} == want
    captions = [line(i, r.choice(["Figure 1 a", "Table 2 b", "text"]), 50, y := r.randint(0, 800), 200, y + 10, page=1 + i % 3) for i in range(30)]
    want = {}
    for f in objects:
        near = [(min(abs(c[5] - f[7]), abs(f[5] - c[7])), c[2]) for c in captions if c[1] == f[1] and c[3].startswith("Figure")]
        want[f[2]] = min(near)[1] if near and min(near)[0] <= 120 else None
    found = layout.nearest_captions(b, layout.captions_of(spark.createDataFrame(captions, LINE))).collect()
    assert {x.ord: x.caption_ord for x in found} == want and any(v is not None for v in want.values())


def test_joins_by_position_are_equi_joins(spark):
    l, b = spark.createDataFrame([line(0, "Figure 1", 0, 0, 1, 1)], LINE), spark.createDataFrame(boxes(3, random.Random(1)), BOX)
    for out in (layout.in_boxes(l, b), layout.inside_objects(l, b, "left_anti"), layout.matched_images(b, b), layout.nearest_captions(b, layout.captions_of(l))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_windows_of_a_page_share_one_exchange(spark):
    lines = layout.merged_lines(layout.styled(spark.createDataFrame([line(0, "Figure 1", 0, 0, 1, 1)], LINE)))
    assert layout.reading_order(lines)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
