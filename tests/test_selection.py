"""Selection, chunking and text functions on cases worked out by hand."""

from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import selection
from scriptorium.operators.selection import Limits


def row(i, paper, score, dimensions=(), vec=(1.0, 0.0)):
    return {"node_id": i, "paper": paper, "score": score, "dimensions": list(dimensions), "vec": list(vec)}


def ids(rows):
    return [r["node_id"] for r in rows]


def test_reserve_keeps_target_papers():
    rows = [row(1, "a", 0.9), row(2, "a", 0.8), row(3, "a", 0.7), row(4, "b", 0.1, ["x"]), row(5, "b", 0.05)]
    got = selection.reserve(rows, ["b"], ["x"], Limits(candidates=3, per_paper=1))
    assert ids(got) == [1, 4, 5] and [r["protected"] for r in got] == [False, True, True]
    assert ids(selection.reserve([row(1, "a", 0.9), row(2, "a", 0.8)], [], [], Limits(candidates=1))) == [1]


def test_diversify_prefers_the_unlike():
    rows = [row(1, "a", 1.0), row(2, "a", 0.85), row(3, "a", 0.8, vec=(0.0, 1.0))]  # 0.7 * 0.25 - 0.3 < 0
    assert ids(selection.diversify(rows, Limits())) == [1, 3, 2]
    rows[1]["protected"] = True
    assert ids(selection.diversify(rows, Limits())) == [2, 1, 3]  # 0.7 - 0.3 > 0
    assert ids(selection.diversify(rows[:1], Limits())) == [1]


def test_choose_fills_cells_then_papers():
    rows = [row(1, "a", 0.9), row(2, "a", 0.8, ["x"]), row(3, "b", 0.7), row(4, "b", 0.6, ["x"]), row(5, "c", 0.5)]
    assert ids(selection.choose(rows, ["a", "b"], ["x"], Limits(final=4, per_paper=2))) == [2, 4, 1, 3]
    assert ids(selection.choose([row(1, "a", 0.9), row(2, "a", 0.8), row(3, "b", 0.7)], [], [], Limits(per_paper=1))) == [1, 3]


def test_select_runs_per_request(spark):
    schema = "query_id string, node_id long, paper string, dimensions array<string>, score double, vec array<double>, want_papers array<string>, want_dimensions array<string>"
    data = [(q, i, "ab"[i % 2], ["x"] if i % 3 == 0 else [], 1.0 - i / 100, [1.0, float(i)], ["a", "b"], ["x"]) for q in ("p", "q") for i in range(60)]
    got = selection.select(spark.createDataFrame(data, schema)).orderBy("query_id", "rank").collect()
    assert [r.node_id for r in got if r.query_id == "p"] == [r.node_id for r in got if r.query_id == "q"]
    assert [r.node_id for r in got if r.query_id == "p"][:2] == [0, 3] and len(got) == 12
    assert selection.select(spark.createDataFrame([], schema)).count() == 0


def test_sentences_and_chunks(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "v string").select(column.alias("c")).first().c

    v = F.col("v")
    assert one(text.sentences(v), "See Fig. 2 here. Best. of all! Ok? x") == ["See fig. 2 here.", "Best. of all!", "Ok?", "x"]
    assert one(text.sentences(v), "  ") == [] and one(text.sentences(v), None) is None
    units = F.array(*[F.lit(f"s{i}") for i in range(4)])
    assert one(text.packed(units, 2), "") == [["s0"], ["s0", "s1"], ["s1", "s2"], ["s2", "s3"]]
    assert one(text.packed(units, 5), "") == [["s0", "s1"], ["s1", "s2", "s3"]]
    assert one(text.packed(units, 5, 0), "") == [["s0", "s1"], ["s2", "s3"]]
    assert one(text.packed(F.array().cast("array<string>"), 5), "") == []
    assert one(text.hard_split(v, 2), "abcde") == ["ab", "cd", "e"]
    kinds = {
        "3.1 Retrieval": "heading", "12 Monkeys": "text", "9. Results": "heading", "10 Results": "text", "A.1 Proofs": "heading", "I.1 Proofs": "text", "2 lower case": "text", "2 Ends so.": "text", "3 Maps A → B": "text", "4 ***": "text",
        "1.2.3.4.5 Deep": "heading", "5 " + "Long " * 17: "text", "Related Work:": "heading", "abstract": "heading", "Figure 2: a map": "caption", "Fig.2b": "text", "TABLE A1.2 x": "caption", "Extended Data Fig. 3": "caption", "figures 2": "text",
        "12": "page number", "12345": "text", "Page 3 of 9": "page number", "3/9": "page number", "page": "text", "a = b + c": "text", "a = b + c (3)": "equation", "a = b → c": "equation", "α + β": "equation", "x" * 299 + "=(1)": "text",
        "Article": "running matter", "Nature | Vol 5": "running matter", "arXiv preprint 2": "running matter", "plain words": "text",
    }
    assert {k: one(text.line_kind(v), k) for k in kinds} == kinds
    assert one(text.numbered_heading(v), "2.1) On  graphs") == ("2.1", "On  graphs", 2) and one(text.named_heading(v, F.lit(True)), "Methods") is None
    assert one(text.caption(v), "extended data figure S4.1 shows") == ("figure", "S4.1")
    assert one(text.semantic_role(v), "Our Methods") == "methods" and one(text.semantic_role(v), "Threats to Validity") == "limitations" and one(text.semantic_role(v), "x") is None
    assert one(text.body_text(F.split(v, "\n")), "one hy-\nphen\nTop-\nTen\n\n\nnext\n") == "one hyphen Top- Ten\n\nnext"
    assert [one(text.paper_identifier(v), x) for x in ("12345.678901", "x2401.01234V2.", "2401.012345")] == [None, "2401.01234", None]
    assert one(text.citation_markers(v), "a [E-0123456789ab] b [E-0123456789ab] [E-x]") == ["E-0123456789ab"]
    assert one(text.query_expression(v), 'graph AND "deep model" (x)') == 'all:graph AND all:"deep model" AND all:x'
    assert one(text.doi(v), "see 10.1234/abc.5).") == "10.1234/abc.5" and one(text.paper_identifier(v), "arXiv:2401.01234v2") == "2401.01234"
