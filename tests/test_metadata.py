"""First pages worked out by hand; lines are trimmed of blanks and of nothing else."""

from pyspark.sql import functions as F

from scriptorium.functions import metadata
from scriptorium.operators import chunking, library

PAGE = """Proceedings of ACL
TreeRAG: Unleashing the Power of
Hierarchical Storage
Wenyu Tao1, Xiaofen Xing2
South China University of Technology
Abstract
When confronting long documents, and so on
Keywords: graph, tree retrieval; graph.
arXiv:2405.01234v2 doi 10.1000/abc.DEF-(9)."""


def first(spark, page, *columns):
    return spark.createDataFrame([(page,)], "page string").select(*columns).first()


def test_a_first_page(spark):
    title = metadata.detected_title(F.col("page"))
    got = first(spark, PAGE, title.alias("t"), metadata.detected_authors(F.col("page"), title).alias("a"), metadata.keywords(F.col("page")).alias("k"), metadata.identifiers(F.col("page")).alias("i"))
    assert got.t == "TreeRAG: Unleashing the Power of Hierarchical Storage" and got.a == ["Wenyu Tao", "Xiaofen Xing"]
    assert got.k == ["graph", "tree retrieval"] and tuple(got.i) == ("10.1000/abc.DEF-(9", "2405.01234")


def test_pages_without(spark):
    for page in ("", "Abstract\nText of some length", "12 - 14\n@"):
        got = first(spark, page, metadata.detected_title(F.col("page")).alias("t"), metadata.keywords(F.col("page")).alias("k"), metadata.identifiers(F.col("page")).alias("i"))
        assert got.t is None and got.k == [] and tuple(got.i) == (None, None)
    # a name above a place is an author; columns count one by one
    page = "A Title of Some Length\nAnn Lee    Max B. Roe\nUniversity of X\nabstract"
    assert first(spark, page, metadata.detected_authors(F.col("page"), F.lit("A Title of Some Length")).alias("a")).a == ["Ann Lee", "Max B. Roe"]


def test_lines_lose_blanks_only(spark):
    docs = spark.createDataFrame([(1, "s", "0 first\n 1 second \n2")], "doc_id long, source string, text string")
    want = ["0 first", "1 second", "2"]
    assert [r.text for r in chunking.section_rows(docs).orderBy("section").collect()] == want
    assert [r.line for r in library.section_nodes(docs).orderBy("n").collect()] == want == [r.line for r in library.lines(docs).orderBy("ord").collect()]
