"""Sources and sinks on files written here; rules on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import evidence, library
from scriptorium.sources import tables


def test_manifests(spark, tmp_path):
    for name, body in {"a": {"paper_id": "a", "uploaded_at": "2024-01-01T00:00:00Z"}, "b": {"paper_id": "b", "uploaded_at": "2024-02-01T00:00:00Z"}, "c": {"title": "no id"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("{")
    assert [r.paper_id for r in tables.manifests(spark, str(tmp_path)).collect()] == ["b", "a"]
    tables.write_manifests(tables.manifests(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_nodes_need_a_filter(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "paper_id string, node_type string").write.parquet(path)
    assert tables.nodes(spark, path, paper_id=["a"], node_type=["x", "z"]).count() == 1
    with pytest.raises(ValueError):
        tables.nodes(spark, path)


def test_evaluation_cases(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps({"cases": [{"case_id": "1", "query": "q", "answerable": True, "expected_paper_ids": ["p"], "anchors": [{"paper_id": "p", "text": "t"}]}, {"case_id": "2"}]}))
    got = {r.case_id: r for r in tables.evaluation_cases(spark, str(tmp_path / "set.json")).collect()}
    assert got["1"].anchors[0].text == "t" and got["2"].query is None


def test_works_and_feed(spark):
    body = json.dumps({"results": [{"id": "1", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}, {"id": "2", "publication_date": "2021-03-04"}]})
    one, two = tables.works(spark.createDataFrame([(body,), ("not json",), (None,)], "body string"), "body").orderBy("id").collect()
    assert (one.abstract, str(one.published), str(two.published)) == ("a b a", "2020-01-01", "2021-03-04")
    feed = "<feed><entry><id>http://arxiv.org/abs/2401.01234v2</id><title>A\n  b</title><summary> s </summary><published>2024-01-02T03:04:05Z</published></entry></feed>"
    (entry,) = tables.feed_entries(spark.createDataFrame([(feed,)], "body string"), "body").collect()
    assert (entry.arxiv_id, entry.title, entry.abstract) == ("2401.01234", "A b", "s") and entry.published.hour == 3


def test_uploads_and_urls(spark, tmp_path):
    for name, body in {"good.pdf": b"%PDF-1.7", "bad.pdf": b"hello", "none.pdf": b"", "x.txt": b"%PDF-"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r.refused for r in tables.uploads(spark, str(tmp_path)).collect()}
    assert got == {"good.pdf": None, "bad.pdf": "not a PDF", "x.txt": "extension"}  # the scan leaves the empty file out
    urls = {"https://arxiv.org/pdf/1": True, "https://export.arxiv.org/x": True, "http://arxiv.org/": False, "https://evilarxiv.org/": False, "nonsense": False}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", tables.fetchable(F.col("u"), ("arxiv.org",)).alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == urls


def test_backup_notices_changes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    tables.backup(spark, {"t": rows, "u": rows.limit(0)}, str(tmp_path / "b"))
    assert {r.name: (r.rows, r.consistent) for r in tables.verified(spark, str(tmp_path / "b")).collect()} == {"t": (2, True), "u": (0, True)}
    rows.withColumn("t", F.lit("z")).write.mode("overwrite").parquet(str(tmp_path / "b" / "t"))
    assert not tables.verified(spark, str(tmp_path / "b")).where("name = 't'").first().consistent


def test_markdown(spark):
    assert tables.markdown(spark.createDataFrame([("a|b", None)], "x string, y int"), "T").splitlines() == ["# T", "", "| x | y |", "|-|-|", "| a\\|b | n/a |"]
    with pytest.raises(ValueError):
        tables.markdown(spark.range(1001), "T")


def test_closure_is_safe_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "artifact string, source string")
    seeds = spark.createDataFrame([("a",)], "artifact string")
    assert {r.artifact for r in evidence.closure(spark, edges, seeds).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        evidence.closure(spark, edges, seeds, 1)


def test_rules(spark):
    cases = [
        ((0, 0, True, True, True), "global_local_reader_does_not_require_search_source"),
        ((0, 0, False, False, False), "reader_requires_search_source"),
        ((2, 1, False, False, True), "reader_local_targets_only"),
        ((1, 1, True, True, True), "local_reader_does_not_require_search_source"),
        ((2, 0, True, True, True), "external_reader_single_paper_only"),
        ((1, 0, True, True, True), None),
    ]
    rows = spark.createDataFrame([(*c, i) for i, (c, _) in enumerate(cases)], "t int, l int, s boolean, k boolean, c boolean, i int")
    got = rows.select("i", evidence.reader_rule(*map(F.col, "tlskc")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [want for _, want in cases]


def test_replacing_leaves_no_stale_node(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "paper string, n int")
    got = library.replaced(old, spark.createDataFrame([("a", 9)], old.schema), "paper")
    assert sorted(map(tuple, got.collect())) == [("a", 9), ("b", 1)]


def test_restore_and_its_verification(spark):
    from scriptorium.storage import fresh_path

    folder, target = fresh_path(spark, "backup"), fresh_path(spark, "restored")
    with pytest.raises(tables.RestoreError, match="no backup"):
        tables.restore(spark, folder, target, force=True)
    one, two = spark.range(5).toDF("a"), spark.createDataFrame([("x",)], "b string")
    tables.backup(spark, {"one": one, "two": two}, folder)
    with pytest.raises(tables.RestoreError, match="force"):
        tables.restore(spark, folder, target)
    got = {r.name: (r.rows, r.restored, r.consistent) for r in tables.restore(spark, folder, target, force=True).collect()}
    assert got == {"one": (5, 5, True), "two": (1, 1, True)} and spark.read.parquet(f"{target}/one").count() == 5
    spark.range(4).toDF("a").write.mode("overwrite").parquet(f"{folder}/one")  # the archive was changed
    with pytest.raises(tables.RestoreError, match="differ from the manifest: one"):
        tables.restore(spark, folder, target, force=True)
    lax = {r.name: r.consistent for r in tables.restore(spark, folder, target, force=True, strict=False).collect()}
    assert lax == {"one": False, "two": True}


def test_atoms_part_chunks(spark):
    from scriptorium.operators import chunking

    blocks = [("text", "One two. Three four."), ("text", "Five six."), ("table", "a | b. c"), ("text", "Seven. Eight nine."), ("code", "x. y")]
    df = spark.createDataFrame([(1, 0, i, k, t) for i, (k, t) in enumerate(blocks)], "doc_id long, section int, place int, kind string, text string")
    got = [(r.chunk, r.kind, r.text) for r in chunking.block_chunks(df, most=20).orderBy("chunk").collect()]
    assert got == [(1, "text", "One two. Three four."), (2, "text", "Three four. Five six."), (3, "table", "a | b. c"), (4, "text", "Seven. Eight nine."), (5, "code", "x. y")]
