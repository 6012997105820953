"""Collections: replacement and removal, what a signature refuses, interrupted and concurrent writes."""

import pytest

from scriptorium.sources.collections import Collection, Signature, SignatureMismatch
from scriptorium.storage import fresh_path

OLD, NEW = Signature("model-a", 3, "chunk-1", "parse-1"), Signature("model-b", 3, "chunk-1", "parse-1")


def nodes(spark, *rows):
    return spark.createDataFrame([(p, n, t, [float(len(t)), 1.0, 0.0]) for p, n, t in rows], "paper string, node_id long, text string, vec array<double>")


def held(c):
    return sorted((r.paper, r.node_id, r.text) for r in c.nodes().collect())


@pytest.fixture
def filled(spark):
    folder = fresh_path(spark, "collection")
    c = Collection(spark, folder, signature=OLD)
    c.replace(nodes(spark, ("a", 1, "graph search"), ("a", 2, "index of words"), ("b", 3, "other text")))
    return folder, c


def test_papers_are_replaced_as_wholes(spark, filled):
    folder, c = filled
    c.replace(nodes(spark, ("a", 4, "new text"), ("c", 5, "third")))
    assert held(c) == [("a", 4, "new text"), ("b", 3, "other text"), ("c", 5, "third")]
    c.delete(spark.createDataFrame([("b",), ("unknown",)], "paper string"))
    c.compact()
    c.delete(spark.createDataFrame([("c",)], "paper string"))
    c.replace(nodes(spark, ("b", 6, "back again")))
    assert held(c) == [("a", 4, "new text"), ("b", 6, "back again")] == held(Collection(spark, folder, signature=OLD))
    assert [r.node_id for r in c.nodes(["b"]).collect()] == [6]


def test_another_signature_is_refused(spark, filled):
    folder, _ = filled
    c = Collection(spark, folder, signature=NEW)
    queries = spark.createDataFrame([(1, [1.0, 1.0, 0.0])], "query_id long, qvec array<double>")
    assert not c.matches() and c.metadata["embedding_model"] == "model-a" and c.metadata["space"] == "cosine"
    for action in (lambda: c.replace(nodes(spark, ("a", 9, "x"))), lambda: c.similar(queries, 2), lambda: c.nodes(), lambda: c.nodes(["a"])):
        with pytest.raises(SignatureMismatch, match="refused"):
            action()
    words = spark.createDataFrame([(1, "graph")], "query_id long, text string")
    assert [r.node_id for r in c.containing(words, 5).collect()] == [1]
    c.delete(spark.createDataFrame([("b",)], "paper string"))
    lax = Collection(spark, folder, signature=NEW, enforce=False)
    assert held(lax) == [("a", 1, "graph search"), ("a", 2, "index of words")] and lax.similar(queries, 1).count() == 1
    unsigned = Collection(spark, fresh_path(spark, "collection"))
    assert unsigned.stored_signature is None and unsigned.matches() and Collection(spark, folder).matches()


def test_only_committed_parts_are_read(spark, filled):
    folder, c = filled
    nodes(spark, ("z", 99, "never committed")).write.parquet(f"{c.folder}/nodes/part=left")
    step, state = c._last()
    c._commit(step + 1, state)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):  # the second of two writers at one step
        c._commit(step + 1, state)
    assert len(held(c)) == 3
    with pytest.raises(ValueError):
        Collection(spark, folder, "ab")
    with pytest.raises(ValueError, match="no nodes"):
        Collection(spark, fresh_path(spark, "collection")).nodes()


def test_signatures_differ_by_part(spark):
    signs = {Signature(*x).fingerprint(spark) for x in [("m", 1, "c", "p"), ("m", 2, "c", "p"), ("m", None, "c", "p"), ("m", 1, "d", "p"), ("m", 1, "c", "q"), ("n", 1, "c", "p")]}
    assert len(signs) == 6 and all(len(s) == 16 for s in signs)
