"""Pools of keyword recall by substrings, against every term in every text."""

import random

import duckdb
import pyarrow as pa

from scriptorium.functions.matching import Strings
from scriptorium.operators import pools, retrieval


def test_strings_against_every_pair():
    draw = random.Random(1)
    for _ in range(60):
        letters = draw.choice(("ab", "abc", "aé检"))
        word = lambda sizes: "".join(draw.choice(letters) for _ in range(draw.choice(sizes)))  # noqa: B023, E731
        texts = [None if draw.random() < 0.1 else word((0, 1, 5, 40, 200)) for _ in range(draw.randrange(12))]
        strings = sorted({word((0, 1, 2, 3, 7, 8, 9, 20, 70, 150)) for _ in range(draw.randrange(25))} | {t[3:28] for t in texts if t})
        column = pa.array(["ab", *texts], pa.string()).cast(pa.binary()).slice(1)
        got = [(int(r), int(s)) for rows, found in Strings([s.encode() for s in strings]).found(column) for r, s in zip(rows, found, strict=True)]
        want = [(i, j) for i, t in enumerate(texts) if t is not None for j, s in enumerate(strings) if s in t]
        assert sorted(got) == want


def _tables(spark):
    draw = random.Random(2)
    words = ["alpha", "alphabet", "Beta", "be", "检索", "gamma", "x1", "omegas", "mega"]
    docs = [(i % 50, None if i == 7 else " ".join(draw.choice(words) for _ in range(draw.randrange(8)))) for i in range(60)]  # some share an id
    items = [(q, " ".join(draw.choice([*words, "alp", "eta"]) for _ in range(6))) for q in range(9)] + [(9, "the"), (10, None)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_pool_of_raw_substrings(spark, monkeypatch):
    rows, docs, items = _tables(spark)
    terms = retrieval.query_terms(items, "item_id", "text")
    want = sorted({(t.query_id, i) for t in terms.collect() for i, text in rows if text is not None and t.term in text})
    pool = retrieval.substring_pool(terms, docs, "doc_id", "text")
    assert sorted(map(tuple, pool.collect())) == want and want
    assert "regexp_extract_all" not in pool._jdf.queryExecution().toString()  # no table of the texts' pieces
    monkeypatch.setattr(pools, "SENT_TERMS", 7)
    assert sorted(map(tuple, retrieval.substring_pool(terms, docs, "doc_id", "text").collect())) == want
    assert retrieval.substring_pool(terms.where("false"), docs, "doc_id", "text").collect() == []


def test_pooled_keywords_of_nodes_in_several_rows(spark, monkeypatch):
    """The SQL of pooled_keywords on texts of which some share an id; there a node's rows are one."""
    from scriptorium import catalog

    rows, docs, items = _tables(spark)
    latin = lambda df: df.selectExpr(df.columns[0], "replace(text, '检索', 'cjk') as text")  # noqa: E731  (the SQL knows no CJK)
    docs, items = latin(docs), latin(items)
    con = duckdb.connect()
    con.register("raw", docs.toArrow())
    con.sql("CREATE VIEW documents AS SELECT doc_id, string_agg(text, ' ') AS text FROM raw GROUP BY doc_id")
    con.register("benchmark", items.toArrow())
    want = con.sql(catalog.ORACLE_SQL["pooled_keywords"]).fetchall()
    for sent, hits in ((200_000, 1 << 18), (9, 5)):
        monkeypatch.setattr(pools, "SENT_TERMS", sent)
        monkeypatch.setattr(pools, "_HITS", hits)
        got = retrieval.pooled_top_k(items, docs, "item_id", "doc_id")
        assert sorted((r.query_id, r.node_id, r.score, " ".join(r.matched_terms), r["rank"]) for r in got.collect()) == sorted(want) and want
    assert retrieval.pooled_top_k(items.where("false"), docs, "item_id", "doc_id").collect() == []


def test_equal_scores_keep_the_first_nodes(spark):
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(40, 0, -1)] + [(99, "beta")], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    got = retrieval.pooled_top_k(items, docs, "item_id", "doc_id").collect()
    assert sorted((r["rank"], r.node_id, r.score) for r in got) == [(i, i, 1.0) for i in range(1, 11)]
