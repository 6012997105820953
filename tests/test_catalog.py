"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from scriptorium import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(str).replace({"<NA>": "nan", "None": "nan"}).replace(r"^(-?\d+)\.0$", r"\1", regex=True)  # whole numbers beside nulls
    return columns, sorted(map(tuple, plain.values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalog.ORACLE_SQL[name]).df())


def test_ranking_numbers(spark):
    from pyspark.sql import functions as F

    from scriptorium.operators import retrieval

    channels = spark.createDataFrame([(1, "v", 10, 1), (1, "k", 11, 1), (1, "v", 11, 2), (1, "k", 12, 2)], "query_id int, channel string, node_id int, rank int")
    got = {r.node_id: r.score for r in retrieval.rrf(channels).collect()}
    assert got[11] == 1.0 and got[12] == round((1 / 62) / (1 / 61 + 1 / 62), 6)
    one = spark.range(1).select(retrieval.ranking_score(F.lit(0.5), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("s")).first().s
    assert abs(one - 0.35) < 1e-12
