"""Closures whose steps are read as one table."""

import pytest

from scriptorium.operators import evidence


def test_the_plan_does_not_grow_with_the_steps(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3), (5, 5)], "artifact long, source long")
    seeds = spark.createDataFrame([(0,), (9,), (99,), (9,)], "artifact long")
    found = evidence.closure(spark, edges, seeds)
    assert sorted(map(tuple, found.collect())) == sorted([(0, i) for i in range(13)] + [(9, i) for i in range(3, 13)] + [(99, 99)])
    plan = found._jdf.queryExecution().toString()
    assert "Union" not in plan and "ExistingRDD" not in plan


def test_depth(spark):
    edges, seeds = spark.createDataFrame([(0, 1), (1, 2)], "artifact long, source long"), spark.createDataFrame([(0,)], "artifact long")
    assert len(evidence.closure(spark, edges, seeds, 3).collect()) == 3
    with pytest.raises(ValueError):
        evidence.closure(spark, edges, seeds, 2)
