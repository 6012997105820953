"""Buckets of blocks: their number, and ranges of them that are cut at a time."""

import numpy as np

from scriptorium.llm import bwt, repeats


def test_buckets_follow_the_bytes_and_not_many_partitions(spark):
    """A group makes a block for each bucket, so two buckets for each of 5,000 partitions would be 100 million blocks."""
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = {}
        for n in (4, 5000):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found[n] = repeats.bucket_count(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found == {4: 8, 5000: repeats.EASY_BUCKETS}


def test_ranges_of_buckets(monkeypatch):
    monkeypatch.setattr(bwt, "CUT_BYTES", 100)
    draw = np.random.default_rng(1)
    for n in (0, 1, 50, 300):
        target = np.sort(draw.integers(0, 40, n))
        sizes = draw.integers(50, 90, n) if n < 300 else draw.integers(1, 9, n)
        found = list(bwt._runs(target, sizes))
        assert [x for a, z, _ in found for x in range(a, z)] == list(range(n))
        assert [int(target[lo]) for _, _, cuts in found for lo in cuts[:-1]] == np.unique(target).tolist()
        for a, z, cuts in found:
            assert cuts[0] == a and cuts[-1] == z and (sizes[a:z].sum() <= 100 or len(cuts) == 2)
