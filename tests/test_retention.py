"""Stateful streams over several batches: runs are forgotten once, subscribers get nothing after the end."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scriptorium.storage import fresh_path
from scriptorium.streaming import retention

T0 = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


@pytest.fixture
def batches(spark):
    """Three files, read one by one; run 1 ends at second 10, run 2 at second 700, run 3 never."""
    path = fresh_path(spark, "events")
    rows = [[(1, 0, 1, "run.started"), (2, 10, 1, "run.completed"), (3, 5, 2, "run.started")], [(4, 20, 1, "run.failed"), (5, 650, 3, "run.started")], [(6, 700, 2, "run.cancelled"), (7, 720, 1, "stage.started"), (8, 900, 3, "stage.started")]]
    for part in rows:
        spark.createDataFrame([(i, T0 + timedelta(seconds=s), u, e) for i, s, u, e in part], EVENTS).coalesce(1).write.mode("append").parquet(path)
    return path


def one_by_one(spark, path, name, transform):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    target = fresh_path(spark, name)
    out = transform(session.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path))
    out.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{target}/out")


def test_runs_are_forgotten_once(spark, batches):
    got = one_by_one(spark, batches, "gone", retention.forgotten).collect()
    assert [(r.run_id, (r.ended - T0).seconds, (r.forgotten - T0).seconds) for r in got] == [(1, 10, 610)]


def test_subscribers_are_closed_at_the_end(spark, batches):
    subscribers = spark.createDataFrame([(11, 1, 0), (12, 1, 1), (21, 2, 9), (31, 3, 0), (41, 4, 0)], "subscriber long, run_id long, after long")
    got = one_by_one(spark, batches, "sent", lambda e: retention.delivered(e, subscribers))
    want = [(11, 1, "run.started"), (11, 2, "run.completed"), (11, 3, "closed"), (12, 2, "run.completed"), (12, 3, "closed"), (21, 3, "closed"), (31, 1, "run.started"), (31, 2, "stage.started")]
    assert sorted((r.subscriber, r.sequence, r.event_type) for r in got.collect()) == want
    assert got.where(F.col("run_id") == 4).count() == 0
