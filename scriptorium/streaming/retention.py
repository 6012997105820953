"""Live runs as a stream: fan-out to subscribers up to a run's end, and runs that are forgotten some time after it.

Both keep a run's state in a StatefulProcessor. Forgetting is a timer per run, in event time, so a replay forgets what the first
reading forgot: it fires when the watermark has passed the run's end by the retention.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import ENDINGS
from ..storage import fresh_path
from .events import file_stream

ENDS = tuple(ENDINGS)
#: Fixed value: seconds that an ended run is kept.
RETENTION = 600
FORGOTTEN = "run_id long, ended long, forgotten long"
DELIVERED = "run_id long, sequence long, event_type string, event_id long, last boolean"


class Retention(StatefulProcessor):
    """A run's first end; when the timer fires, (run_id, ended, forgotten) comes out and only a mark stays, so late events are no new run."""

    def __init__(self, seconds: int = RETENTION):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getValueState("ended", "ms long, gone boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            ends = batch.loc[batch["event_type"].isin(ENDS), "ms"]
            if len(ends):
                first = int(ends.min()) if first is None else min(first, int(ends.min()))
        if first is not None and not self.ended.exists():
            self.ended.update((first, False))
            self.handle.registerTimer(first + 1000 * self.seconds)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms, gone = self.ended.get()
        if not gone:
            self.ended.update((ms, True))
            yield pd.DataFrame({"run_id": [key[0]], "ended": [ms], "forgotten": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


class Deliveries(StatefulProcessor):
    """Numbers a run's events and lets them through up to its first end, which is marked; after it nothing comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "last long, closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, closed = self.state.get() if self.state.exists() else (0, False)
        if closed:
            return
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        end = events["event_type"].isin(ENDS).to_numpy()
        n = int(end.argmax()) + 1 if end.any() else len(events)
        self.state.update((last + n, bool(end.any())))
        out = events.iloc[:n]
        yield pd.DataFrame({"run_id": key[0], "sequence": range(last + 1, last + 1 + n), "event_type": out["event_type"], "event_id": out["event_id"], "last": end[:n]})

    def close(self) -> None:
        pass


def forgotten(events: DataFrame, seconds: int = RETENTION) -> DataFrame:
    """A stream of the runs that are forgotten, of a stream (user_id, ts, event_type)."""
    timed = events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", "0 seconds")
    out = timed.groupBy("user_id").transformWithStateInPandas(Retention(seconds), FORGOTTEN, "append", "EventTime")
    return out.select("run_id", F.timestamp_millis("ended").alias("ended"), F.timestamp_millis("forgotten").alias("forgotten"))


def delivered(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """A stream of what each subscriber gets: (subscriber, run_id, sequence, event_type), events after the one it has seen, and `closed` when the run ends.

    events: a stream of (user_id, ts, event_id, event_type); subscribers: (subscriber, run_id, after), a table that every batch is
    joined with, so a run's event is read once however many subscribe.
    """
    sent = events.groupBy("user_id").transformWithStateInPandas(Deliveries(), DELIVERED, "append", "none")
    close = F.struct((F.col("sequence") + 1).alias("sequence"), F.lit("closed").alias("event_type"))
    own = F.struct("sequence", "event_type")
    met = sent.join(subscribers, "run_id")
    kept = F.concat(F.when(F.col("sequence") > F.col("after"), F.array(own)).otherwise(F.slice(F.array(own), 1, 0)), F.when(F.col("last"), F.array(close)).otherwise(F.slice(F.array(close), 1, 0)))
    return met.select("subscriber", "run_id", F.explode(kept).alias("e")).select("subscriber", "run_id", "e.sequence", "e.event_type")


def run_stateful(spark: SparkSession, path: str, name: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over all that is in the folder now and returns the table of its rows.

    State that a processor declares needs the RocksDB store, which is set for this stream's session alone.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    target = fresh_path(spark, name)
    out = transform(file_stream(session, path))
    out.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{target}/out")
