"""Run events as a stream: sequences per run, equal to the batch numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import fresh_path

SCHEMA = "run_id long, sequence long, event_type string, event_id long"


def _number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Numbers a run's new events in event order after the ones numbered before; the state is one counter."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    last = state.get[0] if state.exists else 0
    state.update((last + len(rows),))
    yield pd.DataFrame({"run_id": key[0], "sequence": range(last + 1, last + 1 + len(rows)), "event_type": rows["event_type"], "event_id": rows["event_id"]})


def numbered(events: DataFrame) -> DataFrame:
    """A stream of (user_id, ts, event_id, event_type) with sequences per run; events of a run must arrive in order of time."""
    return events.groupBy("user_id").applyInPandasWithState(_number, SCHEMA, "last long", "append", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet folder as a stream."""
    batch = spark.read.parquet(path)
    folder, _, file = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(batch.schema)
    # the file source takes folders only: one file is its folder with a filter
    one = any(f.endswith(f"/{file}") for f in batch.inputFiles())
    return reader.option("pathGlobFilter", file).parquet(folder) if one else reader.parquet(path)


def run_available(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Numbers all events that are in the folder now and returns the table they were written to."""
    target = fresh_path(spark, name)
    query = numbered(file_stream(spark, path)).writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{target}/out")


BUFFER_SCHEMA = "run_id long, sequence long, event_type string, dropped_through long"
STATE_SCHEMA = "run_id long, last_sequence long, last_event string, tool_calls long"


def buffered(most: int):
    """State function: the last `most` events of a run and how many fell out before them."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        last, held = state.get if state.exists else (0, [])
        held = (list(held) + list(rows["event_type"]))[-most:]
        last += len(rows)
        state.update((last, held))
        first = last - len(held) + 1
        yield pd.DataFrame({"run_id": key[0], "sequence": range(first, last + 1), "event_type": held, "dropped_through": max(last - most, 0)})

    return keep


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The live state of a run: its last event and counts."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    last, tools = state.get if state.exists else (0, 0)
    last, tools = last + len(rows), tools + int((rows["event_type"] == "click").sum())
    state.update((last, tools))
    yield pd.DataFrame({"run_id": [key[0]], "last_sequence": [last], "last_event": [rows["event_type"].iloc[-1]], "tool_calls": [tools]})


def buffer_stream(events: DataFrame, most: int) -> DataFrame:
    """A run's buffer after each batch (update mode); memory per run is bounded by `most`."""
    return events.groupBy("user_id").applyInPandasWithState(buffered(most), BUFFER_SCHEMA, "last long, held array<string>", "update", GroupStateTimeout.NoTimeout)


def state_stream(events: DataFrame) -> DataFrame:
    """A run's state after each batch (update mode)."""
    return events.groupBy("user_id").applyInPandasWithState(_fold, STATE_SCHEMA, "last long, tools long", "update", GroupStateTimeout.NoTimeout)


def last_update(spark: SparkSession, path: str, name: str, transform: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Runs a stream in update mode over all files that are there and returns each run's rows of its last batch.

    A batch's rows go to a folder of its own, overwritten when the batch is repeated, so a restart doubles nothing.
    """
    target = fresh_path(spark, name)
    stream = file_stream(spark, path)

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/out/batch={batch}")

    transform(stream).writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(f"{schema}, batch int").parquet(f"{target}/out")
    newest = out.groupBy("run_id").agg(F.max("batch").alias("batch"))
    return out.join(newest, ["run_id", "batch"], "left_semi").drop("batch")
