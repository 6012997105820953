"""Conversations, runs and their event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The event log's names for the driver table's event types.
EVENT_NAMES = {"signup": "run.started", "view": "stage.started", "click": "tool.completed", "purchase": "run.completed", "error": "run.failed"}
TERMINAL = ("run.completed", "run.failed")


def event_log(events: DataFrame) -> DataFrame:
    """(run_id, sequence, event_type, event_id, ts, duration_ms): sequences count from 1 in each run."""
    name = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_NAMES.items()])
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("run_id"), seq.alias("sequence"), name.alias("event_type"), "event_id", "ts", F.floor(F.col("value")).cast("long").alias("duration_ms"))


def latest(log: DataFrame, n: int = 3) -> DataFrame:
    """The last n events of each run."""
    w = W.partitionBy("run_id").orderBy(F.col("sequence").desc())
    return log.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")


def replay(log: DataFrame, after: int, buffer: int) -> DataFrame:
    """Events after a sequence that a bounded buffer still holds; gap: some that were asked for are gone."""
    last = log.groupBy("run_id").agg(F.max("sequence").alias("last"))
    held = log.join(last, "run_id").withColumn("dropped", F.greatest(F.col("last") - buffer, F.lit(0)))
    return held.where((F.col("sequence") > after) & (F.col("sequence") > F.col("dropped"))).select("run_id", "sequence", "event_type", (F.lit(after) < F.col("dropped")).alias("gap"))


def state(log: DataFrame) -> DataFrame:
    """The last event, the last terminal event and counts of each run."""
    terminal = F.col("event_type").isin(*TERMINAL)
    return log.groupBy("run_id").agg(F.max("sequence").alias("last_sequence"), F.max_by("event_type", "sequence").alias("last_event"), F.max_by(F.when(terminal, F.col("event_type")), F.when(terminal, F.col("sequence"))).alias("last_terminal"), F.count_if(F.col("event_type") == "tool.completed").alias("tool_calls"))


def metrics(log: DataFrame, conversations: int) -> DataFrame:
    """Rollup per conversation over terminal events, of conversations that have events; see `rollup` for all."""
    terminal = F.col("event_type").isin(*TERMINAL)
    return log.groupBy((F.col("run_id") % conversations).alias("conversation_id")).agg(F.count_if(terminal).alias("run_count"), F.coalesce(F.sum(F.when(terminal, F.col("duration_ms"))), F.lit(0)).alias("duration_ms"), F.count_if(F.col("event_type") == "tool.completed").alias("tool_calls"))


def percentiles(log: DataFrame) -> DataFrame:
    """Mean, median and 95th percentile of durations by event type, interpolated linearly."""
    return log.groupBy("event_type").agg(F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.round(F.percentile("duration_ms", F.lit(0.5)), 6).alias("p50_ms"), F.round(F.percentile("duration_ms", F.lit(0.95)), 6).alias("p95_ms"))


def context(messages: DataFrame, n: int = 12) -> DataFrame:
    """The last n user and assistant messages of each conversation, joined in order."""
    spoken = messages.where(F.col("role").isin("user", "assistant"))
    last = spoken.withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))).where(F.col("back") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"])), ",")
    return last.groupBy("conv_id").agg(joined.alias("turns"), F.count(F.lit(1)).alias("n"))


def questions_of_answers(messages: DataFrame) -> DataFrame:
    """For each assistant message the nearest user message before it."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return messages.withColumn("question_turn", asked).where("role = 'assistant'").select("conv_id", "turn", "question_turn")


def run_status(log: DataFrame) -> DataFrame:
    """Status of each run: by its last event if that is terminal, else running; duration over all events."""
    last = F.max_by("event_type", "sequence")
    status = F.when(last == "run.completed", "completed").when(last == "run.failed", "failed").otherwise("running")
    return log.groupBy("run_id").agg(status.alias("status"), F.sum("duration_ms").alias("duration_ms"))


def busy(runs: DataFrame, conversations: int) -> DataFrame:
    """Conversations with more than one running run, which the service would refuse."""
    by = runs.where("status = 'running'").groupBy((F.col("run_id") % conversations).alias("conversation_id")).agg(F.count(F.lit(1)).alias("running"))
    return by.where("running > 1")


def persisted(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Events with their payload cut to the given keys where a tool completed; others keep theirs."""
    fields = F.from_json("props", "map<string,string>")
    kept = F.map_filter(fields, lambda k, v: k.isin(*keys))
    return events.select("event_id", F.when(F.col("event_type") == "click", F.to_json(kept)).otherwise(F.to_json(fields)).alias("payload"))


def superseded(messages: DataFrame) -> DataFrame:
    """Answers and whether a later answer to the same question replaced them; active: the last one."""
    asked = questions_of_answers(messages)
    w = W.partitionBy("conv_id", "question_turn")
    return asked.withColumn("replaced_by", F.when(F.max("turn").over(w) > F.col("turn"), F.max("turn").over(w)))


def turns(messages: DataFrame) -> DataFrame:
    """Messages grouped into turns: each user message opens one; what precedes the first is turn 0."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    numbered = messages.withColumn("group", F.sum((F.col("role") == "user").cast("long")).over(w))
    return numbered.groupBy("conv_id", "group").agg(F.count(F.lit(1)).alias("messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def without_runs(log: DataFrame, deleted: DataFrame) -> DataFrame:
    """The log after runs were deleted with their events."""
    return log.join(deleted.select("run_id").distinct(), "run_id", "left_anti")


# Event types that are stored; notices about the connection are not.
PERSISTED = ("run.started", "stage.started", "decision.recorded", "tool.started", "tool.completed", "tool.failed", "metrics.updated", "run.completed", "run.failed", "run.cancelled")
ENDINGS = {"run.completed": "completed", "run.failed": "failed", "run.cancelled": "cancelled"}


def stored(log: DataFrame) -> DataFrame:
    """The events that outlive the connection."""
    return log.where(F.col("event_type").isin(*PERSISTED))


def fallback_replay(log: DataFrame, after: int) -> DataFrame:
    """Stored events after a sequence, for a run whose buffer is gone; there is always a gap."""
    return stored(log).where(F.col("sequence") > after).select("run_id", "sequence", "event_type", F.lit(True).alias("gap"))


def finished(log: DataFrame) -> DataFrame:
    """(run_id, status, ended, and totals) of runs: by the first terminal event, after which nothing changes; else running."""
    end = F.col("event_type").isin(*ENDINGS)
    status = F.coalesce(*[F.when(F.min_by(F.when(end, F.col("event_type")), F.when(end, F.col("sequence"))) == k, F.lit(v)) for k, v in ENDINGS.items()], F.lit("running"))
    total = lambda name, kind: F.count_if(F.col("event_type") == kind).alias(name)
    return log.groupBy("run_id").agg(status.alias("status"), F.min(F.when(end, F.col("ts"))).alias("ended"), total("llm_calls", "stage.started"), total("tool_calls", "tool.completed"), F.sum("duration_ms").alias("duration_ms"), F.sum(F.length("event_type")).alias("input_tokens"), F.count(F.lit(1)).alias("output_tokens"))


def rollup(conversations: DataFrame, runs: DataFrame) -> DataFrame:
    """Six sums and the number of runs per conversation, over runs that ended; conversations without any have zeros.

    conversations: (conversation_id); runs: (conversation_id, status, input_tokens, output_tokens, llm_calls, tool_calls, duration_ms)."""
    sums = ("input_tokens", "output_tokens", "total_tokens", "llm_calls", "tool_calls", "duration_ms")
    ended = runs.where(F.col("status").isin(*ENDINGS.values())).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    totals = ended.groupBy("conversation_id").agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("run_count"))
    return conversations.select("conversation_id").distinct().join(totals, "conversation_id", "left").select("conversation_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*sums, "run_count")])


# Fixed value: what a run says that a stop of the service left behind.
ORPHANED = "Backend restarted before the run completed"


def orphans_ended(runs: DataFrame, now: Column) -> DataFrame:
    """runs (status, error, ended, ...) after a start of the service: those still running have nothing that could end them and are cancelled."""
    left = F.col("status") == "running"
    return runs.withColumns({"status": F.when(left, "cancelled").otherwise(F.col("status")), "error": F.when(left, ORPHANED).otherwise(F.col("error")), "ended": F.when(left, now).otherwise(F.col("ended"))})


def retained(runs: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Runs whose buffer is still there: those that go on, and those that ended less than `seconds` ago."""
    return runs.where(F.col("ended").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("ended") < seconds))


def recent(conversations: DataFrame, n: int) -> DataFrame:
    """The n conversations updated last, newest first."""
    return conversations.orderBy(F.col("updated_at").desc(), "conversation_id").limit(n)


def owned(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs asked for by (run_id, conversation_id); those of another conversation are not found."""
    return wanted.join(runs, ["run_id", "conversation_id"])


def regenerated(messages: DataFrame) -> DataFrame:
    """Messages (conversation_id, sequence, run_id, succeeded, replaces) with superseded_by.

    A regeneration that succeeded hides what it replaces from sequence `replaces` on up to its own; one that failed hides its own
    messages. The first that hides a message stays named.
    """
    tries = messages.where("replaces is not null").select("conversation_id", F.col("run_id").alias("by"), F.col("sequence").alias("own"), F.col("replaces").alias("since"), F.col("succeeded").alias("ok")).distinct()
    hit = (F.col("ok") & (F.col("sequence") >= F.col("since")) & (F.col("sequence") < F.col("own"))) | (~F.col("ok") & (F.col("run_id") == F.col("by")))
    hidden = messages.join(tries, "conversation_id").where(hit).groupBy("conversation_id", "sequence").agg(F.min_by("by", "own").alias("superseded_by"))
    return messages.join(hidden, ["conversation_id", "sequence"], "left")
