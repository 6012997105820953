"""Judgments, citations, artifact closure and the rules around an agent's tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import citation_markers, short_hash
from ..storage import fresh_path


def evidence_id(*parts: Column) -> Column:
    return F.concat(F.lit("E-"), short_hash(*parts))


def merged_judgments(judgments: DataFrame) -> DataFrame:
    """The last round's verdict of each (paper, dimension); its place stays that of the first round."""
    return judgments.groupBy("paper", "dimension").agg(F.max_by(F.struct("status", "cited"), "round").alias("v"), F.min("round").alias("first_round")).select("paper", "dimension", "v.status", "v.cited", "first_round")


def applied_judgments(judgments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdicts against the library: `covered` needs cited evidence of the same paper, or the cell counts as missing."""
    known = evidence.select(F.col("paper").alias("of"), F.col("evidence_id").alias("known_id")).distinct()
    cited = judgments.select("paper", "dimension", F.explode("cited").alias("cited_id")).distinct()
    valid = cited.join(known, (F.col("cited_id") == F.col("known_id")) & (F.col("paper") == F.col("of"))).groupBy("paper", "dimension").agg(F.count(F.lit(1)).alias("verified"))
    settled = F.when((F.col("status") == "covered") & (F.coalesce("verified", F.lit(0)) == 0), "missing").otherwise(F.col("status"))
    verified = F.when(F.col("status") == "covered", F.coalesce("verified", F.lit(0))).otherwise(0)
    return judgments.join(valid, ["paper", "dimension"], "left").select("paper", "dimension", settled.alias("status"), verified.cast("long").alias("verified"))


def checked_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every citation of an answer with its evidence; what the library does not hold stays, marked unknown."""
    cited = answers.select("answer_id", F.posexplode(citation_markers(F.col("text"))).alias("ord", "evidence_id"))
    return cited.join(evidence.select("evidence_id", F.lit(True).alias("known")).distinct(), "evidence_id", "left").select("answer_id", "ord", "evidence_id", F.coalesce("known", F.lit(False)).alias("known"))


def closure(spark: SparkSession, edges: DataFrame, seeds: DataFrame, most: int = 32) -> DataFrame:
    """(root, artifact): what each seed rests on through edges (artifact, source), itself included, safe with cycles.

    Semi-naive: a step joins only the pairs that are new. Each step's pairs are written once into a folder and all of them are read as one
    table, so plans, tasks and what the driver keeps do not grow with the steps, and no side is sent to the driver for a broadcast. Steps end when
    nothing is new; deeper graphs than `most` steps raise.
    """
    folder = fresh_path(spark, "closure")
    pairs = seeds.select(F.col("artifact").alias("root"), "artifact").distinct()
    schema = T.StructType([*pairs.schema.fields, T.StructField("step", T.IntegerType())])
    rests = edges.select("artifact", "source").hint("merge")
    for step in range(most + 1):
        pairs.write.option("compression", "zstd").parquet(f"{folder}/step={step}")
        found = spark.read.schema(schema).parquet(folder)
        fresh = found.where(F.col("step") == step).drop("step")
        if fresh.isEmpty():
            return found.drop("step")
        reached = fresh.join(rests, "artifact").select("root", F.col("source").alias("artifact")).distinct()
        pairs = reached.join(found.drop("step").hint("merge"), ["root", "artifact"], "left_anti")
    raise ValueError(f"artifacts nest deeper than {most} steps")


def screened(papers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A verdict for every candidate paper: unknown ids drop, omitted papers are irrelevant, the last verdict wins."""
    last = verdicts.groupBy("paper").agg(F.max_by("relevance", "ord").alias("relevance"))
    return papers.select("paper").distinct().join(last, "paper", "left").select("paper", F.coalesce("relevance", F.lit("irrelevant")).alias("relevance"))


def search_status(last_failure: Column, successes: Column, accepted: Column) -> Column:
    """Status of a search from its last failure's category, its successful searches and the papers accepted."""
    failed = F.when(last_failure == "rate_limited", "rate_limited").when(last_failure.isin("provider_error", "network_error"), "provider_error").otherwise("failed")
    return F.when(last_failure.isNotNull(), failed).when((successes > 0) & (accepted == 0), "no_matches").otherwise("completed")


def first_provider(results: DataFrame) -> DataFrame:
    """Per request the first provider in priority that found something, how many came back empty before it, or null."""
    some = F.col("found") > 0
    at = F.min(F.when(some, F.col("priority"))).alias("at")
    by_request = results.groupBy("request").agg(at, F.min_by(F.when(some, F.col("provider")), F.when(some, F.col("priority"))).alias("provider"), F.collect_list("priority").alias("tried"))
    before = F.size(F.filter("tried", lambda p: F.col("at").isNull() | (p < F.col("at"))))
    return by_request.select("request", "provider", before.alias("empty_before"))


def reader_rule(targets: Column, local: Column, source: Column, source_known: Column, corpus: Column) -> Column:
    """The policy rule that a reading task triggers, or null: counts of targets and of local ones, a cited search, whether
    that search exists, whether a local corpus exists."""
    no_target = F.when(corpus, F.when(source, "global_local_reader_does_not_require_search_source")).otherwise(F.when(~source_known, "reader_requires_search_source"))
    some_local = F.when(local < targets, "reader_local_targets_only").when(source, "local_reader_does_not_require_search_source")
    none_local = F.when(~source_known, "reader_requires_search_source").when(targets > 1, "external_reader_single_paper_only")
    return F.when(targets == 0, no_target).when(local > 0, some_local).otherwise(none_local)
