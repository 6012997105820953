"""What a reader makes of its retrieval rounds: the evidence library, coverage over rounds, verified citations and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evidence import evidence_id
from .retrieval import top_k

MOST_VERIFIED = 12
MOST_LIMITATIONS = 8


def evidence_library(hits: DataFrame, extracts: DataFrame, metadata: DataFrame) -> DataFrame:
    """(request, evidence_id, paper, chunk_id, text, score): every node that a round retrieved, as its first hit had it.

    hits: (request, round, ord, node_id, paper, text, score). A request without hits rests on its extracted text, and one without
    that on its metadata, each (request, paper, text) and one passage of score 1.
    """
    first = hits.groupBy("request", "node_id").agg(F.min_by(F.struct("paper", "text", "score"), F.struct("round", "ord")).alias("h"))
    found = first.select("request", F.col("h.paper").alias("paper"), F.col("node_id").cast("string").alias("chunk_id"), "h.text", F.col("h.score").cast("double").alias("score"))

    def passage(rows: DataFrame, kind: str, default: str) -> DataFrame:
        paper = F.coalesce("paper", F.lit(default))
        return rows.select("request", paper.alias("paper"), F.concat(paper, F.lit(f":{kind}")).alias("chunk_id"), "text", F.lit(1.0).alias("score"))

    read = passage(extracts.join(hits, "request", "left_anti"), "pdf-extraction", "external-paper")
    known = passage(metadata.join(hits, "request", "left_anti").join(extracts, "request", "left_anti"), "metadata", "local-metadata")
    return found.unionByName(read).unionByName(known).withColumn("evidence_id", evidence_id(F.col("chunk_id")))


def rounds_summary(reports: DataFrame, hits: DataFrame) -> DataFrame:
    """(request, unique_hits, missing, latest_strategy) over all rounds of a request.

    reports: (request, round, strategy, missing array). Missing papers come in the order in which rounds first named them; the strategy is that
    of the last round that has one.
    """
    nodes = hits.groupBy("request").agg(F.count_distinct("node_id").alias("unique_hits"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("round", "missing"))), lambda r: r["missing"])
    over = reports.groupBy("request").agg(F.array_distinct(F.flatten(named)).alias("missing"), F.max_by("strategy", F.when(F.col("strategy").isNotNull(), F.col("round"))).alias("latest_strategy"))
    return over.join(nodes, "request", "left").select("request", F.coalesce("unique_hits", F.lit(0)).alias("unique_hits"), "missing", "latest_strategy")


def merged_coverage(cells: DataFrame, missing: DataFrame, preferred: DataFrame) -> DataFrame:
    """(request, paper, dimension, paper_pos, dimension_pos, status, evidence): one matrix a request over all its rounds.

    cells: (request, round, ord, paper, dimension, evidence array); missing: (request, round, ord, paper); preferred: (request,
    ord, dimension), the plan's dimensions, which replace those seen. Papers and dimensions come as first seen, a round's cells before its
    missing papers. Evidence of a cell is distinct, in the order of the rounds.
    """
    at = lambda kind: F.struct("round", F.lit(kind).alias("kind"), "ord").alias("at")
    papers = cells.select("request", "paper", at(0)).unionByName(missing.select("request", "paper", at(1))).groupBy("request", "paper").agg(F.min("at").alias("at"))
    seen = cells.groupBy("request", "dimension").agg(F.min(F.struct("round", "ord")).alias("at")).join(preferred, "request", "left_anti")
    planned = preferred.groupBy("request", "dimension").agg(F.min(F.struct(F.lit(0).cast(cells.schema["round"].dataType).alias("round"), F.col("ord").cast(cells.schema["ord"].dataType).alias("ord"))).alias("at"))
    place = lambda df, pos: df.select("*", F.row_number().over(W.partitionBy("request").orderBy("at")).alias(pos)).drop("at")
    grid = place(papers, "paper_pos").join(place(seen.unionByName(planned), "dimension_pos"), "request")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("round", "ord", "evidence"))), lambda c: c["evidence"])
    held = cells.groupBy("request", "paper", "dimension").agg(F.array_distinct(F.flatten(in_order)).alias("evidence"))
    evidence = F.coalesce("evidence", F.array().cast("array<string>"))
    status = F.when(F.size(evidence) > 0, "candidate").otherwise("empty")
    return grid.join(held, ["request", "paper", "dimension"], "left").select("request", "paper", "dimension", "paper_pos", "dimension_pos", status.alias("status"), evidence.alias("evidence"))


def verified_citations(citations: DataFrame, verdicts: DataFrame, most: int = MOST_VERIFIED) -> DataFrame:
    """citations (answer_id, ord, evidence_id, known) with checked, supported and issue.

    The first `most` known citations of an answer are checked. Unknown ids are an issue of their own; a checked citation
    is one where a verdict (answer_id, evidence_id, supported) is negative or there is none.
    """
    limit = top_k(citations.where("known"), ["answer_id"], [F.col("ord")], most).groupBy("answer_id").agg(F.max("ord").alias("last"))
    said = verdicts.groupBy("answer_id", "evidence_id").agg(F.bool_or("supported").alias("yes"), F.bool_or(~F.col("supported")).alias("no"))
    rows = citations.join(limit, "answer_id", "left").join(said, ["answer_id", "evidence_id"], "left")
    checked = F.col("known") & F.coalesce(F.col("ord") <= F.col("last"), F.lit(False))
    issue = F.when(~F.col("known"), "unknown_evidence_id").when(checked & F.coalesce("no", F.lit(True)), "unsupported_claim")
    return rows.select("answer_id", "ord", "evidence_id", "known", checked.alias("checked"), (checked & F.coalesce("yes", F.lit(False))).alias("supported"), issue.alias("issue"))


def valid_references(references: DataFrame, library: DataFrame, limitations: DataFrame, most: int = MOST_LIMITATIONS) -> DataFrame:
    """(report_id, kept, removed, limitations): a report's references (report_id, ord, evidence_id) that the library holds.

    What was removed is said in its limitations (report_id, limitations array), of which `most` stay where something is added.
    """
    known = library.select("evidence_id", F.lit(True).alias("known")).distinct()
    marked = references.join(known, "evidence_id", "left")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("ord", "evidence_id")))), lambda r: r["evidence_id"])
    counted = marked.groupBy("report_id").agg(kept.alias("kept"), F.count_if(F.col("known").isNull()).alias("removed"))
    note = F.array(F.concat(F.lit("Removed "), F.col("removed").cast("string"), F.lit(" evidence reference(s) not present in the library")))
    before = F.coalesce("limitations", F.array().cast("array<string>"))
    after = F.when(F.col("removed") > 0, F.slice(F.concat(before, note), 1, most)).otherwise(before)
    return counted.join(limitations, "report_id", "left").select("report_id", "kept", "removed", after.alias("limitations"))
