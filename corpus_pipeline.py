"""Training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows as Parquet into the shared
folder and reads them back as the next stage's docs. All but the last stage keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, ngram_join, packing, pii, quality
from scriptorium.llm.shared import stash


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the attention classifier, fitted on the labelled ones, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    return quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of five-word Jaccard links of 0.8 or more, that with the smallest doc_id, and every row without words."""
    return ngram_join.one_each(docs, n=5, t=80)


def benchmark_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the spans that occur in the benchmark."""
    return decontaminate.cut(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("near duplicates", near_duplicates),
    ("benchmark", benchmark_removal),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: The stages learn a model, link sets and tokenise; SQL cannot express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
