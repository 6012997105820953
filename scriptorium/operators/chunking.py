"""Sections to chunks, nodes and the texts to embed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import each, hard_split, hash_vector, packed, sentences, short_hash

MAX_CHARS = 1800
OVERLAP = 1


def section_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, section, text): non-empty lines numbered from 1. Numbering stays inside the row, so nothing is shuffled."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return each(docs, ["doc_id"], kept, "pos", "text").select("doc_id", (F.col("pos") + 1).alias("section"), "text")


def chunks(docs: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, section, chunk, units, text): sentences packed greedily within a section, chunks numbered from 1."""
    units = F.flatten(F.transform(sentences(F.col("text")), lambda s: hard_split(s, most)))
    rows = each(section_rows(docs).withColumn("units", units), ["doc_id", "section"], packed(F.col("units"), most, overlap), "pos", "parts")
    return rows.select("doc_id", "section", (F.col("pos") + 1).alias("chunk"), F.size("parts").alias("units"), F.array_join("parts", " ").alias("text"))


def block_chunks(blocks: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, section, chunk, kind, units, text) of a section's blocks (doc_id, section, place, kind, text) in order.

    Text is packed by sentences; every other block (table, figure, caption, equation, code) is a chunk of its own, uncut, and parts the
    text: no chunk reaches over it, and the one after it begins without an overlap.
    """
    atom = (F.col("kind") != "text").cast("int")
    runs = blocks.withColumn("run", F.sum(atom).over(W.partitionBy("doc_id", "section").orderBy("place")))
    atoms = runs.where("kind <> 'text'").select("doc_id", "section", "run", "kind", F.lit(0).alias("pos"), F.lit(1).alias("units"), "text")
    inside = F.flatten(F.transform(sentences(F.col("text")), lambda s: hard_split(s, most)))
    texts = runs.where("kind = 'text'").select("doc_id", "section", "run", "place", inside.alias("u"))
    texts = texts.groupBy("doc_id", "section", "run").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "u"))), lambda x: x["u"])).alias("u"))
    packs = each(texts, ["doc_id", "section", "run"], packed(F.col("u"), most, overlap), "pos", "parts")
    packs = packs.select("doc_id", "section", "run", F.lit("text").alias("kind"), (F.col("pos") + 1).alias("pos"), F.size("parts").alias("units"), F.array_join("parts", " ").alias("text"))
    order = W.partitionBy("doc_id", "section").orderBy("run", "pos")
    return atoms.unionByName(packs).withColumn("chunk", F.row_number().over(order)).select("doc_id", "section", "chunk", "kind", "units", "text")


def chunk_nodes(docs: DataFrame) -> DataFrame:
    """Chunk nodes with ids, parents, hashes and the title-prefixed text to embed; a section's title is its first 60 characters."""
    title = docs.select("doc_id", F.substring("text", 1, 60).alias("title"))
    heads = section_rows(docs).select("doc_id", "section", F.substring("text", 1, 60).alias("section_title"))
    parent = F.format_string("%d:section:%04d", F.col("doc_id"), F.col("section"))
    return (
        chunks(docs)
        .join(heads, ["doc_id", "section"])
        .join(title, "doc_id")
        .select(
            F.format_string("%d:section:%04d:chunk:%04d", F.col("doc_id"), F.col("section"), F.col("chunk")).alias("node_id"),
            parent.alias("parent_id"),
            F.lit(2).alias("level"),
            "doc_id",
            "text",
            F.concat_ws("\n", "title", "section_title", "text").alias("embedding_text"),
            short_hash(F.col("text"), length=16).alias("content_hash"),
        )
    )


def vectors(nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(node_id, vec) by the hashing embedder."""
    return nodes.select(F.col(key).alias("node_id"), hash_vector(F.col(text)).alias("vec"))
