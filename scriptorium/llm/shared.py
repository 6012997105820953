"""Helpers that several training-data operators use."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, shared_dir, stash

__all__ = ["ASCII_LOWER", "WORD", "attach", "by_text", "components", "crc_mod", "discard", "fresh_path", "mix64", "paths", "release_memory", "sha256_hex", "shared_dir", "stash"]

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lower-cases A-Z only, as the contracts ask.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def release_memory() -> None:
    """Gives a task's freed memory back to the system; Python workers outlive tasks and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def paths(stored: DataFrame) -> list[str]:
    """The folder of a stored table that is read as it was written."""
    return sorted({f.rpartition("/")[0] for f in stored.inputFiles()})


def discard(spark: SparkSession, folders: str | list[str]) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    for folder in [folders] if isinstance(folders, str) else folders:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


#: Texts that a map holds as Python strings at a time.
BATCH_ROWS = 256


def by_text(docs: DataFrame, rows: Callable[[list[str | None]], tuple[list[int] | None, list]], fields: str, arrow: pa.Schema) -> DataFrame:
    """Map-only: doc_id and the columns that `rows` makes of each batch's texts.

    rows gives (source, columns): `source` is each output row's position in the batch, None where there is one row a text.
    doc_id passes through Arrow as it came, whatever its type and however many are null.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, whole.num_rows, BATCH_ROWS)):
            source, columns = rows(b.column("text").to_pylist())
            ids = b.column("doc_id") if source is None else b.column("doc_id").take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True))], names=["doc_id", *arrow.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, {fields}")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sha256_hex(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8") if isinstance(data, str) else data).hexdigest()


_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64's finaliser)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: A key with more than this part of all rows is joined by broadcast; there are fewer such keys than its inverse.
HOT_SHARE = 1 / 1000


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys with more than HOT_SHARE of all rows; fewer than 1 / HOT_SHARE."""
    total = rows.count()
    if total <= 1 / HOT_SHARE:
        return []
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counted.where(F.col("n") > total * HOT_SHARE).select(key).collect()]


def attach(rows: DataFrame, values: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """rows joined with `values`, whose `key` is unique, where a few keys may hold most of the rows.

    The hot keys' values are a broadcast of a proven size (see hot_keys); the other rows are joined by shuffle, where none
    of their keys is large. rows are read more than once, so they should be stored.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(values, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(values.where(F.col(key).isin(hot))), key, how).unionByName(rows.where(~is_hot).join(values, key, how))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) links: (id, component) for every linked id, component = smallest id reachable.

    Each round gives an id the least of its label, its label's label and the labels' labels of its neighbours, and gives
    the neighbours' least to the row of its label too, so that trees hook on to each other as wholes (FastSV). Labels only
    fall, and stay within a component; the rounds end when none moves. Paths of 2,000 to 200,000 ids in random and
    adverse orders took 12 to 20 rounds in a model. Every round is joins and partially aggregated minima over the
    links alone, and ends in a checkpoint. An id with very many links, or a label of very many ids, is joined by broadcast.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = both.checkpoint()
    centres = hot_keys(both, "b")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    moved = True
    while moved:
        far = attach(labels, labels.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "inner")
        near = attach(both, far.select(F.col("id").alias("b"), "far"), "b", "inner", centres).groupBy(F.col("a").alias("id")).agg(F.min("far").alias("near"))
        step = far.join(near, "id")
        own = step.select("id", F.least("far", "near").alias("low"), F.col("label").alias("old"))
        hooks = step.where("near < far").groupBy(F.col("label").alias("id")).agg(F.min("near").alias("hook"))
        labels_new = own.join(hooks, "id", "left").select("id", F.least("low", "hook").alias("label"), "old").checkpoint()
        moved = labels_new.where("label != old").limit(1).count() > 0
        labels = labels_new.select("id", "label")
    return labels.select("id", F.col("label").alias("component"))
