"""Lines that many documents share, found with levelled sorted runs of line hashes.

A line's key is the line without blanks at both ends, A-Z lowered; 128 bits of its hash stand for it. LineRuns keeps, for every
key, the number of documents that held it, as runs: tables in the shared folder, bucketed and sorted by the key, so that runs
meet each other and a batch without being shuffled. A new batch of documents
  1. is counted per key (partially in its map tasks, so a very frequent line travels once a task),
  2. is merge-anti-joined with the runs: keys that the runs already know as common are settled and add nothing,
  3. adds what is left as its own run of level 0; FAN_OUT runs of a level are merged into one of the next.
A key is read FAN_OUT times a level at most, and levels grow with the logarithm of the batches. What the runs know after the
last batch does not depend on how documents were dealt to batches.

Documents: null and empty text are one empty line. Keys shorter than `min_chars` stay. Repeated rows are documents of their own and
each is answered; doc_id may be null or of any type; extra columns are kept by `clean`, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BATCH_ROWS, discard, fresh_path, hot_keys, stash

BLANKS = b" \t\n\x0b\x0c\r"
KEY = ["hi", "lo"]
#: Runs of one level that are merged into one of the next.
FAN_OUT = 3
#: Batches that `clean` and `report` deal one table into, each about a delivery.
BATCHES = 5


class LineRuns:
    """Counts of documents by line key, in runs that are kept in `folder` and can be opened again.

    min_docs: from so many documents on a key is common. buckets: of every run, fixed when the folder is made; as many as
    shuffle partitions, so that batches arrive in the runs' partitioning.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, min_docs: int = 10, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.folder = folder or fresh_path(spark, "line-runs")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.step = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The runs as the last complete step left them; what an interrupted one wrote is not listed."""
        last = spark.read.option("recursiveFileLookup", "true").schema("step long, state string").json(f"{folder}/steps").orderBy(F.desc("step")).first()
        state = json.loads(last.state)
        runs = cls(spark, folder, state["min_docs"], state["buckets"])
        runs.levels, runs.step = state["levels"], last.step
        for name in sum(runs.levels, []):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (hi BIGINT, lo BIGINT, n BIGINT) USING parquet CLUSTERED BY (hi, lo) SORTED BY (hi, lo) INTO {runs.buckets} BUCKETS LOCATION '{folder}/{name}'")
        return runs

    def _write(self, level: int, counts: DataFrame) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.select(*KEY, "n").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _total(self, names: list[str]) -> DataFrame:
        files = [f"{self.folder}/{name}" for name in names]
        return self.spark.read.schema("hi long, lo long, n long").parquet(*files).groupBy(*KEY).agg(F.sum("n").alias("n"))

    def add(self, lines: DataFrame) -> None:
        """lines: (hi, lo), a row for each document and key of the batch."""
        batch, known = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), F.lit(0)
        for i, name in enumerate(sum(self.levels, [])):  # each meets a run as it lies
            batch = batch.join(self.spark.table(name).hint("merge").select(*KEY, F.col("n").alias(f"n{i}")), KEY, "left")
            known = known + F.coalesce(f"n{i}", F.lit(0))
        self._write(0, batch.where(known < self.min_docs))
        old: list[str] = []
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= FAN_OUT:
                names = self.levels[level]
                self._write(level + 1, self._total(names))
                self.levels[level], old = [], old + names
            level += 1
        self.step += 1
        state = json.dumps({"levels": self.levels, "buckets": self.buckets, "min_docs": self.min_docs})
        self.spark.createDataFrame([(self.step, state)], "step long, state string").coalesce(1).write.json(f"{self.folder}/steps/{self.step}")
        for name in old:  # the step that no longer lists them is written
            self.spark.sql(f"DROP TABLE {name}")
            discard(self.spark, f"{self.folder}/{name}")

    def common(self) -> DataFrame:
        """(hi, lo, n): keys of min_docs documents or more. n is exact up to the batch in which the key became common."""
        names = sum(self.levels, [])
        if not names:
            return self.spark.createDataFrame([], "hi long, lo long, n long")
        return self._total(names).where(F.col("n") >= self.min_docs)


def _row_keys(docs: DataFrame) -> list[Column]:
    """128 bits for a row's doc_id and text; equal for wholly equal rows only."""
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if "doc_id" in docs.columns else F.lit(""), F.coalesce("text", F.lit(""))]
    return [F.xxhash64(*own).alias("k1"), F.xxhash64(*own[::-1]).alias("k2")]


_LINES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("line", pa.int32()), ("first", pa.bool_())])


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(k1, k2, hi, lo, line, first): a row for each line whose key counts; first: the key's first line in its document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, whole.num_rows, BATCH_ROWS)):
            digests, row, place, first = bytearray(), [], [], []
            for r, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                seen: set[bytes] = set()
                for i, line in enumerate(text.split(b"\n") if text else ()):
                    key = line.strip(BLANKS).lower()
                    if len(key) >= 4 * min_chars or len(key.decode("utf-8")) >= min_chars:
                        digest = xxhash.xxh3_128_digest(key)
                        digests += digest
                        row.append(r)
                        place.append(i)
                        first.append(digest not in seen)
                        seen.add(digest)
            both = np.frombuffer(bytes(digests), ">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(place, pa.int32()), pa.array(first, pa.bool_())], schema=_LINES)

    return docs.select(*_row_keys(docs), "text").mapInArrow(each, "k1 long, k2 long, hi long, lo long, line int, first boolean")


def _matches(lines: DataFrame, common: DataFrame) -> DataFrame:
    """The lines whose key is common. A key of very many lines is joined by broadcast; there are fewer than a thousand such keys."""
    hot, common = hot_keys(lines, "hi"), common.select(*KEY)
    if not hot:
        return lines.join(common, KEY, "left_semi")
    is_hot = F.col("hi").isin(hot)
    return lines.where(is_hot).join(F.broadcast(common.where(is_hot)), KEY, "left_semi").unionByName(lines.where(~is_hot).join(common, KEY, "left_semi"))


def _dropped(docs: DataFrame, min_docs: int, min_chars: int, batches: int) -> DataFrame:
    """(k1, k2, lines): the line numbers that each document loses; documents that lose none are absent."""
    spark = docs.sparkSession
    path = fresh_path(spark, "lines")
    line_keys(docs, min_chars).withColumn("batch", F.pmod("k1", F.lit(batches)).cast("int")).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    lines = spark.read.schema("k1 long, k2 long, hi long, lo long, line int, first boolean, batch int").parquet(path)
    runs = LineRuns(spark, min_docs=min_docs)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).where("first").select(*KEY))
    found = _matches(lines.select("k1", "k2", *KEY, "line"), stash(runs.common(), "common-lines"))
    return found.groupBy("k1", "k2").agg(F.collect_set("line").alias("lines"))


def _cut(docs: DataFrame, dropped: DataFrame, keep: list[str]) -> DataFrame:
    """(row, text, n_lines, n_dropped); row: a structure of the columns to keep."""
    marked = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("row"), "text", *_row_keys(docs))
    marked = marked.join(dropped, ["k1", "k2"], "left").select("row", "text", "lines")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, whole.num_rows, BATCH_ROWS)):
            texts, total, gone = [], [], []
            for text, lines in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lines").to_pylist(), strict=True):
                total.append(text.count(b"\n") + 1 if text else 1)
                gone.append(len(lines or ()))
                if lines:
                    out = set(lines)
                    text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in out)
                texts.append(text)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("row"), *columns], names=["row", "text", "n_lines", "n_dropped"])

    return marked.mapInArrow(each, f"row {marked.schema['row'].dataType.simpleString()}, text string, n_lines long, n_dropped long")


def report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, and text without the lines that min_docs documents or more hold."""
    return _cut(docs, _dropped(docs, min_docs, min_chars, batches), ["doc_id"]).select("row.doc_id", "n_lines", "n_dropped", "text")


def clean(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """docs with its own columns, texts without the lines that min_docs documents or more hold."""
    out = _cut(docs, _dropped(docs, min_docs, min_chars, batches), [c for c in docs.columns if c != "text"])
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
