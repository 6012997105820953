"""Collections: node tables in a shared folder that carry the signature of the index they were built with.

nodes/part=<name>/ are Parquet files of one write, removed/part=<name>/ the papers whose earlier nodes it hides, steps/<n>/ the
commit that lists the parts in their order beside the metadata. A step is written only if it does not exist yet, so of two
writers at a time one fails and nothing of it is seen; so is what an interrupted write left. A reader of a step sees that step.

A collection built with another signature would mix vectors of two spaces: writing, vector search and reading stored vectors then fail, while
keyword search and deleting, which touch no vector, do not.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import index_fingerprint
from ..operators import retrieval

# What every collection's metadata says.
SPACE, SCHEMA_VERSION = "cosine", 4


@dataclass(frozen=True)
class Signature:
    """What an index is built with."""

    model: str
    dimensions: int | None
    chunker: str
    parser: str
    schema: int = SCHEMA_VERSION

    def fingerprint(self, spark: SparkSession) -> str:
        own = index_fingerprint(*(F.lit(v) for v in (self.model, self.dimensions or 0, self.chunker, self.parser, self.schema)))
        return spark.range(1).select(own.alias("f")).first().f


class SignatureMismatch(RuntimeError):
    """The collection was built with another signature."""


class Collection:
    """An open collection; made if the folder holds none.

    nodes: (paper, node_id, text, vec, ...), the same columns in every write. signature: of the code that opens it; enforce=False lets every
    action through.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "papers", signature: Signature | None = None, enforce: bool = True):
        if len(name) < 3:
            raise ValueError("a collection's name has three characters at least")
        self.spark, self.folder, self.name, self.enforce = spark, f"{folder.rstrip('/')}/{name}", name, enforce
        self.signature = signature.fingerprint(spark) if signature else None
        if self._last() is None:
            made = {"space": SPACE, "schema_version": SCHEMA_VERSION}
            self._commit(0, {"parts": [], "metadata": made | ({"index_signature": self.signature, "embedding_model": signature.model} if signature else {})})

    # commits

    def _last(self) -> tuple[int, dict] | None:
        try:
            steps = self.spark.read.option("recursiveFileLookup", "true").schema("step int, state string").json(f"{self.folder}/steps")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        row = steps.orderBy(F.desc("step")).first()
        return (row.step, json.loads(row.state)) if row else None

    def _commit(self, step: int, state: dict) -> None:
        self.spark.createDataFrame([(step, json.dumps(state))], "step int, state string").coalesce(1).write.mode("error").json(f"{self.folder}/steps/{step}")

    @property
    def metadata(self) -> dict:
        return self._last()[1]["metadata"]

    @property
    def stored_signature(self) -> str | None:
        return self.metadata.get("index_signature")

    def matches(self) -> bool:
        """Whether the signatures agree; one that is unknown agrees with any."""
        stored = self.stored_signature
        return self.signature is None or stored is None or stored == self.signature

    def check(self, action: str) -> None:
        if self.enforce and not self.matches():
            raise SignatureMismatch(f"{action} refused: collection '{self.name}' was built with index signature {self.stored_signature}, not {self.signature}; build a new one, or open it with enforce=False")

    # writes

    def _write(self, nodes: DataFrame | None, papers: DataFrame) -> None:
        step, state = self._last()
        part = uuid.uuid4().hex
        if nodes is not None:
            nodes.write.parquet(f"{self.folder}/nodes/part={part}")
        papers.select("paper").distinct().write.parquet(f"{self.folder}/removed/part={part}")
        self._commit(step + 1, state | {"parts": [*state["parts"], [part, nodes is not None]]})

    def replace(self, nodes: DataFrame) -> None:
        """Adds nodes; whatever the collection held of their papers goes as a whole."""
        self.check("Index write")
        self._write(nodes, nodes)

    def delete(self, papers: DataFrame) -> None:
        self._write(None, papers)

    def compact(self) -> None:
        """All that is to be seen as one part; the files before stay for readers that are under way."""
        step, state = self._last()
        part = uuid.uuid4().hex
        rows = self._rows()
        if rows is not None:
            rows.write.parquet(f"{self.folder}/nodes/part={part}")
            self._commit(step + 1, state | {"parts": [[part, True]]})

    # reads

    def _rows(self) -> DataFrame | None:
        """One scan of the listed parts; rows of papers that a later part replaced or removed are left out."""
        parts = self._last()[1]["parts"]
        held = [p for p, some in parts if some]
        if not held:
            return None
        place = F.create_map(*[F.lit(x) for i, (p, _) in enumerate(parts) for x in (p, i)])
        read = lambda kind, names: self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{kind}/part={p}" for p in names])
        rows = read("nodes", held).withColumn("_at", place[F.col("part").cast("string")]).drop("part")
        later = [p for p, _ in parts[1:]]  # the first part has nothing before it
        if later:
            gone = read("removed", later).select("paper", place[F.col("part").cast("string")].alias("_gone")).groupBy("paper").agg(F.max("_gone").alias("_gone"))
            rows = rows.join(gone, "paper", "left").where(F.col("_gone").isNull() | (F.col("_at") >= F.col("_gone"))).drop("_gone")
        return rows.drop("_at")

    def _all(self) -> DataFrame:
        rows = self._rows()
        if rows is None:
            raise ValueError(f"collection '{self.name}' holds no nodes yet")
        return rows

    def nodes(self, papers: list | None = None) -> DataFrame:
        """Stored nodes with their vectors; papers narrows the scan."""
        self.check("Stored embedding read")
        rows = self._all()
        return rows if papers is None else rows.where(F.col("paper").isin(list(papers)))

    def similar(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, node_id, score, rank) of the k nearest nodes of each (query_id, qvec)."""
        self.check("Vector retrieval")
        return retrieval.vector_top_k(queries, self._all().select("node_id", "vec"), k)

    def containing(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, node_id, score, matched, rank) by the words of each (query_id, text)."""
        return retrieval.keyword_top_k(queries, self._all().select("node_id", "text"), "query_id", "node_id", k)
