"""Bounded training samples: the rows with the smallest hashes of each class, chosen without sorting or windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: Rows that are taken of a class, on average at least, where one hash has more than the bound.
LEAST = 8


def smallest_hashes(df: DataFrame, by: str, keys: list[str], per_class: int, weight: Column | None = None, weight_per_class: int = 0) -> DataFrame:
    """At most about `per_class` rows of each value of `by`, of `weight_per_class` together: those whose hash bucket is lowest.

    Hashes are of a row's keys: its id and a hash of its text, taken before any join, so the rows of one id are told apart. Rows are counted by (class, hash bucket), a table of a
    bounded size per class; the driver reads the counts and sets one bucket limit per class. A class of fewer rows is taken whole; the
    last bucket is taken only if it fits. If the first does not, as in a very large class or where one row is repeated very often, its
    rows are taken at random at the share that the bounds leave, LEAST on average at least, so no class is lost.
    """
    own = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys]
    marked = df.where(F.col(by).isNotNull()).withColumn("_bucket", F.pmod(F.xxhash64(*own), F.lit(BUCKETS)).cast("int"))
    counts: dict[object, list[tuple[int, int, int]]] = {}
    for r in marked.groupBy(by, "_bucket").agg(F.count(F.lit(1)), F.sum(F.lit(0) if weight is None else weight)).collect():
        counts.setdefault(r[0], []).append((r[1], r[2], r[3]))
    keep = F.lit(False)
    for value, rows in counts.items():
        limit, total, held, share = -1, 0, 0, 1.0
        for b, n, w in sorted(rows):
            if total + n > per_class or weight is not None and held + w > weight_per_class:
                if limit < 0:
                    limit, share = b, max(LEAST / n, min(per_class / n, weight_per_class / w if w else 1.0))
                break
            limit, total, held = b, total + n, held + w
        chosen = (F.col(by) == F.lit(value)) & (F.col("_bucket") <= limit)
        keep = keep | (chosen if share >= 1 else chosen & (F.rand(17) < share))
    return marked.where(keep).drop("_bucket")
