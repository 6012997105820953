"""Document fingerprints from closed syncmers and their positional matching, in DataFrame functions only.

A text is a sequence of units: runs of up to 12 non-blank characters, and single characters of scripts written without
blanks (case kept). The sequence is padded by k - 1 marks at either end, so that a text of a few units has k-mers of its
own as well. Every pair of neighbouring units (s = 2) has a 64-bit hash; a k-mer of k = 6 units is a closed syncmer when
the least hash of its k - 1 inner pairs is the first or the last one. That choice looks at the k-mer alone, so an edit
elsewhere moves no anchor. An anchor is (32-bit hash of the k-mer, its place in units), packed in a bigint; of anchors with one hash
the first place counts. The fingerprint holds all anchors, by hash, in hexadecimal.

Positional matching: anchors of two texts with the same hash are matched, and the matches are taken in the order of their places
in the one text; those whose place in the other text goes on in the same order count. Likeness is the Dice figure 2 m / (a + b) of
the m matches in order among a and b anchors: 1 for equal texts, near 0 for unrelated ones, and lower for the
same passages in another order.

A text without units has no anchor; two such texts have likeness 1. Null text counts as empty. Equal texts have equal fingerprints. Everything
is row-wise: no shuffle, no Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import shared_dir

K = 6
#: Scripts written without blanks, whose characters are units of their own.
UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
UNIT = rf"[^\s{UNSPACED}]{{1,12}}|\S"
#: High half of an anchor: the hash. Low half: twice the place, so that one bit is left for the side of a comparison.
HASH = -(1 << 32)


def _hash(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(HASH))


def with_anchors(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Adds `out`: array<bigint>, the anchors of the column `text`, by hash, each hash once."""
    units, pairs, marked, placed = (f"_{out}_{x}" for x in ("units", "pairs", "marked", "placed"))
    marks = lambda x: F.array_repeat(F.lit(x).cast("long"), k - 1)
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    df = df.withColumn(units, F.concat(marks(1), found, marks(2)))
    u = F.col(units)
    df = df.withColumn(pairs, F.transform(u, lambda x, i: F.xxhash64(x, F.get(u, i + 1))))
    g = F.col(pairs)
    last = F.size(u) - k if k > 1 else F.size(u) - 1  # start of the last k-mer

    def anchor(x: Column, i: Column) -> Column:
        inner = [x, *[F.get(g, i + j) for j in range(1, k - 1)]]
        closed = F.least(inner[0], inner[-1]) <= F.least(*inner[1:-1])
        whole = F.xxhash64(*inner[::2], *([] if k % 2 == 0 else [inner[-1]]))
        return F.when((i <= last) & closed, _hash(whole).bitwiseOR(F.shiftleft(i.cast("long"), 1)))

    df = df.withColumn(marked, F.transform(g, anchor))
    df = df.withColumn(placed, F.when(F.size(u) > 2 * (k - 1), F.sort_array(F.filter(marked, lambda a: a.isNotNull()))).otherwise(F.array().cast("array<bigint>")))
    s = F.col(placed)
    once = F.filter(s, lambda a, i: (i == 0) | (_hash(a) != _hash(F.get(s, i - 1))))
    return df.withColumn(out, once).drop(units, pairs, marked, placed)


def as_text(anchors: Column) -> Column:
    """16 hexadecimal digits an anchor: the hash, then twice the place."""
    return F.array_join(F.transform(anchors, lambda a: F.lower(F.lpad(F.hex(a), 16, "0"))), ",")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds `out`: the likeness (0 to 1) of the anchor columns a and b; null where one is null."""
    both, shared = f"_{out}_both", f"_{out}_shared"
    df = df.withColumn(both, F.sort_array(F.concat(F.col(a), F.transform(b, lambda x: x.bitwiseOR(F.lit(1).cast("long"))))))
    m = F.col(both)
    place = lambda x: F.shiftright(x.bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    ours = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 0

    def pair(x: Column, i: Column) -> Column:
        y = F.get(m, i + 1)
        of_a, of_b = F.when(ours(x), place(x)).otherwise(place(y)), F.when(ours(x), place(y)).otherwise(place(x))
        return F.when(_hash(x) == _hash(y), F.shiftleft(of_a, 31).bitwiseOR(of_b))

    df = df.withColumn(shared, F.sort_array(F.filter(F.transform(m, pair), lambda p: p.isNotNull())))
    p = F.col(shared)
    low = lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    in_order = F.size(F.filter(p, lambda x, i: (i == 0) | (low(x) > low(F.get(p, i - 1)))))
    total = F.size(F.col(a)) + F.size(F.col(b))
    value = F.when(total == 0, F.lit(1.0)).otherwise(2 * in_order / total)
    return df.withColumn(out, F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), value)).drop(both, shared)


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next distinct id in descending order, after the last the first.

    Ids alone are range-partitioned; within a range a window gives the next id, and the last id of each range takes
    the first of the next range from a table of one row per range. No task sees more than a range of ids.
    """
    shared_dir(ids.sparkSession)
    ranged = ids.select("doc_id").where("doc_id is not null").distinct().repartitionByRange(F.col("doc_id").desc())
    ranged = ranged.withColumn("part", F.spark_partition_id()).checkpoint()  # range bounds are drawn once
    firsts = ranged.groupBy("part").agg(F.max("doc_id").alias("first"))  # one row per range
    follow = firsts.select("part", F.coalesce(F.lead("first").over(W.orderBy("part")), F.max("first").over(W.partitionBy())).alias("follow"))
    within = F.lead("doc_id").over(W.partitionBy("part").orderBy(F.col("doc_id").desc()))
    return ranged.withColumn("own_next", within).join(follow, "part").select("doc_id", F.coalesce("own_next", "follow").alias("next_id"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: doc_id, n_chars, n_anchors, fingerprint."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = with_anchors(rows, "text", "anchors", k)
    return made.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("anchors").alias("n_anchors"), as_text(F.col("anchors")).alias("fingerprint"))


def compare_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited form, with likenesses; one row per input row.

    Edited: the last floor(n/2) code points replaced by the first as many of the next document (descending doc_id).
    A repeated doc_id counts once in the order, with its least text, and every row is answered. Null ids take no
    part in the order: their tail is replaced by nothing and near_next is null.

    A document's head travels to its predecessor only as far as the predecessor's half needs it.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = every.where("doc_id is not null")  # stated on both uses, so that one exchange of the texts serves both
    need = rows.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("need"))
    links = successors(rows).join(need, "doc_id").select(F.col("doc_id").alias("taker"), F.col("next_id").alias("doc_id"), "need")
    given = with_anchors(rows.join(links, "doc_id"), "text", "following", k)
    given = given.select(F.col("taker").alias("doc_id"), F.expr("substring(text, 1, need)").alias("head"), "following")
    given = given.groupBy("doc_id").agg(F.min(F.struct("head", "following")).alias("g")).select("doc_id", "g.head", "g.following")
    both = rows.join(given, "doc_id", "left").unionByName(every.where("doc_id is null"), allowMissingColumns=True)
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("head", F.lit("")), F.lit(1), half)))
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = with_anchors(with_anchors(both, "text", "own", k), "edited", "changed", k).drop("text", "edited", "head")
    both = with_likeness(with_likeness(both, "own", "changed", "near_edited"), "own", "following", "near_next")
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")
