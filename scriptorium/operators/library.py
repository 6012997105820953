"""Document structure, the library's health and evidence coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import each, short_hash


def lines(docs: DataFrame) -> DataFrame:
    """(source, doc_id, ord, line): trimmed non-empty lines."""
    parts = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return parts.withColumn("line", F.trim("line")).where("line <> ''")


def repeated_lines(docs: DataFrame, share: float = 0.6, least: int = 2) -> DataFrame:
    """Lines of 3 to 120 characters on at least max(least, ceil(share * pages)) pages of a source; a document is a page."""
    once = lines(docs).where(F.length("line").between(3, 120)).select("source", "doc_id", "line").distinct()
    pages = docs.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    counted = once.groupBy("source", "line").agg(F.count(F.lit(1)).alias("on_pages")).join(pages, "source")
    return counted.where(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(share * F.col("pages")))).select("source", "line", "on_pages")


#: Documents whose lengths are summed as one before running sums are taken.
PAGE_RANGE = 4096


def page_text(docs: DataFrame, budget: int) -> DataFrame:
    """The part of each source's running text that a character budget admits; the crossing page is cut, later ones drop.

    Lengths are summed by ranges of ids first; running sums go over ranges, and then inside the ranges that begin within
    the budget, so no task orders a whole source and no text is shuffled.
    """
    sizes = docs.select("source", "doc_id", F.floor(F.col("doc_id") / PAGE_RANGE).alias("part"), F.length("text").cast("long").alias("size"))
    totals = sizes.groupBy("source", "part").agg(F.sum("size").alias("total"))
    ahead = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    begun = totals.select("source", "part", F.coalesce(F.sum("total").over(ahead("source", "part")), F.lit(0)).alias("before_part")).where(F.col("before_part") < budget)
    inside = F.coalesce(F.sum("size").over(ahead("source", "part", "doc_id")), F.lit(0))
    seen = sizes.join(begun, ["source", "part"]).withColumn("before", F.col("before_part") + inside).where(F.col("before") < budget)
    taken = F.least("size", budget - F.col("before"))
    return seen.select("source", "doc_id", taken.alias("taken"), (taken < F.col("size")).alias("cut"))


def sections(docs: DataFrame) -> DataFrame:
    """Section nodes: one per non-empty line, with ids, levels and content hashes; numbered inside the row."""
    return section_nodes(docs).select("node_id", F.format_string("%d:root", F.col("doc_id")).alias("parent_id"), F.lit(1).alias("level"), short_hash(F.col("line"), length=16).alias("content_hash"))


def tree(docs: DataFrame) -> DataFrame:
    """Roots with their number of children; row-wise."""
    n = F.size(F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != ""))
    node = lambda k: F.format_string("%d:section:%04d", F.col("doc_id"), k)
    counted = docs.select("doc_id", n.alias("n")).where("n > 0")
    return counted.select(F.format_string("%d:root", "doc_id").alias("node_id"), F.col("n").cast("long").alias("children"), node(F.lit(1)).alias("first_child"), F.greatest(node(F.col("n")), node(F.least(F.col("n"), F.lit(9999)))).alias("last_child"))


def lowered(text: Column) -> Column:
    """Lower case, ß as ss: what full case folding gives for most Latin texts, without Python."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def distinct_texts(docs: DataFrame, fold: Callable[[Column], Column] = lowered) -> DataFrame:
    """First document of each normalised text: folded, line-break hyphens joined, blanks collapsed."""
    plain = F.regexp_replace(F.regexp_replace(fold(F.col("text")), "-\\s*\n\\s*", ""), "\\s+", " ")
    return docs.groupBy("source", F.sha2(F.trim(plain), 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("source", "doc_id", "copies")


def matching(nodes: DataFrame, kind: Column, wanted: str | None, texts: list[Column], needle: str) -> DataFrame:
    """Nodes of a kind (any, where none is named) with `needle` in their joined texts, whatever its case."""
    held = F.contains(F.lower(F.concat_ws(" ", *texts)), F.lit(needle.strip().lower()))
    return nodes.where(held if wanted is None else (kind == wanted) & held)


def health(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Indexed, flagged for a rebuild, and without a fingerprint, by source; a label's quality stands for the state."""
    joined = docs.select("doc_id", "source").join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("indexed"), F.count_if(F.col("quality") == 0).alias("needing_rebuild"), F.count_if(F.col("quality").isNull()).alias("without_fingerprint"))


#: Distinct papers and dimensions of a coverage matrix, each.
MOST_VALUES = 10_000


def coverage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells (source, lang) with their status: covered beats missing beats candidate beats empty."""
    sources, langs = docs.select("source").distinct(), docs.select("lang").distinct()  # dimensions, not rows
    if sources.limit(MOST_VALUES + 1).count() > MOST_VALUES or langs.limit(MOST_VALUES + 1).count() > MOST_VALUES:
        raise ValueError(f"a coverage matrix has at most {MOST_VALUES} values a side")
    cells = sources.crossJoin(F.broadcast(langs))
    judged = docs.join(labels, "doc_id", "left").groupBy("source", "lang").agg(F.max("quality").alias("best"), F.count(F.lit(1)).alias("candidates"))
    status = F.when(F.col("best") == 1, "covered").when(F.col("best") == 0, "missing").when(F.col("candidates") > 0, "candidate").otherwise("empty")
    return cells.join(judged, ["source", "lang"], "left").select("source", "lang", status.alias("status"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def coverage_ratios(cells: DataFrame) -> DataFrame:
    return cells.groupBy("source").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("status") == "covered").alias("covered"), F.round(F.count_if(F.col("status") == "covered") / F.count(F.lit(1)), 6).alias("coverage_ratio"), F.round(F.count_if(F.col("status") != "empty") / F.count(F.lit(1)), 6).alias("candidate_ratio"))


def anchors_found(benchmark: DataFrame, hits: DataFrame, docs: DataFrame, length: int = 40) -> DataFrame:
    """For each query, how many hits and whether one holds its anchor (the text's first characters, case folded).

    Only texts of documents that were hit are read on."""
    anchor = benchmark.select(F.col("item_id").alias("query_id"), F.lower(F.substring("text", 1, length)).alias("anchor"))
    texts = docs.select(F.col("doc_id").alias("node_id"), "text").join(hits.select("node_id").distinct(), "node_id", "left_semi")
    seen = hits.join(texts, "node_id").join(anchor, "query_id")
    return seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.contains(F.lower("text"), F.col("anchor"))).alias("with_anchor"))


def html_headings(pages: DataFrame) -> DataFrame:
    """First heading, paragraphs and title length of each page."""
    return pages.select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"))


def section_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node_id, line) of every non-empty line, numbered inside the row."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    rows = each(docs, ["doc_id"], kept, "pos", "line").withColumn("n", F.col("pos") + 1)
    return rows.select("doc_id", "n", F.format_string("%d:section:%04d", "doc_id", "n").alias("node_id"), "line")


def replaced(old: DataFrame, fresh: DataFrame, paper: str) -> DataFrame:
    """All nodes after fresh papers came: a paper's old nodes go as a whole, so none is left stale."""
    return old.join(fresh.select(paper).distinct(), paper, "left_anti").unionByName(fresh)


def unknown(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested ids that the library does not hold."""
    return asked.join(known.select(key), key, "left_anti")


def index_status(docs: DataFrame, labels: DataFrame) -> DataFrame:
    state = F.when(F.col("quality") == 0, "REBUILD").when(F.col("quality").isNull(), "unknown-fingerprint").otherwise("ok")
    return docs.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", state.alias("state"))


def inverted(docs: DataFrame) -> DataFrame:
    """(doc_id, index): each word's positions, as catalogues publish abstracts."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    at = each(docs, ["doc_id"], words, "pos", "word").groupBy("doc_id", "word").agg(F.collect_list("pos").alias("at"))
    return at.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))


def rebuilt(indexed: DataFrame) -> DataFrame:
    """The abstract of an inverted index: words by position, ties by word."""
    pairs = F.flatten(F.transform(F.map_entries("index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return indexed.select("doc_id", F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ").alias("abstract"))


def compared(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Cases of two evaluation runs side by side; a loss outweighs a gain, cases of one run only are left out."""
    recall = lambda side: F.when(F.col(f"{side}.with_anchor") > 0, 1).otherwise(0)
    b, c = recall("b"), recall("c")
    verdict = F.when(c < b, "regression").when(c > b, "improvement").otherwise("same")
    return baseline.alias("b").join(current.alias("c"), "query_id").select("query_id", F.col("b.hits").alias("baseline_hits"), F.col("c.hits").alias("current_hits"), (c - b).alias("recall_delta"), verdict.alias("verdict"))
