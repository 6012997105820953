"""Sections of plain text: headings, parents by level, paths, bodies, ordered children, captions and their objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import body_text, each, named_heading, numbered_heading, squeezed

#: Heading levels that a numbered title can have.
LEVELS = 5
BODY = "Document Body"


def parsed_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, index, title, level, body): a text's sections in order, from 1.

    Headings are numbered titles, or titles by name: all names where a text has no numbered title, else a few. A section's body
    is what follows its heading up to the next; what precedes the first heading belongs to none. A text without headings is one
    section named BODY. Everything happens inside the row.
    """
    lines = F.transform(F.split(text, "\n"), squeezed)
    numbered = F.transform(F.col("lines"), lambda x: numbered_heading(x))
    rows = docs.select(key, lines.alias("lines")).withColumn("numbered", numbered)
    some = F.exists("numbered", lambda h: h.isNotNull())
    rows = rows.withColumn("some", some)
    heads = F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.coalesce(F.get("numbered", i), named_heading(x, F.col("some"))).alias("h")))
    rows = rows.withColumn("heads", F.filter(heads, lambda x: x["h"].isNotNull()))

    def section(x: Column, k: Column) -> Column:
        after = F.coalesce(F.get("heads", k + 1)["at"], F.size("lines"))
        body = body_text(F.slice("lines", x["at"] + 2, F.greatest(after - x["at"] - 1, F.lit(0))))
        return F.struct((k + 1).alias("n"), x["h"]["index"].alias("index"), x["h"]["title"].alias("title"), x["h"]["level"].alias("level"), body.alias("body"))

    whole = F.array(F.struct(F.lit(1).alias("n"), F.lit(None).cast("string").alias("index"), F.lit(BODY).alias("title"), F.lit(1).alias("level"), body_text(F.col("lines")).alias("body")))
    every = F.when(F.size("heads") == 0, whole).otherwise(F.transform("heads", section))
    return rows.select(key, F.explode(every).alias("s")).select(key, "s.*")


def with_parents(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds parent: the nearest section before of a smaller level, if that is one level up; and path: labels from the top.

    A level that was skipped leaves a section without a parent. Levels number LEVELS at most, so each is one window frame over
    the sections of a text, without their bodies.
    """
    label = F.concat_ws(" ", "index", "title")
    here = F.struct("level", "n", label.alias("label"))
    before = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    rows = sections.select(key, "n", "index", "title", "level", label.alias("label"))
    for lv in range(1, LEVELS):
        last = F.last(F.when(F.col("level") <= lv, here), ignorenulls=True).over(before)
        rows = rows.withColumn(f"s{lv}", F.when(last["level"] == lv, last))
    up = [F.col(f"s{lv}") for lv in range(1, LEVELS)]
    parent = F.coalesce(*[F.when(F.col("level") == lv + 1, up[lv - 1]["n"]) for lv in range(1, LEVELS)])
    # from the own level upwards until one is missing
    chain = F.reverse(F.slice(F.array(*up), 1, F.greatest(F.col("level") - 1, F.lit(0))))
    start = F.struct(F.lit(True).alias("on"), F.array(F.col("label")).alias("labels"))
    add = lambda acc, x: F.when(acc["on"] & x.isNotNull(), F.struct(F.lit(True).alias("on"), F.concat(F.array(x["label"]), acc["labels"]).alias("labels"))).otherwise(F.struct(F.lit(False).alias("on"), acc["labels"].alias("labels")))
    return rows.withColumn("parent", parent).withColumn("path", F.aggregate(chain, start, add, lambda acc: acc["labels"])).drop("label", *[f"s{lv}" for lv in range(1, LEVELS)])


def children(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parent, children): the sections under each section in order, null for the root; sections without a parent hang from it."""
    return sections.groupBy(key, "parent").agg(F.transform(F.array_sort(F.collect_list("n")), lambda n: n.cast("string")).alias("children"))


def attached_captions(blocks: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks (key, ord, type, kind, label) of sections: (objects with caption_ord, captions that found no object).

    A caption belongs to the last object of its kind and label in its section; the last such caption wins, and all are taken out of the text.
    """
    at = [*key, "kind", "label"]
    objects, captions = blocks.where("type = 'object'"), blocks.where("type = 'caption'")
    last = objects.where("label is not null").groupBy(*at).agg(F.max("ord").alias("ord"))
    said = captions.where("label is not null").groupBy(*at).agg(F.max("ord").alias("caption_ord"))
    found = last.join(said, at).select(*key, "ord", "caption_ord")
    return objects.join(found, [*key, "ord"], "left"), captions.join(last.select(*at), at, "left_anti")


def assigned_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, section): every non-empty line's section, that of the last heading before it; 0 is the front matter."""
    lines = F.filter(F.transform(F.split(text, "\n"), squeezed), lambda x: x != "")
    heads = each(docs, [key], F.transform(lines, lambda x: numbered_heading(x).isNotNull().cast("int")), "ord", "head")
    return heads.select(key, "ord", F.sum("head").over(W.partitionBy(key).orderBy("ord")).cast("int").alias("section"))
