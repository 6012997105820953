"""Small values as columns: markdown rows, excerpts, message texts, assignments, fingerprints, vectors, boxes, dates."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm


def markdown_row(cells: Column, width: Column) -> Column:
    """A table row: cells with blanks collapsed and pipes escaped, padded to `width` with empty ones."""
    plain = F.transform(cells, lambda c: F.replace(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " ")), F.lit("|"), F.lit("\\|")))
    padded = F.concat(plain, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def excerpt(text: Column, most: int = 280) -> Column:
    return F.substring(text, 1, most)


def compact(text: Column, most: int = 1000) -> Column:
    """A text cut to `most` characters, dots included, where it is longer."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def message_text(content: Column) -> Column:
    """The text of a message's JSON content: a string, or the texts of its blocks one after the other."""
    plain = F.from_json(F.concat(F.lit('{"t":'), content, F.lit("}")), "t string")["t"]
    blocks = F.from_json(content, "array<struct<type: string, text: string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.when(content.startswith("["), F.array_join(texts, "")).otherwise(plain)


def assignment(text: Column) -> Column:
    """struct(key, value) of a text `key=value`, split at its first sign of equality; null without one or with an empty side."""
    at = F.instr(text, "=")
    key, value = F.btrim(F.substring(text, F.lit(1), at - 1)), F.btrim(F.substring(text, at + 1, F.length(text)))
    return F.when((at > 0) & (key != "") & (value != ""), F.struct(key.alias("key"), value.alias("value")))


def index_fingerprint(model: Column, dimensions: Column, chunker: Column, parser: Column, schema: Column) -> Column:
    """Identity of an index: the first 16 hexadecimal digits over what it was built with."""
    return F.substring(F.sha2(F.concat_ws("|", model, F.coalesce(dimensions, F.lit(0)).cast("string"), chunker, parser, schema.cast("string")), 256), 1, 16)


def unit(vector: Column) -> Column:
    """A vector of length 1 in the same direction; a zero vector is an error."""
    length = norm(vector)
    return F.when(length == 0, F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>")).otherwise(F.transform(vector, lambda x: x.cast("double") / length))


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two boxes struct(x0, y0, x1, y1) share."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def normal_box(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of the page, within 0 and 1."""
    share = lambda v, of: F.least(F.greatest(v / of, F.lit(0.0)), F.lit(1.0))
    return F.struct(share(box["x0"], width).alias("x0"), share(box["y0"], height).alias("y0"), share(box["x1"], width).alias("x1"), share(box["y1"], height).alias("y1"))


def published(date: Column, year: Column) -> Column:
    """A date, or January 1st of a year, as a time in UTC."""
    return F.coalesce(F.try_to_timestamp(date), F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp"))


def retry_seconds(header: Column) -> Column:
    """Seconds to wait before another try, 0 to 120; 0 where the header is no number."""
    return F.least(F.greatest(F.coalesce(header.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(120.0))


def search_text(text: Column) -> Column:
    """A search's words: hyphens between word characters and runs of blanks are one blank."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?<=\w)-(?=\w)", " "), r"\s+", " "))


# The forms of a paper's id and of an asset's file name.
PAPER_ID, ASSET_NAME = r"\A[a-z0-9][a-z0-9._-]{0,127}\z", r"\A[A-Za-z0-9._-]{1,255}\z"


def asset_path(root: Column, paper: Column, file: Column) -> Column:
    """The path of a paper's asset; null for an id or name that could lead elsewhere."""
    valid = F.rlike(paper, F.lit(PAPER_ID)) & F.rlike(file, F.lit(ASSET_NAME)) & ~file.isin(".", "..")
    return F.when(valid, F.concat_ws("/", root, paper, file))


def folded_text(text: Column) -> Column:
    """Compatibility forms composed and case folded. Spark has no function for either, so this is Arrow batches of Python."""

    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return fold(text)
