"""Text functions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English words that carry no meaning for keyword recall.
STOP_WORDS = (
    "about after all also and any are because been before between both but can could did does doing each for from "
    "had has have how into its more most not only other our out over same should some such than that the their them "
    "then there these they this those through under use used using very was were what when where which while who why "
    "will with within without would"
).split()


def each(df: DataFrame, keep: list, array: Column, pos: str, value: str) -> DataFrame:
    """The kept columns and one row per element of an array, numbered from 0.

    The inner form of the generator would make the optimiser filter on the array's size first and so evaluate the array once more.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def _latin(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1))


def lexical_terms(text: Column) -> Column:
    """Distinct lower-cased Latin terms of two characters or more, then single CJK characters."""
    latin = F.transform(F.filter(_latin(text), lambda t: F.length(t) > 1), F.lower)
    return F.array_distinct(F.concat(latin, F.regexp_extract_all(text, F.lit("([一-鿿])"), F.lit(1))))


def keyword_tokens(text: Column) -> Column:
    """Latin tokens without stop words, then bigrams of CJK runs; repeats stay, for term frequencies."""
    latin = F.filter(F.transform(_latin(text), F.lower), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))
    runs = F.regexp_extract_all(text, F.lit("([一-鿿]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(latin, pairs)


def keyword_terms(text: Column, most: int = 12) -> Column:
    """The first distinct keyword tokens of a query."""
    return F.slice(F.array_distinct(keyword_tokens(text)), 1, most)


def preview(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def slug(text: Column, most: int = 48, default: str = "paper") -> Column:
    dashed = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.rtrim(F.substring(dashed, F.lit(1), F.lit(most)), F.lit("-")) if most else dashed
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def short_hash(*parts: Column, length: int = 12, sep: str = "|") -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, length)


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for a zero vector."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


# Abbreviations whose full stop does not end a sentence, in the order they are looked for.
ABBREVIATIONS = (
    "et al.", "e.g.", "i.e.", "etc.", "cf.", "vs.", "approx.", "fig.", "figs.", "tab.", "tabs.", "eq.", "eqs.", "eqn.", "eqns.",
    "sec.", "secs.", "ref.", "refs.", "no.", "nos.", "vol.", "vols.", "pp.", "dr.", "mr.", "ms.", "prof.", "st.", "inc.", "ltd.", "co.", "corp.",
)
#: Stands for a full stop that ends nothing; it cannot occur in text.
_KEPT_STOP = "\u0001"


def sentences(text: Column) -> Column:
    """Sentences of a text; listed abbreviations (also inside words, then lower-cased) end none."""
    kept = text
    for a in ABBREVIATIONS:
        kept = F.regexp_replace(kept, "(?i)" + a.replace(".", "\\."), a.replace(".", _KEPT_STOP))
    text = F.when(text.rlike("(?i)(?:" + "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS) + ")"), kept).otherwise(text)  # most texts hold none
    parts = F.transform(F.split(text, "(?<=[.!?。！？])\\s+"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    return F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.translate(s, _KEPT_STOP, "."))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once per row, though lambdas in it refer to it many times."""
    return F.transform(F.array(value), use)[0]


def hard_split(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(most))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(most)))


def packed(units: Column, most: int, overlap: int = 1) -> Column:
    """Chunks (arrays of units): units are joined by a blank up to `most` characters; each chunk then starts with the
    last `overlap` units of the one before, which may take it past the limit."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("cur"), F.lit(0).alias("len"))

    def step(acc: Column, unit: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (acc["len"] + 1 + F.length(unit) > most)
        grown = F.when(F.size(acc["cur"]) > 0, acc["len"] + 1).otherwise(0) + F.length(unit)
        return F.when(full, F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), F.array(unit).alias("cur"), F.length(unit).alias("len"))).otherwise(
            F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.array(unit)).alias("cur"), grown.alias("len"))
        )

    chunks = F.aggregate(units, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["cur"])), lambda c: F.size(c) > 0))
    if not overlap:
        return chunks
    none = F.array().cast("array<array<string>>")

    def overlapping(c: Column) -> Column:
        shifted = F.concat(F.array(empty), F.when(F.size(c) > 1, F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1)))).otherwise(none))
        return F.when(F.size(c) == 0, c).otherwise(F.zip_with(shifted, c, lambda p, own: F.concat(F.slice(p, F.greatest(F.size(p) - (overlap - 1), F.lit(1)), F.lit(overlap)), own)))

    return once(chunks, overlapping)


def hashed_dim(term: Column, dims: int = 64) -> Column:
    """Dimension of a term in the hashing embedder: the last byte of its MD5."""
    return F.conv(F.substring(F.md5(term), 31, 2), 16, 10).cast("int") % dims


def hash_vector(text: Column, dims: int = 64) -> Column:
    """Counts of keyword tokens per hashed dimension: the dimensions are sorted, each once more than it occurs, and the
    distances between their last places are counted."""
    every = F.sequence(F.lit(0), F.lit(dims - 1))
    at = F.sort_array(F.concat(F.transform(keyword_tokens(text), lambda t: hashed_dim(t, dims)), every))
    ends = once(at, lambda s: F.filter(F.transform(s, lambda x, i: F.when(~x.eqNullSafe(F.get(s, i + 1)), i)), lambda i: i.isNotNull()))
    return once(ends, lambda p: F.transform(p, lambda x, i: (x - F.coalesce(F.get(p, i - 1), F.lit(-1)) - 1).cast("double")))


# Section roles by substrings of the title, first match wins.
ROLES = (
    ("abstract", ("abstract",)),
    ("introduction", ("introduction", "overview")),
    ("related_work", ("related work", "background", "prior work")),
    ("methods", ("method", "approach", "architecture", "implementation")),
    ("experiments", ("experiment", "evaluation", "benchmark", "setup")),
    ("results", ("result", "analysis", "finding")),
    ("limitations", ("limitation", "threats to validity")),
    ("discussion", ("discussion",)),
    ("conclusion", ("conclusion", "future work")),
    ("references", ("references", "bibliography")),
    ("appendix", ("appendix", "supplement")),
)

# Titles that make a heading without a number, and those that do so beside numbered headings too.
NAMED_HEADINGS = (
    "abstract", "introduction", "background", "related work", "method", "methods", "methodology", "experiments", "results",
    "discussion", "limitations", "conclusion", "conclusions", "acknowledgments", "references", "appendix",
)
ALWAYS_NAMED = ("abstract", "references", "limitations", "acknowledgments")
# Symbols that a heading's title has none of, and those that make an equation.
NO_HEADING = "[←→∅∪=≤≥]"
MATH = "[=≤≥∑∏∫√∞λθαβγμσ±×÷∈∉∪∩→←]"
# The forms of numbered headings, captions, equation numbers and page numbers.
NUMBERED = r"^((?:\d+(?:\.\d+){0,4}|[A-H](?:\.\d+){0,3}))[.)]?\s+(\S.{1,159})$"
CAPTION = r"(?i)^\s*(?:extended\s+data\s+)?(table|figure|fig\.?)\s*([A-Z]?\d+(?:\.\d+)?)\b"
EQUATION_NUMBER = r"\([A-Z]?\d+(?:\.\d+)?\)\s*$"
PAGE_NUMBER = r"^(?:\d{1,4}|page\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?|\d{1,4}\s*/\s*\d{1,4})$"


def semantic_role(title: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(title).rlike("|".join(words)), F.lit(role)) for role, words in ROLES])


def squeezed(text: Column) -> Column:
    """Blanks collapsed to one and cut off at both ends."""
    return F.btrim(F.regexp_replace(text, "\\s+", " "))


def numbered_heading(line: Column) -> Column:
    """struct(index, title, level) of a numbered heading, else null. Plain numbers go up to 9; a title has up to 16 words and a
    letter, begins with a capital, does not end like a sentence and holds no symbol of a formula."""
    index, title = F.regexp_extract(line, NUMBERED, 1), F.rtrim(F.regexp_extract(line, NUMBERED, 2))
    counted = ~index.rlike("^\\d+$") | (F.length(F.ltrim(index, F.lit("0"))) <= 1)
    titled = (F.size(F.split(title, "\\s+")) <= 16) & ~title.rlike("[.!]$") & ~title.rlike(NO_HEADING) & title.rlike("^\\p{Lu}") & title.rlike("\\p{L}")
    level = F.length(index) - F.length(F.replace(index, F.lit("."), F.lit(""))) + 1
    return F.when((title != "") & counted & titled, F.struct(index.alias("index"), title.alias("title"), level.alias("level")))


def named_heading(line: Column, any_numbered: Column) -> Column:
    """struct(index, title, level) of a heading by its name, else null; beside numbered headings only some names count."""
    plain = F.rtrim(F.lower(line), F.lit(":"))
    named = plain.isin(*ALWAYS_NAMED) | (~any_numbered & plain.isin(*NAMED_HEADINGS))
    return F.when(named, F.struct(F.lit(None).cast("string").alias("index"), F.rtrim(line, F.lit(":")).alias("title"), F.lit(1).alias("level")))


def caption(line: Column) -> Column:
    """struct(kind, label) of a caption, else null; kind is table or figure."""
    word, label = F.lower(F.regexp_extract(line, CAPTION, 1)), F.regexp_extract(line, CAPTION, 2)
    return F.when(label != "", F.struct(F.when(word == "table", "table").otherwise("figure").alias("kind"), label.alias("label")))


def is_equation(line: Column) -> Column:
    plain = F.btrim(line)
    symbols = F.regexp_count(plain, F.lit(MATH))
    return (F.length(plain) <= 300) & ((symbols >= 2) | ((symbols >= 1) & plain.rlike(EQUATION_NUMBER)))


def is_page_number(line: Column) -> Column:
    return F.lower(squeezed(line)).rlike(PAGE_NUMBER)


def is_running_matter(line: Column) -> Column:
    """Lines that journals print on every page, by the line alone."""
    plain = F.lower(squeezed(line))
    return plain.contains("nature | vol") | plain.contains("proceedings of") | plain.contains("arxiv preprint") | (plain == "article")


def line_kind(line: Column) -> Column:
    """page number, running matter, caption, heading, equation or text, by the line alone."""
    plain = squeezed(line)
    return (
        F.when(is_page_number(line), "page number").when(is_running_matter(line), "running matter").when(caption(line).isNotNull(), "caption")
        .when(numbered_heading(plain).isNotNull() | named_heading(plain, F.lit(False)).isNotNull(), "heading").when(is_equation(line), "equation").otherwise("text")
    )


def body_text(lines: Column) -> Column:
    """Lines as paragraphs: empty lines part them, others are joined by a blank, or without their hyphen before a small letter."""
    whole = F.array_join(lines, "\n")
    joined = F.btrim(F.regexp_replace(whole, "-\n(?=\\p{Ll})", ""), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(joined, "(?<!\n)\n(?!\n)", " "), "\n{2,}", "\n\n")


def query_expression(text: Column) -> Column:
    """A catalogue query: quoted phrases and words, each as all:..., joined by AND; boolean words drop out."""
    parts = F.regexp_extract_all(text, F.lit('("[^"]+"|[^\\s"()]+)'), F.lit(1))
    kept = F.filter(parts, lambda p: ~F.upper(p).isin("AND", "OR", "NOT"))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.lit("all:"), p)), " AND ")


def paper_identifier(text: Column) -> Column:
    """The first arXiv identifier of a text."""
    return F.nullif(F.regexp_extract(text, r"(?i)(?<!\d)(\d{4}\.\d{4,5})(?:v\d+)?(?!\d)", 1), F.lit(""))


def doi(text: Column) -> Column:
    """The first DOI of a text, without closing punctuation."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;)\]]+$", ""), F.lit(""))


def citation_markers(text: Column) -> Column:
    """Distinct evidence ids cited as [E-...], in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(E-[0-9a-f]{12})\]"), F.lit(1)))
