"""Title, authors, keywords and identifiers of a paper from the text of its first pages, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once, squeezed

# What marks lines that are no title, no authors, or that stand below authors; months; names' and keywords' forms.
VENUES = ("proceedings of", "association for computational linguistics", "copyright", "©", " pages ")
PLACES = ("university", "institute", "school of", "laboratory")
NO_AUTHORS = ("university", "institute", "school", "laboratory", "college", "department", "proceedings", "association", "future house", "align to innovate", "research institute")
BELOW_AUTHORS = ("university", "institute", "school", "laboratory", "college", "research", "future house", "align to innovate", "department")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
FOOTNOTES = r"[\d*†‡∗]+$"
KEYWORDS = r"(?im)^(?:keywords|index terms)\s*[-—:]\s*(.+)$"
DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
ARXIV = r"(?i)\barXiv:\s*(\d{4}\.\d{4,5})(?:v\d+)?"
TITLE_LINES, TITLE_PARTS, AUTHOR_LINES = 25, 3, 50


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def title_noise(line: Column) -> Column:
    """Lines of a first page that are no title: empty, of a venue, a place, a mail address, a date or without letters."""
    low = F.lower(line)
    listed = (F.length(line) - F.length(F.replace(line, F.lit(","), F.lit(""))) >= 2) & line.rlike(r"\d")
    date = low.rlike(r"\b(?:" + "|".join(MONTHS) + r")\b.*\b(?:19|20)\d{2}\b")
    bare = line.rlike(r"^[\d\W]+$") & ~line.rlike(r"\p{L}")  # letters beyond ASCII are in \W
    return (line == "") | _any(low, VENUES) | line.contains("@") | _any(low, PLACES) | listed | date | bare


def person_name(value: Column) -> Column:
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    return F.size(words).between(2, 6) & ~value.rlike("[@{}]") & F.forall(words, lambda w: w.rlike(r"\p{L}"))


def _bare(part: Column) -> Column:
    return F.btrim(F.regexp_replace(part, FOOTNOTES, ""))


def author_line(line: Column, following: Column) -> Column:
    """Several names in a row, or a name above a place."""
    parts = F.filter(F.transform(F.split(line, r",|\band\b"), lambda p: F.btrim(p)), lambda p: p != "")
    names = F.size(F.filter(F.transform(parts, _bare), person_name))
    several = (names >= 2) & (F.size(parts) > 1)
    return (line != "") & ~line.contains("@") & ~_any(F.lower(line), NO_AUTHORS) & (names > 0) & (several | _any(F.lower(following), BELOW_AUTHORS))


def split_authors(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, r"\s*(?:,|;|\band\b)\s*"), _bare), lambda n: (n != "") & person_name(n))


def _above_abstract(lines: Column) -> Column:
    at = F.array_position(F.transform(lines, F.lower), "abstract").cast("int")
    return F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines)


def detected_title(page: Column) -> Column:
    """The first lines of a page that could be a title, three at most, up to the abstract, noise below them or the authors; null without any."""

    def found(lines: Column) -> Column:
        follows = lambda i: F.coalesce(F.get(lines, i + 1), F.lit(""))
        marked = F.transform(_above_abstract(lines), lambda x, i: F.named_struct(F.lit("x"), x, F.lit("noise"), title_noise(x), F.lit("who"), author_line(x, follows(i))))
        start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("over"))

        def step(acc: Column, m: Column) -> Column:
            some = F.size(acc["parts"]) > 0
            over = acc["over"] | (some & (m["noise"] | m["who"])) | (F.size(acc["parts"]) == TITLE_PARTS)
            fits = ~over & ~m["noise"] & F.length(m["x"]).between(8, 240) & m["x"].rlike(r"\p{L}")
            return F.struct(F.when(fits, F.concat(acc["parts"], F.array(m["x"]))).otherwise(acc["parts"]).alias("parts"), over.alias("over"))

        return F.aggregate(marked, start, step, lambda acc: F.nullif(F.array_join(acc["parts"], " "), F.lit("")))

    return once(F.transform(F.slice(F.split(page, "\n"), 1, TITLE_LINES), squeezed), found)


def detected_authors(page: Column, title: Column) -> Column:
    """Distinct names in the lines between the title and the abstract; parts of a line that wide gaps part count one by one."""

    def found(raw: Column) -> Column:
        lines = F.transform(raw, squeezed)
        above = _above_abstract(lines)
        wanted = F.lower(squeezed(title))
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"), F.lit(False).alias("over"))

        def step(acc: Column, m: Column) -> Column:
            text = F.btrim(F.concat(acc["text"], F.lit(" "), m["x"]))
            counts = ~acc["over"] & (m["x"] != "") & ~title_noise(m["x"])
            part = counts & F.contains(wanted, F.lower(text))
            return F.struct(F.when(counts, text).otherwise(acc["text"]).alias("text"), F.when(part, m["i"] + 1).otherwise(acc["end"]).alias("end"), (acc["over"] | (counts & (F.lower(text) == wanted))).alias("over"))

        end = F.aggregate(F.transform(above, lambda x, i: F.named_struct(F.lit("x"), x, F.lit("i"), i)), start, step, lambda acc: acc["end"])

        def names(end: Column) -> Column:
            def of(x: Column, i: Column) -> Column:
                following = F.when(i + 1 < F.size(above), F.get(lines, i + 1)).otherwise("")
                parts = F.filter(F.transform(F.split(F.btrim(F.get(raw, i)), r"\s{2,}"), lambda p: F.btrim(p)), lambda p: p != "")
                each = F.when(F.size(parts) > 1, parts).otherwise(F.array(x))
                return F.when(i >= end, F.flatten(F.transform(F.filter(each, lambda c: author_line(c, following)), split_authors))).otherwise(F.array().cast("array<string>"))

            return F.array_distinct(F.flatten(F.transform(above, of)))

        return once(end, names)

    return once(F.slice(F.split(page, "\n"), 1, AUTHOR_LINES), found)


def keywords(text: Column) -> Column:
    said = F.regexp_extract(text, KEYWORDS, 1)
    parts = F.filter(F.transform(F.split(said, "[,;]"), lambda p: F.btrim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.rtrim(p, F.lit("."))))


def identifiers(text: Column) -> Column:
    """struct(doi, arxiv_id), null where a text has none."""
    doi = F.nullif(F.rtrim(F.regexp_extract(text, DOI, 1), F.lit(".,;) ")), F.lit(""))
    return F.struct(doi.alias("doi"), F.nullif(F.regexp_extract(text, ARXIV, 1), F.lit("")).alias("arxiv_id"))
