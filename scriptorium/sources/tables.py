"""Tables of the library: manifests, nodes, evaluation sets, backups, catalogue feeds and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "paper_id string, title string, source_path string, page_count int, uploaded_at timestamp"
CASES = "case_id string, query string, answerable boolean, expected_paper_ids array<string>, anchors array<struct<paper_id: string, text: string>>"
WORKS = "id string, title string, publication_date string, publication_year int, abstract_inverted_index map<string, array<int>>"
FEED = "id string, title string, summary string, published string"


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Readable manifests, newest first; broken files and rows without an id drop."""
    rows = spark.read.schema(MANIFEST).options(mode="DROPMALFORMED", multiLine=True, pathGlobFilter="*.json").json(folder)
    return rows.where("paper_id IS NOT NULL").orderBy(F.col("uploaded_at").desc_nulls_last(), "paper_id")


def write_manifests(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def nodes(spark: SparkSession, folder: str, **wanted: list) -> DataFrame:
    """Nodes by column values, all conditions together; the filters reach the scan. A scan without any is refused."""
    if not wanted:
        raise ValueError("name at least one column to filter by")
    found = spark.read.parquet(folder)
    for column, values in wanted.items():
        found = found.where(F.col(column).isin(*values))
    return found


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON set {"cases": [...]}."""
    return spark.read.schema(f"cases array<{_struct(CASES)}>").json(path, multiLine=True).select(F.inline("cases"))


def _struct(schema: str) -> str:
    return StructType.fromDDL(schema).simpleString()


def works(rows: DataFrame, body: str) -> DataFrame:
    """Works of a catalogue's JSON answers {"results": [...]}: date (or January 1st of the year) and rebuilt abstract."""
    item = F.explode(F.from_json(F.col(body), f"results array<{_struct(WORKS)}>")["results"])
    w = rows.select(item.alias("w")).select("w.*")
    pairs = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return w.select("id", "title", F.coalesce(F.expr("try_cast(publication_date AS date)"), F.make_date("publication_year", F.lit(1), F.lit(1))).alias("published"), F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ").alias("abstract"))


def feed_entries(rows: DataFrame, body: str) -> DataFrame:
    """Entries of Atom feeds: id without its version, blanks collapsed, UTC time."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    parsed = F.from_xml(F.col(body), f"entry array<{_struct(FEED)}>")
    e = rows.select(F.explode(parsed["entry"]).alias("e")).select("e.*")
    return e.select(F.regexp_extract("id", r"(\d{4}\.\d{4,5})", 1).alias("arxiv_id"), squeeze(F.col("title")).alias("title"), squeeze(F.col("summary")).alias("abstract"), F.to_timestamp("published").alias("published"))


def fetchable(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a document may be fetched: https and a host of the list or below one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    listed = [(host == h) | host.endswith(f".{h}") for h in hosts]
    any_host = listed[0]
    for c in listed[1:]:
        any_host = any_host | c
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & any_host, F.lit(False))


def uploads(spark: SparkSession, folder: str, most: int = 50 << 20) -> DataFrame:
    """Files with why they are refused (null: accepted): extension, size, the format's first bytes.

    Empty files never show up: Spark's file scan leaves files of no bytes out.
    """
    files = spark.read.format("binaryFile").load(folder)
    named = F.lower("path").endswith(".pdf")
    small = F.col("length") <= most
    unread = files.where(~named | ~small).select("path", "length", F.when(~named, "extension").otherwise("too large").alias("refused"))
    read = files.where(small).where(named)  # the scan reads no content of larger files
    return unread.unionByName(read.select("path", "length", F.when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF").alias("refused")))


def sse_frames(log: DataFrame) -> DataFrame:
    """Events as server-sent frames."""
    return log.select("run_id", "sequence", F.concat(F.lit("id: "), F.col("sequence").cast("string"), F.lit("\nevent: "), "event_type", F.lit("\ndata: "), F.to_json(F.struct("run_id", "sequence", "event_type")), F.lit("\n\n")).alias("frame"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """Row count and an order-free digest of a table."""
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def backup(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """A copy of each table with a manifest of counts and digests."""
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
        fingerprint(rows).withColumn("name", F.lit(name)).write.mode("append").json(f"{folder}/manifest")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows, consistent): a backup's tables held against its manifest."""
    listed = spark.read.schema("name string, rows long, digest string").json(f"{folder}/manifest")
    out = None
    for name in sorted(r.name for r in listed.select("name").collect()):  # names of tables, a handful
        now = fingerprint(spark.read.parquet(f"{folder}/{name}")).withColumn("name", F.lit(name))
        out = now if out is None else out.unionByName(now)
    return listed.alias("l").join(out.alias("n"), "name").select("name", "l.rows", ((F.col("l.rows") == F.col("n.rows")) & (F.col("l.digest") == F.col("n.digest"))).alias("consistent"))


class RestoreError(RuntimeError):
    """A backup that is absent, is not to be restored without force, or came back different."""


def restore(spark: SparkSession, folder: str, target: str, force: bool = False, strict: bool = True) -> DataFrame:
    """(name, rows, restored, consistent) of a backup's tables, written to `target` in place of what is there.

    It takes force, as tables are replaced. Each table is held against the manifest as it was written; strict makes one that differs
    an error, else the result tells. What the manifest lists and the backup lacks has null for restored.
    """
    try:
        listed = spark.read.schema("name string, rows long, digest string").json(f"{folder}/manifest").collect()  # a row a table
    except AnalysisException as e:
        raise RestoreError(f"no backup in {folder}") from e
    if not force:
        raise RestoreError("restoring replaces tables; call it with force=True")
    found = []
    for r in sorted(listed, key=lambda r: r.name):
        try:
            spark.read.parquet(f"{folder}/{r.name}").write.mode("overwrite").parquet(f"{target}/{r.name}")
            now = fingerprint(spark.read.parquet(f"{target}/{r.name}")).first()
        except AnalysisException:
            now = None
        found.append((r.name, r.rows, now and now.rows, bool(now) and (now.rows, now.digest) == (r.rows, r.digest)))
    wrong = [name for name, *_, same in found if not same]
    if wrong and strict:
        raise RestoreError(f"restored tables differ from the manifest: {', '.join(wrong)}")
    return spark.createDataFrame(found, "name string, rows long, restored long, consistent boolean")


def markdown(rows: DataFrame, title: str) -> str:
    """A report of a small result: one line per row; more than 1000 rows are refused."""
    found = rows.limit(1001).collect()
    if len(found) > 1000:
        raise ValueError("a report holds at most 1000 rows")
    escape = lambda v: "n/a" if v is None else str(v).replace("|", "\\|")
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join(escape(v) for v in r) + " |" for r in found]) + "\n"
