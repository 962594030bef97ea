"""Queries over whole locations of delimited, JSON and columnar files.

Folders are written by Spark from the given tables, each in a dialect of its own, and read back without being told which.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import lake, location
from ..sources import dialects, ranges, settings
from ..workspace import materialise, staged
from .inference import TEXT, infer_sql, text_sql, text_table
from .jsonqueries import KEYS_SQL
from .registry import query, table

# One kind of line end in every text, as records have.
ENDS = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
NOTES_SQL = f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {ENDS.format('text')} AS text, lang FROM documents"


def _plain_ends(c: str):
    return F.regexp_replace(c, "\r\n?", "\n")


def mixed_location(spark, sf) -> str:
    """A folder with customers (comma), parts (tab), documents (semicolon, quoted, over many lines), orders as JSON lines and nations
    as parquet."""
    def write(path):
        out = lambda df, sep, name: df.write.option("header", True).option("sep", sep).option("escape", '"') \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}")
        out(text_table(spark, sf, "customer"), ",", "customer")
        text_table(spark, sf, "part").write.option("header", True).option("sep", "\t").option("escape", '"').csv(f"{path}/part")
        docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), _plain_ends("text").alias("text"),
                                                    "lang")
        out(docs, ";", "documents")
        o = table(spark, sf, "orders")
        o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
                 F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 2 == 0).alias("flag"),
                 F.when(~F.col("o_orderstatus").isin("F", "O"), F.struct(F.col("o_custkey").alias("x"))).alias("extra")) \
            .write.json(f"{path}/orders")
        table(spark, sf, "nation").coalesce(1).write.parquet(f"{path}/nation")
    return staged(spark, (sf, "mixed", "location"), write)


def _typed(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS folder, name, detected_type, observed_max_length, rows FROM ({sql})"


@query("lake_profile", " UNION ALL ".join([
    _typed("customer", infer_sql(text_sql("customer"), [c for c, _ in TEXT["customer"]])),
    _typed("part", infer_sql(text_sql("part"), [c for c, _ in TEXT["part"]])),
    _typed("documents", infer_sql(NOTES_SQL, ["doc_id", "text", "lang"])),
    f"SELECT 'orders' AS folder, name, detected_type, CAST(observed_max_length AS BIGINT), CAST(NULL AS BIGINT) FROM ({KEYS_SQL}) "
    "WHERE name IN ('id', 'total', 'status', 'flag', 'extra')",
    """SELECT 'nation', column_name, CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' ELSE 'string' END,
    CAST(NULL AS BIGINT), (SELECT count(*) FROM nation) FROM (DESCRIBE nation)"""]))
def _lake(spark, sf):
    """Every column of a folder with files of five kinds, none of which is announced."""
    p = location.profile_location(spark, mixed_location(spark, sf), by="folder")
    place = F.when(F.col("file_type").isin("csv", "json"), F.col("unit")).otherwise(lake.folder(F.col("unit")))
    return p.select(F.regexp_extract(place, "([^/]+)$", 1).alias("folder"), "name", "detected_type", "observed_max_length", "rows")


def _scanned(spark, sf):
    path = f"{mixed_location(spark, sf)}/documents"
    lines = dialects.raw_lines(spark, [path])
    facts = materialise(dialects.line_facts(lines), "line-facts")
    return lines, facts, dialects.file_facts(facts)


@query("dlm_records", f"""SELECT lang, count(*) AS n, CAST(sum(length({ENDS.format('text')})) AS BIGINT) AS chars,
  CAST(sum(doc_id) AS BIGINT) AS keys FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def _records(spark, sf):
    """Records of quoted text over many lines, found block by block from the quotes before."""
    lines, facts, files = _scanned(spark, sf)
    rows = dialects.records(lines, facts, files)
    c = rows.select(dialects.cells(F.col("line"), F.lit(";"), F.lit(True)).alias("c")).where("c[0] <> 'doc_id'")
    return c.groupBy(F.col("c")[2].alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col("c")[1])).alias("chars"),
                                                      F.sum(F.col("c")[0].cast("long")).alias("keys"))


@query("dlm_consensus", """SELECT ';' AS delimiter, 3 AS width, CAST(sum(length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) -
  length(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), ''))) + count(*) AS BIGINT) AS lines
  FROM documents""")
def _consensus(spark, sf):
    """The delimiter of every file by the widths of all its records."""
    lines, facts, files = _scanned(spark, sf)
    d = dialects.delimiters(dialects.records(lines, facts, files), files).join(files.select("path", "lines"), "path")
    return d.groupBy("delimiter", F.col("width").cast("int").alias("width")).agg(
        (F.sum("lines") - F.count(F.lit(1))).alias("lines"))


@query("dlm_overrides_read", """SELECT 'documents' AS place, lang AS word, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars,
  CAST(sum(doc_id) AS BIGINT) AS keys, 'detected' AS encoding_source, 'override' AS quote_source FROM documents GROUP BY 2
UNION ALL SELECT 'customer', c_mktsegment, count(*), CAST(sum(length(c_name)) AS BIGINT), CAST(sum(c_custkey) AS BIGINT), 'override', 'detected'
  FROM customer GROUP BY 2""")
def _override_read(spark, sf):
    """Two places read as settings say: records that end in a separator character, cells in single quotes, header lines passed
    over; and a code page with a delimiter that detection would not try."""
    def write(path):
        out = lambda df: df.write.option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False)
        docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
        out(docs).option("sep", "~").option("quote", "'").option("escape", "'").option("lineSep", "\u001e").option("quoteAll", True) \
            .csv(f"{path}/documents")
        c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
        out(c).option("sep", "^").option("encoding", "windows-1252").csv(f"{path}/customer")
    root = staged(spark, (sf, "settings"), write)
    read = settings.read_with_settings(spark, [
        (f"{root}/documents", {"fieldDelimiter": "~", "quoteCharacter": "'", "rowTerminator": "0x1e", "firstRow": "2"}),
        (f"{root}/customer", {"fieldDelimiter": "^", "codepage": "1252"})])
    place = F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("place")
    return read.groupBy(place, F.col("cells")[2].alias("word"), "encoding_source", "quote_source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col("cells")[1])).alias("chars"),
        F.sum(F.col("cells")[0].cast("long")).alias("keys"))


@query("enc_wide_ranges", """SELECT lang, count(*) AS n, CAST(sum(length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS BIGINT) AS chars,
  CAST(sum(doc_id) AS BIGINT) AS keys FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def _wide(spark, sf):
    """Quoted UTF-16 text over many lines, each file read as ranges by many tasks."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string"), "lang", "text")
    path = staged(spark, (sf, "documents", "utf16-ranges"), lambda p: docs.write.option("escape", '"').option("quoteAll", True).option(
        "encoding", "UTF-16LE").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(p))
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.lit("utf-16-le").alias("wide"))
    lines = ranges.wide_lines(files, 1 << 18)
    facts = materialise(dialects.line_facts(lines), "line-facts")
    rows = dialects.records(lines, facts, dialects.file_facts(facts))
    c = rows.select(dialects.cells(F.col("line"), F.lit(","), F.lit(True)).alias("c"))
    return c.groupBy(F.col("c")[1].alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col("c")[2])).alias("chars"),
                                                      F.sum(F.col("c")[0].cast("long")).alias("keys"))
