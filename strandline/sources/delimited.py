"""Delimited and plain text files: exact reads, ragged rows, row counts, profiles."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import ENCODING_CHARSETS, FULL_SCAN_BYTES
from ..operators import infer

RAW = "_raw_record"


@dataclass
class Dialect:
    names: Sequence[str]
    delimiter: str = ","
    has_header: bool = True
    encoding: str = "utf-8"
    quote: str = '"'
    multiline: bool = False
    first_row: int = 1
    extra: dict[str, str] = field(default_factory=dict)


def _reader(spark: SparkSession, d: Dialect):
    """Reader for a dialect.  Quoted line breaks and UTF-16/32 need whole-file
    parsing; everything else stays splittable."""
    charset = ENCODING_CHARSETS.get(d.encoding, "UTF-8")
    whole = d.multiline or charset.startswith(("UTF-16", "UTF-32"))
    r = (spark.read.option("sep", d.delimiter).option("quote", d.quote).option("escape", d.quote)
         .option("encoding", charset).option("multiLine", whole).option("header", d.has_header)
         .option("maxCharsPerColumn", -1).option("maxColumns", max(20480, len(d.names) + 8))
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    for k, v in d.extra.items():
        r = r.option(k, v)
    return r


def read_delimited(spark: SparkSession, paths: str | Sequence[str], d: Dialect,
                   ragged: bool = False) -> DataFrame:
    """All columns as text, missing values null, file path attached.

    With ``ragged`` the raw text of rows that are not exactly as wide as the
    header comes along, so ``split_ragged`` can tell long rows from short ones.
    """
    cols = [f"c{i} string" for i in range(len(d.names))]
    schema = ", ".join(cols + ([f"{RAW} string"] if ragged else []))
    r = _reader(spark, d).schema(schema)
    if ragged:
        # all columns are parsed even when few are used, else width faults go unseen
        r = (r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
             .option("columnPruning", False))
    df = r.csv(paths if isinstance(paths, str) else list(paths))
    named = [F.col(f"c{i}").alias(n) for i, n in enumerate(d.names)]
    tail = [F.col(RAW)] if ragged else []
    return df.select(F.col("_metadata.file_path").alias("path"), *named, *tail)


def token_count(raw: Column, delimiter: str, quote: str = '"') -> Column:
    """Fields of a raw record: delimiters outside quotes, plus one."""
    q = re.escape(quote)
    outside = F.when(raw.contains(quote), F.regexp_replace(raw, f"{q}[^{q}]*{q}", "")).otherwise(raw)
    return F.length(outside) - F.length(F.replace(outside, F.lit(delimiter), F.lit(""))) + 1


def mark_ragged(df: DataFrame, d: Dialect) -> DataFrame:
    """``row_kind``: ``ok``, ``short`` (padded with null) or ``long`` (not evidence)."""
    n = token_count(F.col(RAW), d.delimiter, d.quote)
    return df.withColumn("row_kind", F.when(F.col(RAW).isNull(), F.lit("ok"))
                         .when(n > len(d.names), F.lit("long"))
                         .when(n < len(d.names), F.lit("short")).otherwise(F.lit("ok")))


def split_ragged(df: DataFrame, d: Dialect) -> tuple[DataFrame, DataFrame]:
    """Rows that are evidence (short ones padded) and rows that are too long."""
    marked = mark_ragged(df, d)
    return (marked.filter("row_kind <> 'long'").drop(RAW, "row_kind"),
            marked.filter("row_kind = 'long'").drop("row_kind"))


def read_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """One ``line`` column; LF, CRLF and CR all end a line, an unended last line counts."""
    r = spark.read.option("encoding", ENCODING_CHARSETS.get(encoding, "UTF-8"))
    return r.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def line_stats(lines: DataFrame, quote: str = '"') -> DataFrame:
    """Per file: physical lines, blank lines, and whether quotes span lines."""
    odd = (F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))) % 2 == 1
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("line") == "").alias("blank_lines"),
        F.bool_or(odd).alias("quoted_breaks"))


def logical_rows(spark: SparkSession, paths, d: Dialect) -> DataFrame:
    """Exact record count per file, blank lines included, header excluded.

    Without quoted line breaks every physical line is a record, so one line scan
    answers; with them, parsed records and unquoted blank lines are added up.
    """
    header = F.lit(1 if d.has_header else 0)
    if not d.multiline:
        s = line_stats(read_lines(spark, paths, d.encoding), d.quote)
        return s.select("path", F.greatest(F.col("lines") - header, F.lit(0)).alias("row_count"))
    records = read_delimited(spark, paths, d).groupBy("path").agg(F.count(F.lit(1)).alias("records"))
    q = re.escape(d.quote)
    whole = spark.read.format("text").option("wholetext", True).option(
        "encoding", ENCODING_CHARSETS.get(d.encoding, "UTF-8")).load(paths)
    bare = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), f"{q}[^{q}]*{q}", "x")
    blank = whole.select(F.col("_metadata.file_path").alias("path"), F.greatest(F.size(F.filter(
        F.split(F.regexp_replace(bare, "\n$", ""), "\n"), lambda x: x == "")), F.lit(0)).alias("blank"))
    return records.join(blank, "path", "full").select(
        "path", (F.coalesce("records", F.lit(0)) + F.coalesce("blank", F.lit(0))).alias("row_count"))


def estimate_rows(inv: DataFrame, d: Dialect, windows: int = 16, window_bytes: int = 1 << 16) -> DataFrame:
    """Opt-in estimate per file from a few ranges of it, with its error (``ranges.estimate_lines``); small files are counted."""
    from .ranges import estimate_lines
    e = estimate_lines(inv, windows, window_bytes)
    rows = F.floor(F.round("lines", 6)) - (1 if d.has_header else 0)
    return e.select("path", F.greatest(rows, F.lit(0)).cast("long").alias("row_count"),
                    (F.col("bytes_read") < F.col("size")).alias("row_count_estimated"),
                    F.ceil("error").cast("long").alias("row_count_error"), "bytes_read")


def scan_mode(size: Column, limit: int = FULL_SCAN_BYTES) -> Column:
    """Mode the single-machine rule would use; our scans are full at any size."""
    return F.when(size <= limit, F.lit("full")).otherwise(F.lit("sampled"))


def profile_delimited(spark: SparkSession, paths, d: Dialect, mode: str = "full",
                      sample: int = 1000, per_file: bool = False) -> DataFrame:
    """Typed columns of delimited files from one pass over the data.

    ``mode='sample'`` looks only at the first rows and therefore reports text
    types; per-file results are keyed by path.
    """
    kept, _ = split_ragged(read_delimited(spark, paths, d, ragged=True), d)
    if mode == "sample":            # in the order of files and rows, so that runs agree
        kept = kept.withColumn(RAW, F.monotonically_increasing_id()).orderBy("path", RAW).limit(sample).drop(RAW)
    by = ["path"] if per_file else []
    return infer.infer_columns(kept, list(d.names), by=by, full=mode == "full")


def sample_rows(df: DataFrame, order: str, k: int = 3, by: str | None = "path") -> DataFrame:
    """First ``k`` data rows per file (a top-k: Spark keeps k rows per task and key)."""
    from pyspark.sql import Window
    if by is None:
        return df.orderBy(order).limit(k)
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")
