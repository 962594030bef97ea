"""Delimited text files of any dialect in one plan.

Lines are read as raw bytes and stay splittable.  One scan counts, per file, what every line says about charset, quotes
and delimiters, so that a dialect rests on all lines and not on a file's head.  Whether a line starts inside a quoted cell
depends on the quotes before it: blocks of a file are summed up to their parity first, the parities are composed over the
few blocks of a file, and each block then finds its records by itself.  A second scan takes every record apart with its own file's
dialect, which is a column like any other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lookups import SNIFF_DELIMITERS
from ..functions.tokens import bind
from ..workspace import few
from .detect import bom, bomless_utf16, charset, guess_header, legacy_charset, normalise_header, numbered_header
from .inventory import spread

QUOTE = '"'
#: Bytes that are read at once while looking for the end of a first record.
STEP = 1 << 16
#: Lines with other than ASCII characters that a legacy charset is judged by.
CHARSET_LINES = 200
#: Stands for a delimiter outside quotes while a record is taken apart.
CUT = "\u0000"

FIRST_SCHEMA = "path string, size long, head binary, record binary, wide string, error string"


def first_records(files: DataFrame) -> DataFrame:
    """``path, size, record, wide, error``: the bytes up to the end of the first record, however long it is.

    ``wide`` names the charset of files in 16- or 32-bit units, which lines are not looked for in bytes.  A file that
    cannot be read is a row with ``error``.
    """
    def read(batches):
        import codecs

        from .opening import open_input
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    with open_input(path) as f:
                        data = f.read(STEP)
                        more = data
                        while more and not _ended(data):
                            more = f.read(STEP)
                            data += more
                        wide = next((n for mark, n in ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"),
                                                       (codecs.BOM_UTF16_BE, "utf-16")) if data.startswith(mark)), None)
                        rows.append((path, f.size(), data[:STEP], data[:_end(data)], wide, None))
                except Exception as e:          # one unreadable file is a row, not a failed batch
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIRST_SCHEMA.split(", ")]) \
                .astype({"size": "Int64"})

    found = spread(files.select("path")).mapInPandas(read, FIRST_SCHEMA)
    return found.withColumn("wide", F.coalesce("wide", F.when(bom(F.col("head")).startswith("utf-16"), bom(F.col("head"))),
                                               bomless_utf16(F.col("head")))).drop("head")


def _ended(data: bytes) -> bool:
    return _end(data) < len(data)


def _end(data: bytes) -> int:
    """Where the first record ends: a line end with an even number of quotes before it."""
    at = -1
    while True:
        ends = [i for i in (data.find(b"\n", at + 1), data.find(b"\r", at + 1)) if i >= 0]
        if not ends:
            return len(data)
        at = min(ends)
        if data.count(b'"', 0, at) % 2 == 0:
            return at


def raw_lines(spark: SparkSession, places: Sequence[str], terminator: str | None = None) -> DataFrame:
    """``path, block, at, line``: lines as they are, with their file's split and their order in it."""
    r = spark.read.format("text")
    r = (r if terminator is None else r.option("lineSep", terminator)).load(list(places))
    # as listings write it: no authority, nothing escaped
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/"), F.lit("+"), F.lit("%2B")))
    return r.select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def without_mark(line: Column) -> Column:
    """A line without a byte order mark at its start."""
    return F.when(line.startswith("\ufeff"), F.substring(line, F.lit(2), F.length(line))).otherwise(line)


def _count(text: Column, char: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def _outside(line: Column) -> Column:
    """The line without its quoted stretches."""
    return F.when(line.contains(QUOTE), F.regexp_replace(line, f"{QUOTE}[^{QUOTE}]*{QUOTE}", "")).otherwise(line)


def line_facts(lines: DataFrame, delimiters: str = "".join(SNIFF_DELIMITERS)) -> DataFrame:
    """Per file and block what all its lines say, in numbers that are merged map-side."""
    line, candidates = F.col("line"), re.escape(delimiters)
    # an odd run of quotes between other characters: it neither starts nor ends a cell, nor stands for a quote in one
    loose = f'(?<=[^{candidates}{QUOTE}]){QUOTE}(?:{QUOTE}{QUOTE})*(?=[^{candidates}{QUOTE}])'
    return lines.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("at").alias("first_at"), F.sum(_count(line, QUOTE)).alias("quotes"),
        F.count_if(_count(line, QUOTE) % 2 == 1).alias("odd"),
        F.count_if(line.contains(QUOTE) & line.rlike(loose)).alias("loose"),
        F.count_if(~F.is_valid_utf8(line)).alias("broken"),
        F.count_if(F.octet_length(line) != F.length(line)).alias("beyond_ascii"))


def file_facts(facts: DataFrame) -> DataFrame:
    """``facts`` of whole files.  Quotes are part of the text where one stands loose, or their number is odd."""
    first = F.min(F.struct("block", "first_at"))
    sums = facts.groupBy("path").agg(first.alias("first"), *[F.sum(c).alias(c) for c in (
        "lines", "quotes", "odd", "loose", "broken", "beyond_ascii")])
    quoted = (F.col("quotes") > 0) & (F.col("loose") == 0) & (F.col("quotes") % 2 == 0)
    return sums.withColumn("quoted", quoted).withColumn("multiline", quoted & (F.col("odd") > 0))


def delimiters(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``path, delimiter, width``: the candidate whose commonest width covers most cells, over all ``records``.

    A width must be two or more and that of over half of the records.  Blank lines say nothing.
    """
    whole = rows.join(few(files.select("path", "quoted")), "path").where(F.col("line") != "")
    text = F.when(F.col("quoted"), _outside(F.col("line"))).otherwise(F.col("line"))
    widths = whole.select("path", text.alias("t")).select(
        "path", *[(_count(F.col("t"), d) + 1).alias(f"w{k}") for k, d in enumerate(SNIFF_DELIMITERS)])
    keys = [f"w{k}" for k in range(len(SNIFF_DELIMITERS))]
    counted = widths.groupBy("path", *keys).agg(F.count(F.lit(1)).alias("n"))      # few rows a file and task
    each = counted.select("path", "n", F.posexplode(F.array(*keys)).alias("k", "width")) \
        .groupBy("path", "k", "width").agg(F.sum("n").alias("n"))
    total = Window.partitionBy("path", "k")
    mode = each.withColumn("total", F.sum("n").over(total)).where((F.col("width") >= 2) & (2 * F.col("n") > F.col("total")))
    best = mode.groupBy("path").agg(F.max(F.struct(
        (F.col("n") * F.col("width")).alias("score"), "width", (-F.col("k")).alias("order"))).alias("best"))
    name = F.element_at(F.array(*map(F.lit, SNIFF_DELIMITERS)), 1 - F.col("best.order"))
    return best.select("path", name.alias("delimiter"), F.col("best.width").alias("width"))


def legacy_names(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``path, legacy``: the charset of files that are not UTF-8, by their first lines that are not."""
    odd = lines.join(files.where("broken > 0").select("path"), "path", "left_semi").where(~F.is_valid_utf8("line"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("block", "at"))
    some = odd.withColumn("nth", nth).where(F.col("nth") <= CHARSET_LINES).groupBy("path") \
        .agg(F.array_join(F.collect_list("line"), "\n").cast("binary").alias("sample"))
    return some.select("path", legacy_charset(F.col("sample"))["encoding"].alias("legacy"))


def cells(record: Column, delimiter: Column, quoted: Column) -> Column:
    """The cells of a record; quoted ones lose their quotes, doubled quotes become one."""
    plain = F.split(record, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1)
    parts = F.split(record, QUOTE, -1)              # every second part lies inside quotes
    marked = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, F.replace(x, delimiter, F.lit(CUT)))
                                      .otherwise(x)), QUOTE)
    bare = lambda c: F.when(c.startswith(QUOTE) & c.endswith(QUOTE) & (F.length(c) >= 2), F.replace(
        F.substring(c, F.lit(2), F.length(c) - 2), F.lit(QUOTE * 2), F.lit(QUOTE))).otherwise(c)
    return F.when(quoted & record.contains(QUOTE), F.transform(F.split(marked, CUT, -1), bare)).otherwise(plain)


def decoded(line: Column, encoding: Column) -> Column:
    """Text of a raw line; lines of UTF-8 files (and those already decoded) are what they are."""
    plain = encoding.startswith("utf") | (encoding == "ascii")
    return F.when(plain, line).otherwise(F.call_function("decode", line.cast("binary"), charset(encoding)))


def dialects(lines: DataFrame, firsts: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a file: ``encoding, delimiter, quoted, multiline, has_header, header, first, lines, error``."""
    files = file_facts(facts)
    d = firsts.join(files, "path", "left").join(delimiters(records(lines, facts, files), files), "path", "left") \
        .join(legacy_names(lines, files), "path", "left")
    encoding = F.coalesce(F.col("wide"), F.col("legacy"), F.when(F.col("beyond_ascii") > 0, F.lit("utf-8")).otherwise(
        F.lit("ascii")))
    default = F.when(F.lower("path").contains(".tsv"), F.lit("\t")).otherwise(F.lit(","))
    d = d.withColumn("encoding", encoding).withColumn("delimiter", F.coalesce("delimiter", default)) \
        .withColumn("quoted", F.coalesce("quoted", F.lit(False))).withColumn("multiline", F.coalesce("multiline", F.lit(False)))
    text = F.when(F.col("wide").isNotNull(), F.call_function("decode", F.col("record"), charset(F.col("wide")))) \
        .otherwise(decoded(F.col("record").cast("string"), F.col("encoding")))
    text = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "[\r\n]+$", "")
    d = d.withColumn("_cells", F.when(F.col("record").isNotNull() & (text != ""), cells(text, F.col("delimiter"), F.col("quoted"))))
    n = F.coalesce(F.size("_cells"), F.lit(0))
    has = F.coalesce(guess_header(F.col("_cells")), F.lit(False))
    names = F.when(has, normalise_header(F.col("_cells"))).when(n > 0, numbered_header(n)) \
        .otherwise(F.array().cast("array<string>"))
    return d.select("path", "encoding", "delimiter", "quoted", "multiline", has.alias("has_header"), names.alias("header"),
                    "first", F.coalesce("lines", F.lit(0)).alias("lines"), "error")


def records(lines: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """``path, block, at, line``: records, of files (``path, multiline``) whose quoted cells may hold line ends.

    Lines of other files are records as they come and are not moved.  A line end inside quotes becomes one line feed.
    """
    by_file = Window.partitionBy("path").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    spanning = files.where("multiline").select("path")
    # the state at the start of a block: whether the quotes before it leave a cell open
    carried = facts.join(spanning, "path", "left_semi").select(
        "path", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("carry"))
    inside = Window.partitionBy("path", "block").orderBy("at")
    earlier = F.coalesce(F.sum("q").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = lines.withColumn("q", _count(F.col("line"), QUOTE)).join(few(carried), ["path", "block"])
    marked = counted.withColumn("starts", (F.col("carry") + earlier) % 2 == 0) \
        .withColumn("own", F.max(F.when(F.col("starts"), F.col("at"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    lasts = marked.groupBy("path", "block").agg(F.max("own").alias("last"))
    left = F.struct(F.col("block").alias("block"), F.col("last").alias("at"))
    open_ = lasts.select("path", "block", F.max(F.when(F.col("last").isNotNull(), left)).over(before).alias("open"))
    here = F.struct(F.col("block").alias("block"), F.col("own").alias("at"))
    keyed = marked.join(open_.hint("shuffle_hash"), ["path", "block"]).withColumn("r", F.coalesce(F.when(F.col("own").isNotNull(), here), "open"))
    joined = keyed.groupBy("path", F.col("r.block").alias("rb"), F.col("r.at").alias("ra")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n").alias("line"))
    whole = lines.join(spanning, "path", "left_anti").select("path", "block", "at", "line")
    return whole.unionByName(joined.select("path", F.col("rb").alias("block"), F.col("ra").alias("at"), "line"))


def file_cells(lines: DataFrame, facts: DataFrame, found: DataFrame) -> DataFrame:
    """``path, cells, row_kind`` of every record below the header: ``ok``, ``short`` (filled up with nulls) or ``long``."""
    good = found.where((F.size("header") > 0) & F.col("error").isNull())
    rows = records(lines, facts, good.select("path", "multiline")).join(few(good), "path")
    header = F.col("has_header") & (F.col("block") == F.col("first.block")) & (F.col("at") == F.col("first.first_at"))
    text = F.regexp_replace(decoded(F.col("line"), F.col("encoding")), "^﻿", "")
    rows = rows.where(~header & (F.col("line") != "")).select("path", "header", "delimiter", "quoted", text.alias("text"))
    split = rows.select("path", F.size("header").alias("n"), cells(F.col("text"), F.col("delimiter"), F.col("quoted")).alias("c"))
    size = F.size("c")
    fill = lambda c: F.concat(c, F.array_repeat(F.lit(None).cast("string"), F.col("n") - F.size(c)))
    return split.select("path", bind(F.col("c"), fill).alias("cells"), F.when(size > F.col("n"), F.lit("long"))
                        .when(size < F.col("n"), F.lit("short")).otherwise(F.lit("ok")).alias("row_kind"))
