"""Delimited files read as a user's settings say, whatever detection would have found.

A setting belongs to a place (file, folder or pattern) and may fix delimiter, quote, record terminator, first row, code page and
compression; what it leaves open is told from all lines, as everywhere.  There is one scan a setting, never one a file, and all of
them end in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lookups import ENCODING_CODEPAGES, SNIFF_DELIMITERS
from ..workspace import few, materialise
from . import dialects
from .detect import check_overrides, guess_header, normalise_header, numbered_header
from .ranges import STREAMS, stream_lines, wide_lines

HELD = "\u0000"
_ESCAPES = {"\\n": "\n", "\\r": "\r", "\\r\\n": "\r\n"}


def terminator(value: str | None) -> str | None:
    """The text of a row terminator; null stands for any usual line end."""
    if value is None:
        return None
    value = _ESCAPES.get(value, value)
    if value.startswith("0x"):
        value = bytes.fromhex(value[2:]).decode("latin-1")
    return None if value in ("\n", "\r\n") else value


def encoding_name(codepage: str | None) -> str | None:
    """Encoding of a code page; null where the page leaves it to detection."""
    if codepage is None or codepage.upper() in ("ACP", "OEM", "RAW"):
        return None
    names = {page: name for name, page in reversed(ENCODING_CODEPAGES.items()) if name != "ascii"} | {
        "1200": "utf-16-le", "1252": "cp1252", "932": "cp932"}
    if codepage not in names:
        raise ValueError(f"no charset for code page {codepage}")
    return names[codepage]


def _swapped(line: Column, quote: str | None = None) -> Column:
    """The setting's quote and the usual one change places, so that all later steps know one quote."""
    if quote is None or quote == dialects.QUOTE:
        return line
    held = F.replace(line, F.lit(quote), F.lit(HELD))
    return F.replace(F.replace(held, F.lit(dialects.QUOTE), F.lit(quote)), F.lit(HELD), F.lit(dialects.QUOTE))


def _swap_back(quote: str):
    return lambda cell: _swapped(cell, quote)


def _lines(spark: SparkSession, place: str, files: DataFrame, given: dict[str, str]) -> DataFrame:
    name, end = encoding_name(given.get("codepage")), terminator(given.get("rowTerminator"))
    wide = name is not None and name.startswith(("utf-16", "utf-32"))
    if "compression" in given or (wide and end):
        kind = given.get("compression", "none").lower()
        if kind not in STREAMS:
            raise ValueError(f"no stream form of {kind}")
        lines = stream_lines(files, kind, name if wide else None, end)
    elif wide:
        lines = wide_lines(files.withColumn("wide", F.lit(name)))
    elif name is not None or end is not None:
        return dialects.raw_lines(spark, [place], end)
    else:
        firsts = dialects.first_records(files)
        lines = dialects.raw_lines(spark, [place], end).join(
            firsts.where("wide IS NULL AND error IS NULL").select("path"), "path", "left_semi") \
            .unionByName(wide_lines(firsts.where("wide IS NOT NULL")))
    return lines


def _from_row(lines: DataFrame, first_row: int) -> DataFrame:
    """Lines from the given number on, counted over the blocks of each file; nothing is sorted."""
    if first_row <= 1:
        return lines
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialise(lines.groupBy("path", "block").agg(F.min("at").alias("a"), F.count(F.lit(1)).alias("n")), "line-counts") \
        .select("path", "block", "a", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # lines of a block are numbered without a gap where they are read
    return lines.join(few(blocks), ["path", "block"]).where(F.col("earlier") + F.col("at") - F.col("a") >= first_row - 1) \
        .select("path", "block", "at", "line")


def read_with_settings(spark: SparkSession, settings: Sequence[tuple[str, dict[str, str]]]) -> DataFrame:
    """``path, header, cells, row_kind, encoding, delimiter, quote`` and ``..._source`` of every record below the header.

    ``settings`` are pairs of a place and what is fixed for it, with the keys of ``OVERRIDE_RULES``; values are checked first and a bad
    one fails the call.  Lines before ``firstRow`` take no part, not even in detection.  Blank lines are no records.  A place without
    files fails like any read; an empty file gives no rows.
    """
    every, facts, fixed = [], [], []
    for k, (place, given) in enumerate(settings):
        check_overrides(given)
        if given.get("format", "csv") not in ("csv", "text"):
            raise ValueError("settings of delimited files only")
        files = spark.read.format("binaryFile").load(place).select("path", F.col("length").alias("size"))
        quote, delimiter = given.get("quoteCharacter"), given.get("fieldDelimiter")
        lines = _from_row(_lines(spark, place, files, given), int(given.get("firstRow", 1)))
        lines = lines.withColumn("line", _swapped(dialects.without_mark(F.col("line")), quote))
        every.append(lines)
        facts.append(dialects.line_facts(lines, "".join({*SNIFF_DELIMITERS, *(delimiter or "")})))
        name = encoding_name(given.get("codepage"))
        text = lambda v: F.lit(v).cast("string")
        fixed.append(files.select("path", F.lit(k).alias("setting"), text(delimiter).alias("given_delimiter"),
                                  text(quote).alias("given_quote"), text(name).alias("given_encoding"),
                                  F.lit(name is not None and name.startswith("utf-") and name != "utf-8").alias("read_as_text")))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    lines, facts = union(every), materialise(union(facts), "line-facts")
    known = dialects.file_facts(facts).join(union(fixed), "path")
    quoted = (F.col("given_quote").isNotNull() & (F.col("quotes") > 0)) | F.col("quoted")
    known = materialise(known.withColumn("quoted", quoted).withColumn("multiline", quoted & (F.col("odd") > 0)), "file-facts")
    rows = dialects.records(lines, facts, known.select("path", "multiline"))
    found = known.join(dialects.delimiters(rows, known), "path", "left").join(dialects.legacy_names(lines, known), "path", "left")
    detected = F.coalesce("legacy", F.when(F.col("beyond_ascii") > 0, F.lit("utf-8")).otherwise(F.lit("ascii")))
    found = found.withColumn("encoding", F.coalesce("given_encoding", detected)) \
        .withColumn("charset", F.when(F.col("read_as_text"), F.lit("utf-8")).otherwise(F.col("encoding"))) \
        .withColumn("delimiter", F.coalesce("given_delimiter", "delimiter", F.when(F.lower("path").contains(".tsv"), F.lit("\t")).otherwise(F.lit(","))))
    found = materialise(found, "dialects")
    firsts = rows.join(few(found.select("path", "first", "charset", "delimiter", "quoted")), "path") \
        .where((F.col("block") == F.col("first.block")) & (F.col("at") == F.col("first.first_at"))) \
        .select("path", F.when(F.col("line") != "", dialects.cells(
            dialects.decoded(F.col("line"), F.col("charset")), F.col("delimiter"), F.col("quoted"))).alias("names"))
    has = F.coalesce(guess_header(F.col("names")), F.lit(False))
    header = F.when(has, normalise_header(F.col("names"))).when(F.size("names") > 0, numbered_header(F.size("names"))) \
        .otherwise(F.array().cast("array<string>"))
    found = materialise(found.join(firsts, "path", "left").withColumn("has_header", has).withColumn("header", header), "settings")
    cells = dialects.file_cells(lines, facts, found.select(
        "path", "multiline", "header", "has_header", "delimiter", "quoted", "first", F.col("charset").alias("encoding"),
        F.lit(None).cast("string").alias("error")))
    back = F.col("cells")
    for quote in sorted({given.get("quoteCharacter") for _, given in settings} - {None, dialects.QUOTE}):
        back = F.when(F.col("quote") == quote, F.transform("cells", _swap_back(quote))).otherwise(back)
    source = lambda c: F.when(F.col(c).isNotNull(), F.lit("override")).otherwise(F.lit("detected"))
    told = found.select("path", "setting", "header", "encoding", "delimiter", F.coalesce("given_quote", F.lit(dialects.QUOTE)).alias("quote"),
                        source("given_encoding").alias("encoding_source"), source("given_delimiter").alias("delimiter_source"),
                        source("given_quote").alias("quote_source"))
    return cells.join(few(told), "path").select("path", "header", back.alias("cells"), "row_kind", "encoding", "encoding_source",
                                           "delimiter", "delimiter_source", "quote", "quote_source")
