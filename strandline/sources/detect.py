"""Format, encoding, delimiter and header detection over file heads.

Input is ``(path, head binary, truncated)`` (see ``inventory.heads``) or any
relation with a binary column; all but the legacy-charset guess and the
quote-aware sniffing are Catalyst expressions.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens as tk
from ..functions.lookups import (
    BYTE_ORDER_MARKS, DIALECT_SAMPLE_CHARS, ENCODING_CHARSETS, ENCODING_CODEPAGES,
    MAGIC_SAMPLE_BYTES, SNIFF_DELIMITERS, lookup_column,
)

NUL = "\u0000"


# --- format -----------------------------------------------------------------------

def detect_magic(head: Column) -> Column:
    """Format from the first bytes: magic numbers, JSON opening, a delimiter
    that splits the first lines evenly, else text."""
    mark = F.hex(F.substring(head, 1, 4))
    text = F.decode(F.substring(head, 1, MAGIC_SAMPLE_BYTES), "UTF-8")
    first = F.substring(F.regexp_replace(text, r"^[\s﻿]+", ""), 1, 1)
    lines = F.slice(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != ""), 1, 5)
    # counts of one delimiter over the first lines: all equal and not zero
    def even(d: str) -> Column:
        counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))))
        return (F.size(counts) > 0) & (F.array_min(counts) > 0) & (F.array_min(counts) == F.array_max(counts))
    delimited = even(",") | even("\t") | even(";") | even("|")
    return (F.when(mark == "50415231", F.lit("parquet"))
            .when(mark.startswith("4F5243"), F.lit("orc"))
            .when(first.isin("{", "["), F.lit("json"))
            .when(delimited, F.lit("csv")).otherwise(F.lit("text")))


# --- encoding ---------------------------------------------------------------------

def bom(head: Column) -> Column:
    mark = F.hex(F.substring(head, 1, 4))
    chain = F.when(mark.startswith(BYTE_ORDER_MARKS[0][0]), F.lit(BYTE_ORDER_MARKS[0][1]))
    for prefix, name in BYTE_ORDER_MARKS[1:]:
        chain = chain.when(mark.startswith(prefix), F.lit(name))
    return chain


def bomless_utf16(head: Column) -> Column:
    """UTF-16 without a mark: NUL bytes on one parity only, and often enough."""
    latin = F.decode(head, "ISO-8859-1")
    pairs = F.floor(F.octet_length(head) / 2)
    zeros = lambda pattern: _count(F.regexp_replace(latin, pattern, "$1"), NUL)
    even, odd = zeros("(?s)(.)(?:.|$)"), zeros("(?s).(.|$)")
    enough = F.greatest(F.lit(2), F.floor(pairs / 4))
    return F.when((pairs >= 2) & latin.contains(NUL),
                  F.when((even == 0) & (odd >= enough), F.lit("utf-16-le"))
                  .when((odd == 0) & (even >= enough), F.lit("utf-16-be")))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def utf8_class(head: Column, truncated: Column) -> Column:
    """``ascii`` / ``utf-8`` / null; a character cut by the sample's end is no error."""
    n = F.octet_length(head)
    valid = lambda k: F.is_valid_utf8(F.substring(head, F.lit(1), n - k).cast("string"))
    ascii_only = F.is_valid_utf8(head.cast("string")) & (F.length(head.cast("string")) == n)
    cut = truncated & (valid(1) | valid(2) | valid(3))
    return F.when(ascii_only & (n > 0), F.lit("ascii")).when((n > 0) & (valid(0) | cut), F.lit("utf-8"))


# Byte pairs of the wide legacy codecs, and the pairs that are kana there.
SJIS_PAIR, SJIS_KANA, SJIS_HALF = r"[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]", r"\x82[\x9F-\xF1]|\x83[\x40-\x96]", r"[\xA1-\xDF]"
EUC_PAIR, EUC_KANA = r"[\xA1-\xFE]{2}", r"\xA4[\xA1-\xF3]|\xA5[\xA1-\xF6]"
GBK_PAIR, GB2312_PAIR = r"[\x81-\xFE][\x40-\x7E\x80-\xFE]", r"[\xA1-\xF7][\xA1-\xFE]"
BIG5_PAIR = r"[\xA1-\xF9][\x40-\x7E\xA1-\xFE]"
CYRILLIC, WESTERN = r"[\xA8\xB8\xC0-\xFF]", r"[\x80\x91-\x97\xC0-\xFF]"


def legacy_charset(head: Column) -> Column:
    """``struct(encoding, confidence)``: the legacy codec that a sample's bytes look like.

    A wide codec must explain every byte above 127 with its pairs (the last one may be cut), and at least half of the
    pairs must follow one another: in Western text such bytes stand alone among letters, where they also form
    valid pairs.  Kana tell the Japanese codecs from the Chinese ones; text that is nearly all Cyrillic letters
    (four at least) comes before both.
    """
    number = lambda x, p: F.length(x) - F.length(F.regexp_replace(x, p, ""))

    def facts(x: Column) -> Column:
        def wide(name: str, pair: str, also: str = "") -> list[Column]:
            rest = F.regexp_replace(x, f"{pair}|{also}" if also else pair, "")
            return [(~F.regexp_replace(rest, r"[\x80-\xFF]$", "").rlike(r"[\x80-\xFF]")
                     & (2 * number(x, f"(?:{pair}){{2,}}") >= number(x, pair)) & x.rlike(pair)).alias(name)]
        return F.struct(
            number(x, r"[\x80-\xFF]").alias("high"), number(x, "[A-Za-z]").alias("letters"),
            number(x, CYRILLIC).alias("cyrillic"), number(x, WESTERN).alias("western"),
            number(x, SJIS_KANA).alias("sjis_kana"), number(x, EUC_KANA).alias("euc_kana"),
            *wide("sjis", SJIS_PAIR, SJIS_HALF), *wide("euc", EUC_PAIR), *wide("gbk", GBK_PAIR),
            *wide("gb2312", GB2312_PAIR), *wide("big5", BIG5_PAIR))

    def choose(n: Column) -> Column:
        high = F.greatest(n["high"], F.lit(1))
        share = lambda c: n[c] / high
        found = lambda name, confidence: F.struct(
            F.lit(name).alias("encoding"), F.round(confidence, 4).cast("double").alias("confidence"))
        kana = lambda c: 0.85 + 0.14 * F.least(share(c), F.lit(1.0))
        plain = F.least(F.lit(1.0), 2.0 * n["letters"] / (high + n["letters"]))
        return (F.when((share("cyrillic") >= 0.9) & (n["high"] > n["letters"]) & (high >= 4),
                       found("cp1251", 0.8 * share("cyrillic") * high / (high + n["letters"])))
                .when(n["sjis"] & (share("sjis_kana") >= 0.1) & (n["sjis_kana"] >= n["euc_kana"]),
                      found("cp932", kana("sjis_kana")))
                .when(n["euc"] & (share("euc_kana") >= 0.1), found("euc-jp", kana("euc_kana")))
                .when(n["gb2312"], found("gbk", F.lit(0.85))).when(n["big5"], found("big5", F.lit(0.85)))
                .when(n["sjis"], found("cp932", F.lit(0.85))).when(n["gbk"], found("gbk", F.lit(0.85)))
                .otherwise(found("cp1252", F.greatest(F.lit(0.4), 0.75 * share("western") * plain))))
    guess = tk.bind(F.decode(head, "ISO-8859-1"), lambda x: tk.bind(facts(x), choose))
    return F.when(head.isNull(), F.struct(F.lit("cp1252").alias("encoding"), F.lit(0.4).alias("confidence"))).otherwise(guess)


def detect_encoding(df: DataFrame, head: str = "head", truncated: str | None = None) -> DataFrame:
    """Adds ``encoding, encoding_confidence (percent), codepage, encoding_warning``.

    The statistical guess runs only on the rows no certain rule settles.
    """
    cut = F.col(truncated) if truncated else F.lit(False)
    h = F.col(head)
    sure = (F.when(bom(h).isNotNull(), F.struct(bom(h).alias("encoding"), F.lit(1.0).alias("confidence")))
            .when(bomless_utf16(h).isNotNull(),
                  F.struct(bomless_utf16(h).alias("encoding"), F.lit(0.95).alias("confidence")))
            .when(utf8_class(h, cut).isNotNull(),
                  F.struct(utf8_class(h, cut).alias("encoding"), F.lit(1.0).alias("confidence"))))
    settled = df.withColumn("_sure", sure)
    both = settled.withColumn("_e", F.coalesce("_sure", legacy_charset(h)))
    percent = F.round(F.col("_e.confidence") * 100).cast("int")
    return (both.withColumn("encoding", F.col("_e.encoding"))
            .withColumn("encoding_confidence", percent)
            .withColumn("codepage", codepage(F.col("_e.encoding")))
            .withColumn("encoding_warning", F.when(
                F.col("_e.confidence") < 0.5, F.lit("Encoding could not be determined reliably.")))
            .drop("_sure", "_e"))


def codepage(encoding: Column) -> Column:
    return lookup_column(ENCODING_CODEPAGES, F.lower(F.trim(encoding)), F.lit("ACP"))


def charset(encoding: Column) -> Column:
    return lookup_column(ENCODING_CHARSETS, F.lower(F.trim(encoding)), F.lit("UTF-8"))


# --- dialect ----------------------------------------------------------------------

@F.pandas_udf(T.StructType([T.StructField("delimiter", T.StringType()),
                            T.StructField("cells", T.ArrayType(T.StringType()))]))
def _sniff(sample: pd.Series, path: pd.Series) -> pd.DataFrame:
    """Delimiter whose quote-aware split gives equally wide rows and the best
    ``rows x width``; the first row's cells come with it."""
    def parse(text, d):
        return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=d) if r]

    def one(text, name):
        text = (text or "")[:DIALECT_SAMPLE_CHARS]
        best, score = None, (0, 0)
        for d in SNIFF_DELIMITERS:
            try:
                rows = parse(text, d)
            except csv.Error:
                continue
            body = rows[:-1] if len(rows) > 2 else rows      # the last row may be cut
            widths = {len(r) for r in body}
            if len(body) >= 2 and len(widths) == 1 and (w := widths.pop()) >= 2 \
                    and (len(body) * w, w) > score:
                best, score = d, (len(body) * w, w)
        best = best or ("\t" if ".tsv" in (name or "").lower() else ",")
        try:
            rows = parse(text, best)
        except csv.Error:
            rows = []
        return best, (rows[0] if rows else [])
    return pd.DataFrame([one(t, n) for t, n in zip(sample, path)], columns=["delimiter", "cells"])


def guess_header(cells: Column) -> Column:
    """A header row has only non-empty, distinct, non-numeric, non-boolean cells."""
    folded = F.transform(cells, lambda c: F.lower(tk.strip_blanks(c)))
    plain = F.forall(cells, lambda c: ~(tk.is_numeric_token(tk.strip_blanks(c)) | tk.is_bool_token(c)))
    return F.coalesce((F.size(cells) > 0) & F.forall(folded, lambda c: c != "") & plain
                      & (F.size(F.array_distinct(folded)) == F.size(folded)), F.lit(False))


def normalise_header(cells: Column) -> Column:
    """Usable names: blanks become ``Unnamed: i``, repeats get ``.k``."""
    named = F.transform(cells, lambda c, i: F.when(
        F.trim(F.coalesce(c, F.lit(""))) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(c))
    return F.transform(named, lambda c, i: F.when(
        F.array_position(named, c) <= i,
        F.concat(c, F.lit("."), F.size(F.filter(F.slice(named, F.lit(1), i), lambda x: x == c)).cast("string")))
        .otherwise(c))


def numbered_header(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("column_"), i.cast("string")))


def detect_dialect(df: DataFrame, sample: str = "sample", path: str = "path") -> DataFrame:
    """Adds ``delimiter, has_header, header`` for text samples."""
    s = df.withColumn("_d", _sniff(F.col(sample), F.col(path)))
    has = guess_header(F.col("_d.cells"))
    return (s.withColumn("delimiter", F.col("_d.delimiter")).withColumn("has_header", has)
            .withColumn("header", F.when(F.col("has_header"), normalise_header(F.col("_d.cells")))
                        .when(F.size("_d.cells") > 0, numbered_header(F.size("_d.cells")))
                        .otherwise(F.array().cast("array<string>")))
            .drop("_d"))


# What a user may override in a dialect.
OVERRIDE_RULES = {
    "format": r"^(csv|json|parquet|delta|orc|text)$",
    "firstRow": r"^[1-9][0-9]{0,5}$|^1000000$",
    "fieldDelimiter": "^[^\\x00-\\x08\\x0a-\\x1f\\x7f-\\x9f\\u2028\\u2029]$",
    "quoteCharacter": "^[^\\x00-\\x08\\x0a-\\x1f\\x7f-\\x9f\\u2028\\u2029]$",
    "rowTerminator": r"^(\n|\r|\r\n|\\n|\\r|\\r\\n|0x([0-9a-fA-F]{2}){1,8}|[\x20-\x7e]{1,8})$",
    "codepage": r"^(?i:ACP|OEM|RAW)$|^[1-9][0-9]{0,3}$|^[1-5][0-9]{4}$|^6[0-4][0-9]{3}$|^65[0-4][0-9]{2}$|^655[0-2][0-9]$|^6553[0-5]$",
    "compression": r"^(?i:NONE|GZIP|SNAPPY|ZSTD|DEFLATE|BZIP2|LZ4|BROTLI|UNCOMPRESSED)$",
}


def check_overrides(overrides: dict[str, str]) -> None:
    """Fails for a setting that is not known or a value that it cannot have."""
    import re
    if not isinstance(overrides, dict):
        raise TypeError("overrides is a dict of setting -> value")
    for k, v in overrides.items():
        if k not in OVERRIDE_RULES or not re.match(OVERRIDE_RULES[k], str(v), re.S):
            raise ValueError(f"setting {k} is not valid")


def with_overrides(df: DataFrame, overrides: DataFrame | dict[str, str],
                   detected: dict[str, str]) -> DataFrame:
    """User overrides win over detection; each column says where it came from.

    ``detected`` maps override keys to the columns that hold the detected value.
    Values are checked before they are used; a bad one fails the call.
    """
    check_overrides(overrides)
    for k, column in detected.items():
        given = overrides.get(k)
        df = (df.withColumn(f"{column}_source", F.lit("override" if given is not None else "detected"))
              .withColumn(column, F.lit(given) if given is not None else F.col(column)))
    return df
