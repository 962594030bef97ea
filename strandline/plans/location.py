"""Profile of a whole location: every readable file's columns, in one plan a format family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import infer
from ..workspace import materialise
from . import lake

COLUMNS = ["unit", "file_type", "pos", "name", "detected_type", "observed_max_length", "max_length", "spark_type", "missing",
           "rows", "encoding", "delimiter", "error"]


def _empty(*names: str) -> list:
    return [F.lit(None).cast("long" if n in ("missing", "rows", "observed_max_length") else "string").alias(n) for n in names]


def delimited_units(spark: SparkSession, units: DataFrame) -> DataFrame | None:
    p = lake.profile_csvs(spark, units)
    return None if p is None else p.withColumnRenamed("path", "unit").withColumn("file_type", F.lit("csv")).select(*COLUMNS)


def json_units(spark: SparkSession, units: DataFrame, by: str = "file") -> DataFrame | None:
    """Keys of all line-framed JSON files, folder by folder or file by file."""
    p = lake.profile_json(spark, units, by == "folder")
    if p is None:
        return None
    return p.select(F.col("path").alias("unit"), F.lit("json").alias("file_type"), "pos", "name", "detected_type", "observed_max_length",
                    "max_length", "spark_type", *_empty("missing", "rows"), F.lit("utf-8").alias("encoding"),
                    *_empty("delimiter", "error")).select(*COLUMNS)


def columnar_units(units: DataFrame) -> DataFrame:
    """Declared columns of parquet and ORC files; an unreadable file is one row with ``error``."""
    p = lake.profile_columnar(None, units)
    each = p.select("path", "num_rows", "error", F.posexplode_outer("columns").alias("pos", "c"))
    kind = F.when(F.lower("path").rlike(r"\.orc$"), F.lit("orc")).otherwise(F.lit("parquet"))
    return each.select(F.col("path").alias("unit"), kind.alias("file_type"), F.col("pos").cast("int").alias("pos"),
                       F.col("c.name").alias("name"), F.col("c.type").alias("detected_type"),
                       *_empty("observed_max_length", "missing"), F.lit(None).cast("long").alias("max_length"),
                       F.col("num_rows").cast("long").alias("rows"), *_empty("encoding", "delimiter"), "error") \
        .withColumn("spark_type", infer.mapped_type()["spark_type"]).select(*COLUMNS)


def profile_location(spark: SparkSession, root: str, by: str = "file") -> DataFrame:
    """Every column of every delimited, line-framed JSON, parquet and ORC file below ``root``.

    With ``by="folder"`` the delimited files of one folder with one dialect count as one table, and so do its JSON files.  Charset, delimiter, quotes,
    types and widths rest on all lines of a file; only its column names come from its first record.  Files that cannot be read
    are rows with ``error``; empty files have no columns.
    """
    if by not in ("file", "folder"):
        raise ValueError("by is file or folder")
    units = materialise(lake.detect_units(spark, root).withColumn("unit", F.col("path") if by == "file" else lake.folder(F.col("path"))), "units")
    parts = [p for p in (delimited_units(spark, units), json_units(spark, units, by), columnar_units(units)) if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
