"""From a folder to profiles: inventory, detection, one plan per format family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import map_type
from ..sources import columnar, detect, dialects, inventory as inv_mod, jsondocs, ranges
from ..workspace import few, materialise
from ..operators import infer, jsonprofile


def detect_units(spark: SparkSession, root: str) -> DataFrame:
    """One row per unit (file or table folder) with its type; unknown suffixes are
    decided by content, and only those files are opened."""
    units = inv_mod.collapse_tables(inv_mod.inventory(spark, root))
    unknown = units.filter("file_type is null and members = 1")
    sniffed = inv_mod.heads(unknown, 8192).select(
        "path", F.when(F.col("error").isNull(), detect.detect_magic(F.col("head"))).alias("sniffed"), "error")
    return (units.join(sniffed, "path", "left")
            .withColumn("file_type", F.coalesce("file_type", "sniffed", F.lit("unknown"))).drop("sniffed"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def profile_csvs(spark: SparkSession, units: DataFrame) -> DataFrame | None:
    """Columns of all delimited files in one plan, whatever their dialects; ``path`` is the unit, if units have a column ``unit``.

    Charset, delimiter, quotes and widths rest on all lines of a file, the names on its first record.  Only folder names and
    patterns come to the driver, never one plan a file or dialect.  A file that cannot be read is a row with ``error``.
    """
    unit = F.col("unit") if "unit" in units.columns else F.col("path")
    csvs = materialise(units.where("file_type = 'csv'").select("path", unit.alias("unit")), "delimited-files")
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    named = F.when(F.lower(suffix).isin(".csv", ".tsv"), F.concat(folder(F.col("path")), F.lit("/*"), suffix))
    places = [r["place"] for r in csvs.select(F.coalesce(named, "path").alias("place")).distinct().toLocalIterator()]
    if not places:
        return None
    firsts = materialise(dialects.first_records(csvs), "first-records")
    plain = firsts.where("wide IS NULL AND error IS NULL").select("path")
    lines = dialects.raw_lines(spark, places).join(plain, "path", "left_semi") \
        .unionByName(ranges.wide_lines(firsts.where("wide IS NOT NULL")))
    facts = materialise(dialects.line_facts(lines), "line-facts")
    found = materialise(dialects.dialects(lines, firsts, facts), "dialects")
    cells = dialects.file_cells(lines, facts, found).where("row_kind <> 'long'")
    evidence = infer.merge_tokens(cells.select("path", F.posexplode("cells").alias("pos", "token")), ["path"])
    names = found.where("error IS NULL").join(csvs, "path").select(
        "path", "unit", "encoding", "delimiter", F.posexplode("header").alias("pos", "name"))
    merged = infer.merge_evidence({c: F.col(c) for c in ("mask", "int_digits", "scale", "width", "missing", "rows")})
    whole = names.join(evidence, ["path", "pos"], "left").groupBy("unit", "pos", "name", "encoding", "delimiter") \
        .agg(*[v.alias(k) for k, v in merged.items()]).fillna(0, ["mask", "missing", "rows"])
    done = infer.finish_columns(whole).withColumnRenamed("unit", "path")
    broken = found.where("error IS NOT NULL").select("path", "error")
    return done.unionByName(broken, allowMissingColumns=True)


def profile_json(spark: SparkSession, units: DataFrame, by_folder: bool = False) -> DataFrame | None:
    """Key profiles of all line-framed JSON files in one plan; ``path`` is the file, or its folder for ``by_folder``.

    Documents are taken apart where they are read; only evidence of a file's keys is moved.
    """
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    named = F.concat(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("/*"), suffix)
    # files named as JSON are read by folder; only those found by content are named one by one
    place = F.when(F.lower(suffix).isin(".json", ".jsonl", ".ndjson"), named).otherwise(F.col("path"))
    places = units.filter("file_type = 'json'").select(place.alias("place")).distinct()
    paths = [r["place"] for r in places.toLocalIterator()]
    if not paths:
        return None
    lines = jsondocs.read_ndjson(spark, paths)
    ok = materialise(jsondocs.ndjson_decision(lines).filter("is_ndjson").select("path"), "line-framed")
    docs = lines.filter("family = 'object'").join(few(ok), "path", "left_semi")
    evidence = jsonprofile.key_evidence(jsonprofile.json_fields(docs, ["path"]), ["path"])
    if by_folder:
        evidence = jsonprofile.merge_files(evidence, folder(F.col("path")))
    p = jsonprofile.finish_keys(jsonprofile.cap_keys(evidence, ["path"]), ["path"])
    return p.select("path", "pos", "name", "detected_type", "nesting", "observed_max_length", "max_length",
                    "safe", "schema_inference", "nullable",
                    map_type(F.col("detected_type"), F.col("max_length"))["spark_type"].alias("spark_type"))


def profile_columnar(spark: SparkSession, units: DataFrame) -> DataFrame:
    """Declared columns of parquet and ORC files from their footers."""
    pq = columnar.parquet_footers(units.filter("file_type = 'parquet'"))
    orc = columnar.orc_footers(units.filter("file_type = 'orc'"))
    return pq.unionByName(orc).select("path", "num_rows", "compression", "columns", "error")


def summary(units: DataFrame) -> DataFrame:
    return infer.summary(units, "file_type", "size")
