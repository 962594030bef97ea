"""Checks after a load: counts, nulls, exact rows, checksums, assertions, manifests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .setops import multiset_counts


def row_count_check(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("loaded_rows"))


def null_distribution(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    names = list(cols or df.columns)
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}_nulls") for c in names])


def exact_rows_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: rows of each side, missing and extra copies, and whether all agree.

    Counts come from the same single grouping that finds the differences.
    """
    a = expected.withColumns({"_in_e": F.lit(1), "_in_a": F.lit(0)})
    b = actual.select(*expected.columns).withColumns({"_in_e": F.lit(0), "_in_a": F.lit(1)})
    keys = [F.col(f"`{c}`") for c in expected.columns]
    per_row = a.union(b).groupBy(*keys).agg(F.sum("_in_e").alias("_n_e"), F.sum("_in_a").alias("_n_a"))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_row.agg(
        z("_n_e").alias("expected_rows"), z("_n_a").alias("actual_rows"),
        z(F.greatest(F.col("_n_e") - F.col("_n_a"), F.lit(0))).alias("missing_rows"),
        z(F.greatest(F.col("_n_a") - F.col("_n_e"), F.lit(0))).alias("extra_rows")
    ).withColumn("exact", (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0))


def differing_rows(actual: DataFrame, expected: DataFrame) -> DataFrame:
    return multiset_counts(expected, actual)


def row_digest(cols: Sequence[Column]) -> Column:
    """Digest of a row's text form.  Every cell is led by its length, so neither separators in cells nor
    nulls beside empty texts can be mistaken."""
    cell = lambda c: F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    return F.md5(F.concat_ws("|", *[F.coalesce(cell(c), F.lit("n")) for c in cols]))


def table_checksum(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Order-free checksum of a table in one pass without a shuffle of rows:
    the halves of the row digests (60 bits each), summed as exact decimals."""
    names = list(cols or df.columns)
    d = row_digest([F.col(f"`{c}`") for c in names])
    half = lambda at: F.conv(F.substring("_d", at, 15), 16, 10).cast("decimal(20,0)")
    total = lambda at: F.coalesce(F.sum(half(at)).cast("string"), F.lit("0"))
    return df.select(d.alias("_d")).agg(F.count(F.lit(1)).alias("rows"),
                                        F.concat(total(1), F.lit("/"), total(17)).alias("checksum"))


@dataclass(frozen=True)
class Assertion:
    kind: str            # row_count, column_count, value_equals, no_error, error_number, values_not_all_null, catalog_present
    value: Any = None
    key: str | None = None
    detail: str = ""


def check(df: DataFrame | None, assertions: Sequence[Assertion], order: str | None = None,
          error: str | None = None, present: bool | None = None,
          spark: SparkSession | None = None, error_number: int | None = None) -> DataFrame:
    """Assertion report ``(kind, expected, actual, ok, evaluated, detail)``.

    ``error`` and ``error_number`` are what the statement under test reported; ``no_error`` wants neither,
    ``error_number`` (a statement that must fail) just that number.

    One aggregate answers everything about the data; it is then laid out as one
    row per assertion.  What cannot be answered is not a failure.
    """
    spark = spark or df.sparkSession
    facts: list[Column] = []
    if df is not None:
        width = len(df.columns)
        names = df.columns
        # without an order column the first row is the first one read
        df = df.withColumn("_order", F.col(order) if order else F.monotonically_increasing_id())
        facts.append(F.count(F.lit(1)).alias("rows"))
        for i, a in enumerate(assertions):
            if a.kind == "value_equals":
                facts.append(F.min_by(F.col(f"`{a.key}`").cast("string"), F.col("_order")).alias(f"v{i}"))
        if any(a.kind == "values_not_all_null" for a in assertions):
            filled = reduce(lambda x, y: x + y,
                            [F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in names])
            facts.append(F.min_by(filled, F.col("_order")).alias("filled"))
    base = df.agg(*facts) if facts else spark.range(1).select(F.lit(0).alias("rows"))

    def row(i: int, a: Assertion) -> Column:
        exp, act, ok, ev, detail = F.lit(None if a.value is None else str(a.value)), F.lit(None), F.lit(True), True, F.lit(a.detail)
        if a.kind == "row_count":
            act = F.col("rows").cast("string")
            ok = act == exp
        elif a.kind == "column_count":
            act = F.lit(None if df is None else str(width))
            ok = F.coalesce(act == exp, F.lit(False))
        elif a.kind == "value_equals":
            act = F.col(f"v{i}")
            ok = act.eqNullSafe(exp)
        elif a.kind == "no_error":
            act = F.lit(error if error is not None or error_number is None else str(error_number))
            ok = F.lit(error is None and error_number is None)
        elif a.kind == "error_number":
            act, ok = F.lit(None if error_number is None else str(error_number)), F.lit(error_number == a.value)
        elif a.kind == "values_not_all_null":
            exp = F.lit(">0")
            act = F.col("filled").cast("string")
            ok = F.coalesce(F.col("filled") > 0, F.lit(True))
            detail = F.when(F.col("filled").isNull(), F.lit("no_rows")).otherwise(detail)
            return _pack(a.kind, exp, act, ok, F.col("filled").isNotNull(), detail)
        elif a.kind == "catalog_present":
            act, ok, ev = F.lit(None if present is None else str(present).lower()), F.lit(present is not False), present is not None
            if present is None:
                detail = F.lit("unreadable")
        else:
            raise ValueError(f"unknown assertion {a.kind}")
        return _pack(a.kind, exp, act, ok, F.lit(ev), detail)

    return base.select(F.inline(F.array(*[row(i, a) for i, a in enumerate(assertions)])))


def _pack(kind: str, exp: Column, act: Column, ok: Column, ev: Column, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), exp.cast("string").alias("expected"),
                    act.cast("string").alias("actual"), F.coalesce(ok, F.lit(False)).alias("ok"),
                    ev.alias("evaluated"), detail.cast("string").alias("detail"))


def table_present(spark: SparkSession, name: str) -> bool | None:
    try:
        return spark.catalog.tableExists(name)
    except Exception:
        return None


def content_digests(files: DataFrame, key: str, content: str) -> DataFrame:
    """``(path, bytes, sha256)`` of contents held in a column."""
    return files.select(F.col(key).alias("path"), F.octet_length(content).cast("long").alias("bytes"),
                        F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


DIGEST_SCHEMA = "path string, bytes long, sha256 string, error string"


def file_digests(inv: DataFrame) -> DataFrame:
    """Digest of every file, streamed in blocks on the executors."""
    from ..sources.inventory import spread

    def run(batches):
        import hashlib

        import pandas as pd

        from ..sources.opening import open_input
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    h, n = hashlib.sha256(), 0
                    with open_input(path) as f:
                        while block := f.read(8 * 1024 * 1024):
                            h.update(block)
                            n += len(block)
                    rows.append((path, n, h.hexdigest(), None))
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256", "error"]).astype({"bytes": "Int64"})

    return spread(inv.select("path")).mapInPandas(run, DIGEST_SCHEMA)


def manifest_diff(tree: DataFrame, manifest: DataFrame) -> DataFrame:
    """``missing`` / ``extra`` / ``different`` / ``same`` per path; both sides are
    ``(path, bytes, sha256)``."""
    t = tree.select("path", F.struct("bytes", "sha256").alias("t"))
    m = manifest.select("path", F.struct("bytes", "sha256").alias("m"))
    return t.join(m, "path", "full_outer").select(
        "path", F.when(F.col("t").isNull(), F.lit("missing")).when(F.col("m").isNull(), F.lit("extra"))
        .when(F.col("t") == F.col("m"), F.lit("same")).otherwise(F.lit("different")).alias("status"))


def verdict_summary(results: DataFrame, verdict: str = "verdict", accepted: str = "accepted",
                    harness_only: Sequence[str] = ("DRY_RUN_ACCEPTED",)) -> DataFrame:
    """Counts per verdict plus the totals ``ACCEPTED`` and ``DEFECTS``.

    Verdicts that only describe the run itself are neither accepted nor defects.
    """
    counts = results.groupBy(F.col(verdict).alias("verdict"), F.col(accepted).alias("a")).agg(
        F.count(F.lit(1)).alias("n"))
    total = F.when(F.col("verdict").isin(list(harness_only)), F.lit(None)).when(
        F.col("a"), F.lit("ACCEPTED")).otherwise(F.lit("DEFECTS"))
    rows = counts.select(F.explode(F.array_compact(F.array(F.col("verdict"), total))).alias("verdict"), "n")
    return rows.groupBy("verdict").agg(F.sum("n").cast("long").alias("n"))


def shape_diff(columns: DataFrame, declared: DataFrame, max_length: str = "max_length") -> DataFrame:
    """Differences between profiled and declared columns (``name, type[, max_length, nesting]``)."""
    a = columns.withColumn("in_profile", F.lit(True))
    d = declared.withColumnsRenamed({c: f"d_{c}" for c in declared.columns if c != "name"}).withColumn(
        "in_declared", F.lit(True))
    j = a.join(d, "name", "full_outer")
    problem = (F.when(F.col("in_profile").isNull(), F.lit("missing column"))
               .when(F.col("in_declared").isNull(), F.lit("undeclared column"))
               .when(F.col("type") != F.col("d_type"), F.lit("type")))
    if "d_max_length" in j.columns and max_length in j.columns:
        problem = problem.when(F.col(max_length) > F.col("d_max_length"), F.lit("longer than declared"))
    if "d_nesting" in j.columns and "nesting" in j.columns:
        problem = problem.when(F.col("nesting") != F.col("d_nesting"), F.lit("nesting"))
    return j.select("name", problem.alias("problem"), F.col("type").alias("profiled"),
                    F.col("d_type").alias("declared")).filter("problem is not null")


def normalise(c: Column, dtype: T.DataType, max_binary: int | None = None, max_text: int | None = None) -> Column:
    """Text form of a value for reports: binary as hex, decimals and dates as text, non-finite numbers as
    words.  With the limits long binaries show length and digest, and long nested values are cut."""
    if isinstance(dtype, T.BinaryType):
        if max_binary is None:
            return F.concat(F.lit("0x"), F.hex(c))
        head = F.concat(F.lit("0x"), F.hex(F.substring(c, 1, max_binary)))
        n = F.octet_length(c)
        return F.when(n <= max_binary, F.concat(F.lit("0x"), F.hex(c))).otherwise(F.concat(
            head, F.lit("... ["), n.cast("string"), F.lit(" bytes, sha256 "),
            F.substring(F.sha2(c, 256), 1, 16), F.lit("]")))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        zone = "+00:00" if isinstance(dtype, T.TimestampType) else ""
        return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit(zone))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (F.when(F.isnan(c), F.lit("nan")).when(c == float("inf"), F.lit("inf"))
                .when(c == float("-inf"), F.lit("-inf")).otherwise(c.cast("string")))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(c)
        if max_text is None:
            return text
        return F.when(F.length(text) > max_text, F.concat(
            F.substring(text, 1, max_text), F.lit("... ["), F.length(text).cast("string"),
            F.lit(" characters]"))).otherwise(text)
    return c.cast("string")


def normalise_rows(df: DataFrame) -> DataFrame:
    return df.select(*[normalise(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def failure_count(prof: DataFrame) -> DataFrame:
    return prof.agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count(F.lit(1)).alias("files"))
