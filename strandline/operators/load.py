"""Loading: typed tables, staging with quarantine, external tables, DDL text, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens as tk
from ..functions.lookups import ENCODING_CHARSETS, FALSE_TOKENS, TRUE_TOKENS
from ..functions.types import is_structural


def _q(name: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in name.split("."))


def column_ddl(columns: Sequence[tuple[str, str, bool]]) -> str:
    """Column list of a CREATE TABLE; an empty schema is one text column ``data``."""
    cols = columns or [("data", "STRING", True)]
    return ", ".join(f"`{n.replace('`', '``')}` {t}{'' if null else ' NOT NULL'}" for n, t, null in cols)


def create_table(spark: SparkSession, name: str, columns: Sequence[tuple[str, str, bool]],
                 fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Guarded create: running it again changes nothing."""
    folded = [c[0].lower() for c in columns]
    if len(set(folded)) != len(folded):
        raise ValueError("column names collide when case is ignored")
    part = f" PARTITIONED BY ({', '.join(_q(p) for p in partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_q(name)} ({column_ddl(columns)}) USING {fmt}{part}")


# Text that a cast to the type accepts without failing.
CASTABLE = {
    "integer": r"^[+-]?[0-9]{1,18}$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$",
    "floating": tk.NUMERIC_PATTERN,
    "temporal": r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?([ T].*)?$",
}


def convert(token: Column, dtype: T.DataType) -> Column:
    """Text to a typed value, null when it does not convert.

    The token's shape is tested first: a failing cast raises inside the JVM,
    which is far dearer than the test when a column is dirty.
    """
    t = tk.strip_blanks(token)
    if isinstance(dtype, T.StringType):
        return token
    if isinstance(dtype, T.BooleanType):
        return F.when(token.isin(TRUE_TOKENS), F.lit(True)).when(token.isin(FALSE_TOKENS), F.lit(False))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        longest = t.rlike(r"^[+-]?[0-9]{1,25}$")
        return F.when(longest, t.try_cast(dtype))
    if isinstance(dtype, T.DecimalType):
        # a cast would round; digits that do not fit the scale make the value bad
        fits = F.length(F.rtrim(F.regexp_extract(t, r"\.([0-9]*)$", 1), F.lit("0"))) <= dtype.scale
        return F.when(t.rlike(CASTABLE["decimal"]) & fits, t.try_cast(dtype))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(t.rlike(CASTABLE["floating"]), t.try_cast(dtype))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(t.rlike(CASTABLE["temporal"]), t.try_cast(dtype))
    return t.try_cast(dtype)


def stage_then_type(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Text rows split into typed good rows and bad rows with the columns at fault.

    Missing text becomes null, never a default.  A value is bad when it is
    present but does not convert, or missing where null is not allowed.
    """
    marked = convert_rows(df, schema, keep)
    good = marked.filter(F.size("bad_columns") == 0).select(*keep, *[F.col(f"typed.`{f.name}`") for f in schema])
    bad = marked.filter(F.size("bad_columns") > 0).select(
        *keep, *[F.col(f"raw.`{f.name}`") for f in schema], "bad_columns")
    return good, bad


def convert_rows(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., raw struct, typed struct, bad_columns)`` in one narrow pass."""
    token = {f.name: F.when(~tk.is_missing(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in schema}
    typed = df.select(*keep, F.struct(*[F.col(f"`{f.name}`") for f in schema]).alias("raw"),
                      F.struct(*[convert(token[f.name], f.dataType).alias(f.name) for f in schema]).alias("typed"))
    faults = [F.when(F.col(f"typed.`{f.name}`").isNull()
                     & (~tk.is_missing(F.col(f"raw.`{f.name}`")) | F.lit(not f.nullable)), F.lit(f.name))
              for f in schema]
    return typed.withColumn("bad_columns", F.array_compact(F.array(*faults)))


class LoadRejected(Exception):
    """More bad rows than the caller allows; nothing was loaded."""


def load(df: DataFrame, table: str, schema: T.StructType, max_errors: int = 0,
         quarantine: str | None = None, rerun_truncate: bool = False) -> DataFrame:
    """Typed load of text rows with a reject limit; returns the loaded row count.

    Bad rows go to the quarantine folder.  The conversion runs once: its result
    is written to shared storage, counted, and only then moved into the table,
    so a rejected load leaves the table as it was.
    """
    from ..workspace import materialise
    spark = df.sparkSession
    checked = materialise(convert_rows(df, schema), "load")
    bad = checked.filter(F.size("bad_columns") > 0)
    errors = bad.count()
    if errors and quarantine:
        bad.select("raw.*", "bad_columns").write.mode("append").json(quarantine)
    if errors > max_errors:
        raise LoadRejected(f"{errors} rows do not convert, {max_errors} allowed")
    create_table(spark, table, [(f.name, f.dataType.simpleString(), True) for f in schema])
    good = checked.filter(F.size("bad_columns") == 0).select("typed.*")
    overwrite = rerun_truncate and owned(table)
    if rerun_truncate and not overwrite:
        raise LoadRejected("truncating needs a table named with its own schema")
    good.select(*[F.col(f"`{f.name}`") for f in schema]).write.insertInto(table, overwrite=overwrite)
    return spark.table(table).agg(F.count(F.lit(1)).alias("loaded_rows"))


def owned(table: str) -> bool:
    """A caller owns a table it named with a schema other than the default one."""
    parts = table.split(".")
    return len(parts) >= 2 and parts[-2].strip("`").lower() not in ("default", "")


def stage(df: DataFrame, table: str) -> DataFrame:
    """Create-table-as-select into ``stg_<table>``."""
    name = ".".join([*table.split(".")[:-1], "stg_" + table.split(".")[-1]])
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def insert_from_file(df: DataFrame, table: str) -> DataFrame:
    spark = df.sparkSession
    target = spark.table(table)
    df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in target.schema]).write.insertInto(table)
    return spark.table(table)


def external_refusal(columns: DataFrame, file_type: str = "parquet") -> DataFrame:
    """Columns that stop an external table: nested ones, unbounded ones."""
    from ..functions.types import bounded_type, is_unbounded
    nested = is_structural(F.col("type")) & F.lit(file_type == "parquet")
    t = bounded_type(F.col("type"), F.col("physical"), F.col("max_length"))
    return columns.select("name", F.when(nested, F.lit("nested")).when(is_unbounded(t), F.lit("unbounded"))
                          .alias("reason"), t.alias("target_type")).filter("reason is not null")


def external_table(spark: SparkSession, name: str, location: str, fmt: str,
                   schema: T.StructType | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Table over files in place; an undefined or nested schema of text files is refused."""
    if fmt in ("csv", "json", "text") and not schema:
        raise ValueError("the schema must be known before files become a table")
    r = spark.read.format(fmt).options(**(options or {}))
    (r.schema(schema) if schema else r).load(location).createOrReplaceTempView(name)
    return spark.table(name)


def format_options(prof: dict) -> dict[str, str]:
    """Reader options of a profile row; formats without any give an empty dict."""
    kind = prof.get("file_type")
    if kind in ("csv", "text"):
        d = {"sep": prof.get("delimiter") or ",", "quote": prof.get("quote") or '"', "escape": '"',
             "encoding": ENCODING_CHARSETS.get(prof.get("encoding") or "utf-8", "UTF-8"),
             "header": str(bool(prof.get("has_header", True))).lower()}
        if d["encoding"].startswith("UTF-16"):
            d["multiLine"] = "true"
        return d
    if kind in ("parquet", "orc") and prof.get("compression"):
        return {"compression": str(prof["compression"]).lower()}
    return {}


def table_ddl(columns: DataFrame, by: str = "path", table: str = "table_name") -> DataFrame:
    """One CREATE TABLE text per file from ``(by, table, pos, name, spark_type, nullable)``.

    A schema is at most a few thousand columns, so a group is bounded by the
    column limit, not by the data.
    """
    quoted = F.concat(F.lit("`"), F.replace("name", F.lit("`"), F.lit("``")), F.lit("`"))
    line = F.concat(quoted, F.lit(" "), F.col("spark_type"),
                    F.when(F.col("nullable"), F.lit("")).otherwise(F.lit(" NOT NULL")))
    body = columns.groupBy(by, table).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("d")))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["d"]), ", ")
    return body.select(by, F.concat(F.lit("CREATE TABLE IF NOT EXISTS `"), F.col(table), F.lit("` ("),
                                    text, F.lit(") USING parquet")).alias("ddl"))


def convert_to_parquet(df: DataFrame, dst: str, partition_by: Sequence[str] = ()) -> None:
    """Rewrite as parquet.  Without partition columns rows go out of the tasks that
    read them.  With them the rows are rebalanced by value, which keeps the
    number of files down while a value with most of the rows is still split
    over many tasks."""
    w = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(dst)


def export_json(prof: DataFrame, path: str) -> None:
    prof.write.json(path)


