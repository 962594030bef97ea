"""Parquet and ORC: footers, row reads, partitioned folders, globs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inventory import spread

FOOTER_SCHEMA = (
    "path string, num_rows long, num_row_groups int, serialized_size long, compression string,"
    " created_by string, format_version string, kv map<string,string>,"
    " columns array<struct<pos int,name string,type string,physical string,nullable boolean>>,"
    " row_groups array<struct<rows long,bytes long>>, error string")


FOOTER_FIELDS = ["path", "num_rows", "num_row_groups", "serialized_size", "compression", "created_by",
                 "format_version", "kv", "columns", "row_groups", "error"]


def _parquet_footer(path: str) -> dict:
    import pyarrow.parquet as pq

    from .opening import open_input
    with open_input(path) as f:
        pf = pq.ParquetFile(f)
        m, arrow = pf.metadata, pf.schema_arrow
        leaves = {m.schema.column(i).path: m.schema.column(i) for i in range(m.num_columns)}
        columns = []
        for i, fld in enumerate(arrow):
            leaf = leaves.get(fld.name)
            columns.append({"pos": i, "name": fld.name, "type": str(fld.type),
                            "physical": leaf.physical_type if leaf is not None else "GROUP",
                            "nullable": fld.nullable})
        groups = [m.row_group(i) for i in range(m.num_row_groups)]
        codec = groups[0].column(0).compression if groups and m.num_columns else None
        return {"num_rows": m.num_rows, "num_row_groups": m.num_row_groups,
                "serialized_size": m.serialized_size, "compression": codec,
                "created_by": m.created_by, "format_version": str(m.format_version),
                "kv": {k.decode(errors="replace"): v.decode(errors="replace")
                       for k, v in (m.metadata or {}).items() if k != b"ARROW:schema"},
                "columns": columns,
                "row_groups": [{"rows": g.num_rows, "bytes": g.total_byte_size} for g in groups]}


def _orc_footer(path: str) -> dict:
    import pyarrow.orc as orc

    from .opening import open_input
    with open_input(path) as f:
        o = orc.ORCFile(f)
        columns = [{"pos": i, "name": x.name, "type": str(x.type), "physical": None, "nullable": x.nullable}
                   for i, x in enumerate(o.schema)]
        return {"num_rows": o.nrows, "num_row_groups": o.nstripes, "serialized_size": o.content_length,
                "compression": str(o.compression).upper(), "created_by": o.writer, "kv": {},
                "format_version": str(o.file_version), "columns": columns, "row_groups": []}


def _footers(inv: DataFrame, read_one) -> DataFrame:
    """One task per batch of paths reads only the footer bytes of each file; a
    file that cannot be read becomes a row with ``error``."""
    names = FOOTER_FIELDS

    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    rows.append({"path": path, "error": None, **read_one(path)})
                except Exception as e:
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:500]})
            full = [[r.get(n) for n in names] for r in rows]
            yield pd.DataFrame(full, columns=names, dtype=object).astype(
                {"num_rows": "Int64", "num_row_groups": "Int32", "serialized_size": "Int64"})

    return spread(inv.select("path")).mapInPandas(run, FOOTER_SCHEMA)


def parquet_footers(inv: DataFrame) -> DataFrame:
    return _footers(inv, _parquet_footer)


def orc_footers(inv: DataFrame) -> DataFrame:
    return _footers(inv, _orc_footer)


def row_group_stats(footers: DataFrame) -> DataFrame:
    g = footers.select("path", "num_rows", "num_row_groups", "compression", F.explode_outer("row_groups").alias("g"))
    return g.groupBy("path").agg(
        F.max("num_rows").alias("num_rows"), F.max("num_row_groups").alias("num_row_groups"),
        F.max("compression").alias("compression"),
        F.sum("g.rows").alias("group_rows"), F.sum("g.bytes").alias("group_bytes"),
        F.max("g.rows").alias("largest_group_rows"))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


# Types Spark's parquet reader refuses.
UNREADABLE = r"^(halffloat|half_float|float16|time32\[.*|duration.*|month_day_nano_interval)$"


def read_parquet_tolerant(spark: SparkSession, footers: DataFrame, paths: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Read with the columns Spark refuses left out, and say which they were."""
    bad = [r[0] for r in footers.select(F.explode("columns").alias("c"))
           .filter(F.col("c.type").rlike(UNREADABLE)).select("c.name").distinct()
           .orderBy("name").collect()]        # column names
    if not bad:
        return spark.read.parquet(*paths), []
    good = footers.select(F.posexplode("columns").alias("p", "c")).filter(~F.col("c.name").isin(bad))
    names = [r[0] for r in good.groupBy(F.col("c.name").alias("name"))
             .agg(F.min("p").alias("p")).orderBy("p").collect()]
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    from .opening import open_input
    with open_input(paths[0]) as f:
        arrow = pq.read_schema(f)
    import pyarrow as pa
    # what Spark reads for the types it has no counterpart of
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(),
             pa.uint64(): pa.decimal128(20, 0)}
    fields = [arrow.field(n) for n in names]
    fields = [f.with_type(wider.get(f.type, pa.int64() if str(f.type).startswith("timestamp[ns") else f.type))
              for f in fields]
    schema = from_arrow_schema(pa.schema(fields))
    return spark.read.schema(schema).parquet(*paths), bad


def read_orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(*paths)


def read_glob(spark: SparkSession, folder: str, pattern: str = "*.parquet", fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(f"{folder.rstrip('/')}/{pattern}")


def read_partitioned(spark: SparkSession, folder: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Partition columns from ``name=value`` folders; filters on them prune folders."""
    r = spark.read.format(fmt)
    return (r.schema(schema) if schema else r).load(folder)


def read_hudi_files(spark: SparkSession, folder: str) -> DataFrame:
    """Data files only; the table's own metadata is not interpreted."""
    return spark.read.option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").parquet(folder)
