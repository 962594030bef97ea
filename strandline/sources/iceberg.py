"""Iceberg tables from their metadata files: version, schema, spec, row count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import iceberg_type

METADATA = r"^(.*)/metadata/([^/]*\.metadata\.json)$"


def iceberg_version(file_name: Column) -> Column:
    """Numeric version of a metadata file name, null when it has none."""
    name = F.substring_index(file_name, "/", -1)
    a = F.regexp_extract(name, r"(?i)^v(\d+)\.metadata\.json$", 1)
    b = F.regexp_extract(name, r"(?i)^(\d+)(?:-[^.]+)?\.metadata\.json$", 1)
    return F.coalesce(F.when(a != "", a), F.when(b != "", b)).try_cast("long")


def iceberg_latest(inv: DataFrame) -> DataFrame:
    """Current metadata file per table: any version beats none, then the highest
    version, then the newest file, then the path.  One map-side aggregate."""
    root = F.regexp_extract("path", METADATA, 1)
    name = F.regexp_extract("path", METADATA, 2)
    files = inv.filter(F.col("path").rlike(METADATA)).select(
        root.alias("root"), F.coalesce(iceberg_version(name), F.lit(-1)).alias("version"), "mtime", "path")
    best = files.groupBy("root").agg(F.max(F.struct("version", "mtime", "path")).alias("m"))
    return best.select("root", F.col("m.path").alias("file"),
                       F.when(F.col("m.version") >= 0, F.col("m.version")).alias("version"))


def iceberg_docs(spark: SparkSession, latest: DataFrame) -> DataFrame:
    """Contents of the current metadata files ``(root, file, doc)``, read on executors."""
    from .inventory import heads
    named = latest.select("root", F.col("file").alias("path"))
    content = heads(named, 2**30).select("path", F.decode("head", "UTF-8").alias("doc"))
    return named.join(content, "path").select("root", F.col("path").alias("file"), "doc")


def _variants(doc: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(doc), path, "array<variant>")


def _long(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "bigint")


def _current(doc: Column, direct: str, listed: str, id_key: str, current: str, newest: bool) -> Column:
    """The object named by ``current``; else (for schemas) the newest one."""
    v = F.try_parse_json(doc)
    items = F.coalesce(_variants(doc, f"$['{listed}']"), F.array().cast("array<variant>"))
    want = _long(v, f"$['{current}']")
    same = F.try_element_at(F.filter(items, lambda x: _long(x, f"$['{id_key}']") == want), F.lit(1))
    if newest:
        ids = F.transform(items, lambda x: F.coalesce(_long(x, f"$['{id_key}']"), F.lit(-1)))
        top = F.try_element_at(items, F.array_position(ids, F.array_max(ids)).cast("int"))
        same = F.coalesce(same, F.when(F.size(items) > 0, top))
    own = F.try_variant_get(v, f"$['{direct}']", "variant")
    return F.coalesce(own, same)


def iceberg_schema(docs: DataFrame, key: str = "root", doc: str = "doc") -> DataFrame:
    """Columns of the current schema ``(key, pos, name, type, nullable)``."""
    schema = _current(F.col(doc), "schema", "schemas", "schema-id", "current-schema-id", True)
    fields = docs.select(key, schema.alias("s")).select(
        key, F.posexplode(F.try_variant_get("s", "$.fields", "array<variant>")).alias("pos", "f"))
    required = F.coalesce(F.try_variant_get("f", "$.required", "boolean"), F.lit(False))
    return fields.select(key, "pos", F.try_variant_get("f", "$.name", "string").alias("name"),
                         iceberg_type(F.try_variant_get("f", "$.type", "string")).alias("type"),
                         (~required).alias("nullable"))


def iceberg_partition_spec(docs: DataFrame, key: str = "root", doc: str = "doc") -> DataFrame:
    """Fields of the default partition spec ``(key, pos, name, transform, source_id)``."""
    spec = _current(F.col(doc), "partition-spec", "partition-specs", "spec-id", "default-spec-id", False)
    fields = docs.select(key, spec.alias("s")).select(key, F.coalesce(
        F.try_variant_get("s", "$", "array<variant>"),
        F.try_variant_get("s", "$.fields", "array<variant>")).alias("a"))
    rows = fields.select(key, F.posexplode("a").alias("pos", "f"))
    get = lambda p, t: F.try_variant_get("f", p, t)
    return rows.select(key, "pos", get("$.name", "string").alias("name"),
                       get("$.transform", "string").alias("transform"),
                       get("$['source-id']", "int").alias("source_id"))


def iceberg_row_count(doc: Column) -> Column:
    """total-records of the current snapshot; 0 for a table that never had one."""
    v = F.try_parse_json(doc)
    named = F.array_contains(F.json_object_keys(doc), "current-snapshot-id")
    current = _long(v, "$['current-snapshot-id']")
    snaps = F.coalesce(_variants(doc, "$.snapshots"), F.array().cast("array<variant>"))
    hit = F.try_element_at(F.filter(snaps, lambda x: _long(x, "$['snapshot-id']") == current), F.lit(1))
    total = F.try_variant_get(hit, "$.summary['total-records']", "bigint")
    return F.when(current.isNull() & named, F.lit(0).cast("long")).otherwise(
        F.when(total.isNotNull(), F.greatest(total, F.lit(0))))


def iceberg_current(spark: SparkSession, inv: DataFrame) -> DataFrame:
    """One row per table: metadata file, version, row count, format version."""
    latest = iceberg_latest(inv)
    docs = iceberg_docs(spark, latest)
    return docs.join(latest.select("root", "version"), "root").select(
        "root", "file", "version", iceberg_row_count(F.col("doc")).alias("row_count"),
        F.get_json_object("doc", "$.format-version").alias("format_version"),
        F.get_json_object("doc", "$.table-uuid").alias("table_uuid"))


def iceberg_preview(spark: SparkSession, inv: DataFrame, root: str) -> DataFrame | None:
    """Rows of the first data file: a look at the data, not a snapshot."""
    from .delta import first_data_file
    first = first_data_file(inv, root.rstrip("/") + "/data").first()
    return None if first is None else spark.read.parquet(first["path"])
