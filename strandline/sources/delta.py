"""Delta tables from their commit log: version, schema, live files, row count, rows.

The log is replayed as an aggregate: the last action per path wins.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import delta_type_name

ACTION_SCHEMA = (
    "struct<add: struct<path: string, size: bigint, partitionValues: map<string,string>, stats: string,"
    " deletionVector: struct<storageType: string>>,"
    " remove: struct<path: string>,"
    " metaData: struct<id: string, name: string, description: string, schemaString: string,"
    " partitionColumns: array<string>, configuration: map<string,string>, createdTime: bigint>,"
    " protocol: struct<minReaderVersion: int, minWriterVersion: int>>")
COMMIT = r"/_delta_log/(\d{20})\.json$"
SKIPPED_FOLDERS = r"(^|/)(_delta_log|_change_data|_symlink_format_manifest)(/|$)"


def actions_from_lines(lines: DataFrame, version: str, order: str, text: str,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep..., version, line_no, action, bad)`` from commit lines; blanks are dropped."""
    t = F.trim(F.col(text))
    parsed = F.try_parse_json(t)
    return (lines.filter(t != "")
            .select(*keep, F.col(version).cast("long").alias("version"), F.col(order).alias("line_no"),
                    F.from_json(t, ACTION_SCHEMA).alias("action"), parsed.isNull().alias("bad")))


def delta_actions(spark: SparkSession, root: str, max_commits: int | None = None) -> DataFrame:
    """Actions of the commits of a table folder, of the newest ``max_commits`` if given."""
    rows = spark.read.text(f"{root.rstrip('/')}/_delta_log/*.json")
    lines = rows.select(
        F.regexp_extract(F.col("_metadata.file_path"), COMMIT, 1).alias("v"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"),
        F.col("value").alias("text")).filter("v <> ''")
    if max_commits is not None:
        newest = lines.agg(F.max(F.col("v").cast("long"))).scalar()
        lines = lines.filter(F.col("v").cast("long") > newest - max_commits)
    return actions_from_lines(lines, "v", "line_no", "text")


def checkpoint_rows(spark: SparkSession, root: str) -> tuple[int, DataFrame] | None:
    """Version and rows of the newest checkpoint."""
    log = f"{root.rstrip('/')}/_delta_log"
    from .inventory import _glob_hits, _listing
    if not _glob_hits(spark, log + "/*.checkpoint*.parquet"):
        return None
    files = _listing(spark, [log + "/*.checkpoint*.parquet"])
    v = F.regexp_extract("path", r"(\d{20})\.checkpoint", 1)
    top = files.select(F.max(v)).first()[0]
    return int(top), spark.read.parquet(f"{log}/{top}.checkpoint*.parquet")


def checkpoint_adds(spark: SparkSession, root: str) -> DataFrame | None:
    """Live files recorded by the newest checkpoint, as ``add`` rows before its version."""
    found = checkpoint_rows(spark, root)
    if found is None:
        return None
    top, df = found
    df = df.filter("add is not null")
    names = df.schema["add"].dataType.names
    part = F.col("add.partitionValues") if "partitionValues" in names else F.lit(None)
    return df.select(F.lit(top).cast("long").alias("version"), F.col("add.path").alias("path"),
                     part.cast("map<string,string>").alias("partition_values"))


def delta_version(actions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return actions.groupBy(*by).agg(F.max("version").alias("version"))


def delta_metadata(actions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The last metaData action."""
    m = actions.filter("action.metaData is not null")
    last = m.groupBy(*by).agg(F.max_by("action.metaData", F.struct("version", "line_no")).alias("m"))
    return last.select(*by, "m.*")


def table_metadata(spark: SparkSession, root: str, actions: DataFrame):
    """The last metaData row, from the commits or else from the newest checkpoint; None without any."""
    last = delta_metadata(actions).first()
    if last is None and (found := checkpoint_rows(spark, root)) and "metaData" in found[1].columns:
        last = found[1].filter("metaData is not null").select("metaData.*").first()
    return last


def refuse_features(actions: DataFrame) -> None:
    """Deletion vectors and reader versions above 1 change what a file's rows mean; they are not read."""
    newest = actions.agg(F.max("action.protocol.minReaderVersion").alias("reader"),
                         F.count_if(F.col("action.add.deletionVector").isNotNull()).alias("vectors")).first()
    if newest["vectors"] or (newest["reader"] or 1) > 1:
        raise NotImplementedError(f"reader version {newest['reader']}, files with deletion vectors {newest['vectors']}")


def last_actions(actions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Last add or remove per path.  A map-side aggregate, so a path (or a table)
    with most of the actions is reduced in every task before the shuffle."""
    path = F.coalesce("action.add.path", "action.remove.path")
    touched = actions.select(*by, path.alias("path"), "version", "line_no",
                             F.col("action.add").alias("add")).filter("path is not null")
    return (touched.groupBy(*by, "path")
            .agg(F.max_by(F.struct("add"), F.struct("version", "line_no")).alias("last")))


def delta_active_files(actions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., path, stats, partition_values)`` of the current snapshot."""
    a = F.col("last.add")
    return (last_actions(actions, by).filter(a.isNotNull())
            .select(*by, "path", a["stats"].alias("stats"), a["partitionValues"].alias("partition_values")))


def without_removed(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Adds with no later remove of the same path (both ``(path, version)``)."""
    later = removes.groupBy("path").agg(F.max("version").alias("removed_at"))
    j = adds.join(later, "path", "left")
    return j.filter(F.col("removed_at").isNull() | (F.col("version") > F.col("removed_at"))).drop("removed_at")


def delta_row_count(actions: DataFrame, has_checkpoint: Column | None = None,
                    by: tuple[str, ...] = (), max_commits: int | None = None) -> DataFrame:
    """Sum of ``numRecords`` of the live files, or null when it would be a guess: without statistics, with
    broken lines, deletion vectors, a checkpoint, or more commits than ``max_commits``."""
    path = F.coalesce("action.add.path", "action.remove.path")
    rows = actions.select(*by, path.alias("path"), "version", "line_no", "bad", F.col("action.add").alias("add"),
                          F.get_json_object("action.add.stats", "$.numRecords").try_cast("long").alias("n"))
    # one pass: the last action per path, and next to it what decides whether a sum is exact
    per_path = rows.groupBy(*by, "path").agg(
        F.max_by(F.struct(F.col("add").isNotNull().alias("live"), "n", F.col("add.deletionVector").isNotNull().alias("dv")),
                 F.struct("version", "line_no")).alias("last"),
        F.count_if("bad").alias("bad_lines"),
        F.count_if(F.col("add").isNotNull() & F.col("n").isNull()).alias("no_stats"),
        F.min("version").alias("first"), F.max("version").alias("latest"))
    alive = F.col("path").isNotNull() & F.col("last.live")
    total = per_path.groupBy(*by).agg(
        F.count_if(alive).alias("live_files"), F.sum(F.when(alive, F.col("last.n"))).alias("total"),
        F.count_if(alive & F.col("last.dv")).alias("vectors"),
        F.sum("bad_lines").alias("bad_lines"), F.sum("no_stats").alias("no_stats"),
        (F.max("latest") - F.min("first") + 1).alias("span"))
    blocked = has_checkpoint if has_checkpoint is not None else F.lit(False)
    exact = (F.col("bad_lines") == 0) & (F.col("no_stats") == 0) & ~blocked & (F.col("vectors") == 0)
    if max_commits is not None:
        exact = exact & (F.col("span") <= max_commits)
    return total.select(*by, F.col("live_files").cast("long").alias("live_files"),
                        F.when(exact, F.coalesce("total", F.lit(0))).cast("long").alias("row_count"))


def delta_schema(schema_string: str) -> tuple[T.StructType, list[dict]]:
    """Spark schema and ``(name, type, nullable)`` list of one schemaString."""
    raw = json.loads(schema_string)
    listed = [{"pos": i, "name": f["name"], "type": delta_type_name(f.get("type")),
               "nullable": f.get("nullable", True) is not False} for i, f in enumerate(raw["fields"])]
    return T.StructType.fromJson(raw), listed


def schema_columns(metadata: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The declared top-level columns as rows (primitive type names mapped)."""
    from ..functions.types import delta_type
    fields = F.from_json("schemaString", "struct<fields: array<struct<name: string, type: string, nullable: boolean>>>")
    rows = metadata.select(*by, F.posexplode(fields["fields"]).alias("pos", "f"))
    raw = F.col("f.type")
    kind = F.get_json_object(raw, "$.type")
    name = (F.when(raw.startswith("{") & (kind == "array"), F.lit("list"))
            .when(raw.startswith("{") & (kind == "map"), F.lit("map"))
            .when(raw.startswith("{"), F.lit("struct")).otherwise(delta_type(raw)))
    return rows.select(*by, "pos", F.col("f.name").alias("name"), name.alias("type"),
                       F.coalesce("f.nullable", F.lit(True)).alias("nullable"))


def first_data_file(inv: DataFrame, root: str) -> DataFrame:
    """First parquet file of a sorted folder walk (files of a folder before its
    subfolders), log and side folders excluded."""
    root = root.rstrip("/")
    rest = F.substring(F.col("path"), F.instr("path", root + "/") + len(root) + 1, F.length("path"))
    parts = F.split(rest, "/")
    walk = F.transform(parts, lambda p, i: F.when(i == F.size(parts) - 1, F.concat(F.lit("\u0000"), p))
                       .otherwise(F.concat(F.lit("\u0001"), p)))
    data = inv.filter(F.col("path").contains(root + "/") & F.lower("path").endswith(".parquet"))
    return (data.select("path", "size", walk.alias("walk"), rest.alias("rest"))
            .filter(~F.col("rest").rlike(SKIPPED_FOLDERS)).orderBy("walk").limit(1).select("path", "size"))


def delta_or_parquet(spark: SparkSession, root: str) -> dict:
    """Schema of a table folder: from the log, else from its first data file."""
    from .columnar import parquet_footers
    from .inventory import inventory
    meta = None
    try:
        meta = table_metadata(spark, root, delta_actions(spark, root))
    except Exception as e:                      # an unreadable log is handled like a missing one
        if "PATH_NOT_FOUND" not in str(e):
            raise
    if meta is not None and meta["schemaString"]:
        schema, columns = delta_schema(meta["schemaString"])
        return {"schema_inference": "delta_log", "schema": schema, "columns": columns, "warning": None}
    first = first_data_file(inventory(spark, root), root)
    foot = parquet_footers(first).first()
    if foot is None:
        return {"schema_inference": None, "error": "no_data_file", "columns": []}
    return {"schema_inference": "underlying_parquet_file", "row_count": None,
            "columns": [c.asDict() for c in foot["columns"]],
            "warning": "schema_of_one_file"}


def decoded(path: Column) -> Column:
    """Percent signs decoded; a plus stays a plus."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def live_files(spark: SparkSession, root: str, actions: DataFrame) -> DataFrame:
    """Live files ``(rel, partition_values)`` from the log and the last checkpoint."""
    live = last_actions(actions).select(
        "path", F.col("last.add").isNotNull().alias("alive"),
        F.col("last.add.partitionValues").alias("partition_values"))
    old = checkpoint_adds(spark, root)
    if old is not None:
        older = old.join(live.select("path"), "path", "left_anti")
        live = live.unionByName(older.select("path", F.lit(True).alias("alive"), "partition_values"))
    return live.filter("alive").select(decoded(F.col("path")).alias("rel"), "partition_values")


def delta_read(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the current snapshot with the partition values as columns.

    The folder is scanned and joined with the list of live files, in one way for
    tables of any size.  Deletion vectors and newer reader versions are refused.
    """
    from ..workspace import materialise
    root = root.rstrip("/")
    actions = delta_actions(spark, root)
    refuse_features(actions)
    meta = table_metadata(spark, root, actions)
    if meta is None:
        raise ValueError(f"no metadata in the log of {root}")
    schema, _ = delta_schema(meta["schemaString"])
    parts = list(meta["partitionColumns"] or [])
    live = materialise(live_files(spark, root, actions), "live")
    data_schema = T.StructType([f for f in schema if f.name not in parts])
    rows = (spark.read.schema(data_schema).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").parquet(root))
    tail = re.escape(root.split("://", 1)[-1].split(":", 1)[-1].lstrip("/"))
    file = F.col("_metadata.file_path")
    rel = decoded(F.regexp_extract(file, tail + "/(.*)$", 1))
    joined = rows.withColumn("rel", rel).join(live, "rel")
    cols = [F.col("partition_values")[f.name].cast(f.dataType).alias(f.name) if f.name in parts
            else F.col(f"`{f.name}`") for f in schema]
    return joined.select(*cols)
