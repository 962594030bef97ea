"""Lake listing: files, table folders, paging, change detection.

An inventory is a DataFrame ``(path, size, mtime)``; every rule below is a
narrow projection or a map-side aggregate over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lookups import (
    EXTENSION_FORMATS, LOADABLE_FORMATS, lookup_column,
)

INVENTORY_SCHEMA = "path string, size long, mtime timestamp"


def _glob_hits(spark: SparkSession, pattern: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    hits = fs.globStatus(p)
    return bool(hits) and len(hits) > 0


def _listing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
            .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))


def inventory(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """The files below ``root`` (local or any Hadoop file system), contents unread.

    Spark's listing skips names starting with an underscore or a dot.  Commit folders of tables are added by
    explicit patterns, one per folder depth, however deep the tree is; with ``hidden`` so is everything else.
    """
    root = root.rstrip("/")
    if not _glob_hits(spark, root):
        raise FileNotFoundError(root)
    skipped, depth = [], 0
    while _glob_hits(spark, root + "/*" * depth):
        p = root + "/*" * depth + ("/[._]*" if hidden else "/_delta_log/*")
        skipped += [p] if _glob_hits(spark, p) else []
        depth += 1
    visible = _listing(spark, [root])
    return visible.unionByName(_listing(spark, skipped)).dropDuplicates(["path"]) if skipped else visible


def object_listing(inv: DataFrame, limit: int | None = None) -> DataFrame:
    """Object-store view: folder markers dropped, keys URL-encoded, in key order; with a
    ``limit`` the first so many, and ``truncated`` tells that there were more."""
    keys = inv.filter(~F.col("path").endswith("/"))
    enc = F.replace(F.replace(F.replace(F.url_encode("path"), F.lit("%2F"), F.lit("/")),
                              F.lit("+"), F.lit("%20")), F.lit("%3A"), F.lit(":"))
    listed = keys.select("path", enc.alias("url"), "size")
    if limit is None:
        return listed.orderBy("path").withColumn("truncated", F.lit(False))
    total = keys.agg((F.count(F.lit(1)) > limit).alias("truncated")).scalar()
    return listed.orderBy("path").limit(limit).withColumn("truncated", total)


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def detect_ext(inv: DataFrame) -> DataFrame:
    return inv.withColumn("file_type", lookup_column(EXTENSION_FORMATS, extension(F.col("path"))))


def only_sources(inv: DataFrame) -> DataFrame:
    """Files a SQL reader can load, by suffix alone."""
    return detect_ext(inv).filter(F.col("file_type").isin(LOADABLE_FORMATS))


def list_level(inv: DataFrame, prefix: str, offset: int = 0, page: int | None = None) -> DataFrame:
    """One folder level below ``prefix``: child folders and files, sorted; a page of them if asked for."""
    below = inv.filter(F.col("path").startswith(prefix))
    rest = F.substring(F.col("path"), len(prefix) + 1, F.length("path"))
    child = F.substring_index(rest, "/", 1)
    is_dir = rest.contains("/")
    supported = lookup_column(EXTENSION_FORMATS, extension(F.col("path"))).isNotNull()
    delta = F.substring(rest, F.length(child) + 2, F.length(rest)).startswith("_delta_log/")
    ice = F.substring(rest, F.length(child) + 2, F.length(rest)).rlike(r"^metadata/[^/]*\.metadata\.json$")
    level = (below.select(child.alias("name"), is_dir.alias("is_folder"), "size",
                         supported.alias("s"), delta.alias("d"), ice.alias("i"))
            .groupBy("name", "is_folder")
            .agg(F.sum("size").cast("long").alias("size"),
                 F.bool_or(~F.col("is_folder") & F.col("s")).alias("supported"),
                 F.when(F.bool_or("d"), F.lit("delta")).when(F.bool_or("i"), F.lit("iceberg"))
                 .alias("table_type"))
            .orderBy("name", "is_folder").offset(offset))
    return level if page is None else level.limit(max(1, page))


def prune(inv: DataFrame, root: str, max_depth: int | None = None, max_files: int | None = None,
          max_dirs: int | None = None) -> DataFrame:
    """Drop hidden and cache folders and apply the walk's ceilings, those that are given.

    The kept files are the first in path order (a top-k, never a sample), and
    ``truncated`` is set on every row when any ceiling was hit.
    """
    rest = F.substring(F.col("path"), len(root.rstrip("/")) + 2, F.length("path"))
    folder = F.regexp_extract(rest, r"^(.*)/[^/]*$", 1)
    depth = F.when(folder == "", F.lit(0)).otherwise(F.size(F.split(folder, "/")))
    seen = (inv.select("*", folder.alias("folder"), depth.alias("depth"))
            .filter(~F.col("folder").rlike(r"(^|/)(\.[^/]*|__pycache__)(/|$)")))
    flags, kept = [], seen
    if max_depth is not None:
        flags.append(seen.agg(F.count_if(F.col("depth") > max_depth) > 0).scalar())
        kept = seen.filter(F.col("depth") <= max_depth)
    if max_files is not None:
        flags.append(kept.agg(F.count(F.lit(1)) > max_files).scalar())
    if max_dirs is not None:
        dirs = kept.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
        flags.append(dirs.agg(F.count(F.lit(1)) > max_dirs).scalar())
        kept = kept.join(dirs.orderBy("folder").limit(max_dirs).select("folder"), "folder", "left_semi")
    if max_files is not None:
        kept = kept.orderBy("path").limit(max_files)
    truncated = F.lit(False)
    for flag in flags:
        truncated = truncated | flag
    return kept.withColumn("truncated", truncated).drop("folder", "depth")


def table_root(path: Column) -> Column:
    """``struct(root, kind)`` when the path itself proves a table folder."""
    d = F.regexp_extract(path, r"^(.*?)/_delta_log/[^/]+$", 1)
    i = F.regexp_extract(path, r"^(.*)/metadata/[^/]*\.metadata\.json$", 1)
    return (F.when(d != "", F.struct(d.alias("root"), F.lit("delta").alias("kind")))
            .when(i != "", F.struct(i.alias("root"), F.lit("iceberg").alias("kind"))))


def table_roots(inv: DataFrame) -> DataFrame:
    """Distinct table folders ``(root, kind)``; Delta wins when both apply."""
    proof = inv.select(table_root(F.col("path")).alias("t")).filter("t is not null")
    return proof.groupBy(F.col("t.root").alias("root")).agg(
        F.when(F.bool_or(F.col("t.kind") == "delta"), F.lit("delta")).otherwise(F.lit("iceberg")).alias("kind"))


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last."""
    parts = F.split(path, "/")
    upto = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.transform(upto, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def outermost(roots: DataFrame) -> DataFrame:
    """Table folders that lie in no other one; the files below them are disjoint intervals of the sorted paths."""
    above = roots.select("root", F.explode(ancestors(F.col("root"))).alias("outer")).filter("outer <> root")
    inner = above.join(roots.select(F.col("root").alias("outer")), "outer", "left_semi").select("root")
    return roots.join(inner, "root", "left_anti")


def assign_roots(inv: DataFrame, roots: DataFrame) -> DataFrame:
    """Every file with its outermost table folder ``(root, kind)``, both null for loose files.

    A file lies in at most one outermost folder, and the folder's depth tells which prefix of the path to look up.
    The listing is therefore neither grouped nor sorted: it is joined once for every depth at which there are
    table folders, and each of these joins is a broadcast as long as the stored folders are as small as Spark's own
    limit asks; beyond it a folder with most of the files is split like any skewed join key.
    """
    from ..workspace import materialise
    depth = F.length("root") - F.length(F.replace("root", F.lit("/")))
    top = materialise(outermost(roots.select("root", "kind")).withColumn("depth", depth), "table-folders")
    out, found = inv, []
    for d in sorted(r[0] for r in top.select("depth").distinct().collect()):      # as many as the deepest path has parts
        key, hit = f"_key{d}", f"_hit{d}"
        prefix = F.substring_index("path", "/", d + 1)
        out = out.withColumn(key, F.when(prefix != F.col("path"), prefix)).join(
            top.filter(F.col("depth") == d).select(F.col("root").alias(key), F.col("kind").alias(hit)), key, "left")
        found.append(F.when(F.col(hit).isNotNull(), F.struct(F.col(key).alias("root"), F.col(hit).alias("kind"))))
    owner = F.coalesce(*found) if found else F.lit(None).cast("struct<root:string,kind:string>")
    return out.select(*[F.col(f"`{c}`") for c in inv.columns], owner["root"].alias("root"), owner["kind"].alias("kind"))


def collapse_tables(inv: DataFrame) -> DataFrame:
    """Table folders as one row each (size = all members), loose files as they are."""
    owned = assign_roots(inv, table_roots(inv))
    kind = F.coalesce("kind", lookup_column(EXTENSION_FORMATS, extension(F.col("path"))))
    # a unit has one type, so that the type can be a key and the aggregate stays hashed
    return owned.groupBy(F.coalesce("root", "path").alias("path"), kind.alias("file_type")).agg(
        F.sum("size").cast("long").alias("size"),
        F.count(F.lit(1)).alias("members"),
        F.max("mtime").alias("mtime"))


def without_members(inv: DataFrame, roots: DataFrame) -> DataFrame:
    return assign_roots(inv, roots).filter("root is null").drop("root", "kind")


def folder_size(inv: DataFrame, roots: DataFrame) -> DataFrame:
    return (assign_roots(inv, roots).filter("root is not null")
            .groupBy("root").agg(F.sum("size").cast("long").alias("bytes")))


def first_supported(inv: DataFrame, order: str, max_bytes: int) -> DataFrame:
    """First listed object that is supported, not empty and not too large."""
    ok = detect_ext(inv).filter(F.col("file_type").isNotNull() & (
        F.col("size").isNull() | ((F.col("size") > 0) & (F.col("size") <= max_bytes))))
    return ok.orderBy(order).limit(1)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose size or time changed between two listings (or that vanished)."""
    a = before.select("path", F.struct("size", "mtime").alias("before"))
    b = after.select("path", F.struct("size", "mtime").alias("after"))
    return (a.join(b, "path", "left")
            .filter(~F.col("before").eqNullSafe(F.col("after")))
            .select("path", F.lit("file_changed").alias("error")))


def stale_units(prof: DataFrame, inv: DataFrame) -> DataFrame:
    """Inventory rows whose stored profile cannot be reused."""
    usable = prof.filter(F.col("error").isNull() & ~F.col("is_table") & ~F.col("provisional"))
    return inv.join(usable.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def refresh(prof: DataFrame, inv: DataFrame, profile) -> DataFrame:
    """Stored profiles that still hold plus fresh ones for everything else."""
    usable = prof.filter(F.col("error").isNull() & ~F.col("is_table") & ~F.col("provisional"))
    kept = usable.join(inv.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")
    return kept.unionByName(profile(stale_units(prof, inv)), allowMissingColumns=True)


HEAD_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("head", T.BinaryType()), T.StructField("truncated", T.BooleanType()),
    T.StructField("error", T.StringType()),
])


def heads(inv: DataFrame, n: int) -> DataFrame:
    """First ``n`` bytes of every file.  The binary reader would load whole files;
    this opens each one on an executor and reads only its head."""

    def read(batches):
        import pandas as pd

        from .opening import open_input
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    with open_input(path) as f:
                        size = f.size()
                        rows.append((path, size, f.read(n), size > n, None))
                except Exception as e:          # one unreadable file is a row, not a failed batch
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "size", "head", "truncated", "error"])

    return spread(inv.select("path")).mapInPandas(read, HEAD_SCHEMA)


def spread(paths: DataFrame) -> DataFrame:
    """Listings arrive in few large partitions; opening files wants many small ones."""
    sc = paths.sparkSession.sparkContext
    return paths.repartition(max(sc.defaultParallelism, 1), "path")
