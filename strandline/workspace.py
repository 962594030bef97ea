"""Shared scratch space and session settings.

Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir``.  Only a local session without that setting falls back
to a folder of this machine; a cluster without it is an error, because the
executors would not see the driver's files.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # a repeated JSON key keeps its last value instead of failing the document
    "spark.sql.variant.allowDuplicateKeys": "true",
    # legacy charsets (cp932, gbk, ...) in the CSV/text readers
    "spark.sql.legacy.javaCharsets": "true",
    # nanosecond parquet timestamps degrade to integers instead of failing the read
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}

_RUN = uuid.uuid4().hex[:12]
_TABLES: dict[tuple, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RESULT_SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def build_session(app: str = "strandline", master: str | None = None, **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {"spark.sql.adaptive.enabled": "true",
                 # building an expression is several times faster without call-site tracking
                 "spark.python.sql.dataFrameDebugging.enabled": "false", **RESULT_SETTINGS, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read and write."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/strandline-{_RUN}"


SPREAD_BYTES_PER_CORE = 16 * 1024 * 1024


def spread_small(df: DataFrame, per_core: int = SPREAD_BYTES_PER_CORE) -> DataFrame:
    """Deal a small input out over all cores before per-row heavy work.

    A parquet file with one row group is one task however many cores there are.
    Only inputs below ``per_core`` bytes per core (by the optimizer's own size
    estimate) are dealt out, so the extra exchange is bounded and large tables,
    which have splits enough, never see it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if "Repartition" in plan.toString():            # dealt out already
        return df
    size = int(str(plan.stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < per_core * cores else df


def deal_out(df: DataFrame, per_task: int = 1 << 20) -> DataFrame:
    """Deal narrow rows out over tasks of about ``per_task`` bytes, before work that is heavy for each row.

    The few bytes of a row make a file's split hold millions of them.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // per_task))


#: A side with more rows than this is never broadcast by hint.
FEW_ROWS = 200_000


def few(df: DataFrame) -> DataFrame:
    """The small side of a join with rows that Python gave, whose size Spark does not know and may take for nothing.

    Broadcast, if a count shows that it has few rows; else both sides are shuffled.  The other side is never broadcast.
    """
    return df.hint("broadcast" if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else "shuffle_hash")


# While a table is written: shuffle files go as soon as the query that wrote them ends, and the driver does not
# print and keep a plan of any length at each of its changes.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "1000"}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and
    survives the loss of executors.  What the write has shuffled is not needed
    again and is given back at once, instead of when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.parquet(path)


def staged(spark: SparkSession, key: tuple, write) -> str:
    """Path of a derived data set, written on first use by ``write(path)``."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _TABLES:
        path = f"{shared_dir(spark)}/{'-'.join(str(k).strip('/').replace('/', '_') for k in key)}"
        write(path)
        _TABLES[full] = path
    return _TABLES[full]
