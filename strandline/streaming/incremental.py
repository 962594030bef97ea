"""Profiles that grow with the data: file streams merged into stored evidence.

The store holds evidence per file (``bit_or``, ``max``, ``sum`` merge it), so the published profile is always
the one a full scan of the present files would give.  It is a sequence of numbered steps, one folder each: a batch of
the stream (``.b<batch>``), a refresh of changed files (``.r``), or a base that holds everything up to its number
(``.base``).  The newest step that names a file decides about it.  One writer at a time.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import infer

EVIDENCE = ["mask", "int_digits", "scale", "width", "missing", "rows"]
FILE = ["_file_path", "_file_modified", "_file_size"]
MARK = -1                       # position of the row that only says a file was looked at
STEP = re.compile(r"^(\d{9})\.(b(\d+)|r|base)$")
SLICE = 10_000                  # changed files that one plan reads


def merge_stored(evidence: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merged evidence of several batches."""
    m = infer.merge_evidence({k: F.col(k) for k in EVIDENCE})
    return evidence.groupBy(*by, "pos", "name").agg(*[v.alias(k) for k, v in m.items()])


# --- the steps of a store -----------------------------------------------------------

def _folder(spark: SparkSession, store: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def steps(spark: SparkSession, store: str) -> list[tuple[int, str, int | None]]:
    """``(number, folder name, batch)`` of every complete step, oldest first."""
    fs, path = _folder(spark, store)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        m = STEP.match(name)
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}/_SUCCESS")):
            found.append((int(m[1]), name, int(m[3]) if m[3] else None))
    return sorted(found)


def current_steps(found, as_of: int | None = None):
    """The newest base up to ``as_of`` and the steps after it."""
    upto = [s for s in found if as_of is None or s[0] <= as_of]
    bases = [s for s in upto if s[1].endswith(".base")]
    start = bases[-1][0] if bases else 0
    after = [s for s in upto if s[0] > start and not s[1].endswith(".base")]
    if as_of is not None and [s[0] for s in after] != list(range(start + 1, as_of + 1)):
        raise ValueError(f"step {as_of} does not exist or is compacted away")
    return bases[-1:] + after


def _write(df: DataFrame, store: str, number: int, kind: str) -> None:
    df.write.mode("overwrite").parquet(f"{store}/{number:09d}.{kind}")


def state(spark: SparkSession, store: str, as_of: int | None = None) -> DataFrame | None:
    """Newest evidence of every file, with its marks; None for an empty store."""
    parts = [spark.read.parquet(f"{store}/{name}").withColumn("_step", F.lit(number))
             for number, name, _ in current_steps(steps(spark, store), as_of)]
    if not parts:
        return None
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    newest = every.groupBy(FILE[0]).agg(F.max("_step").alias("_step"))
    return every.join(newest, [FILE[0], "_step"], "left_semi").drop("_step")


def compact(spark: SparkSession, store: str, after: int = 16) -> None:
    """Once ``after`` steps follow the newest base, write a new base and delete what only the one before the
    last base needed; a reader that began with the last base can still finish."""
    now = current_steps(steps(spark, store))
    if sum(not name.endswith(".base") for _, name, _ in now) < after:
        return
    kept = state(spark, store).filter(~F.col("_gone"))
    _write(kept, store, now[-1][0], "base")
    fs, _ = _folder(spark, store)
    bases = [s for s in steps(spark, store) if s[1].endswith(".base")]
    for number, name, _ in steps(spark, store):
        old = len(bases) > 1 and (number <= bases[-2][0]) and name != bases[-2][1]
        if old:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}"), True)


# --- writing evidence ---------------------------------------------------------------

def _with_file(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Chosen columns and the file they come from."""
    source = ("file_path", "file_modification_time", "file_size")
    return df.select(*[F.col(f"`{n}`") for n in names], *[F.col(f"_metadata.{s}").alias(c) for s, c in zip(source, FILE)])


def _evidence(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return infer.column_evidence(rows, names, by=FILE).withColumn("_gone", F.lit(False))


def _marks(files: DataFrame, gone: bool) -> DataFrame:
    """One row a file without evidence, so that the step decides about it even if it has no rows."""
    blank = [F.lit(None).cast("int").alias(c) for c in ("mask", "int_digits", "scale", "width")]
    return files.select(*FILE, F.lit(MARK).alias("pos"), *blank, F.lit(0).cast("long").alias("missing"),
                        F.lit(0).cast("long").alias("rows"), F.lit(None).cast("string").alias("name"), F.lit(gone).alias("_gone"))


def profile_stream(spark: SparkSession, folder: str, names: Sequence[str], store: str, checkpoint: str,
                   sep: str = ",", header: bool = True, files_per_trigger: int = 100, fmt: str = "csv", compact_after: int = 16):
    """Start the stream; ``stored_profile`` reads the current result.

    A batch that is run again after a failure replaces its own step, or is left out when a base holds it already.
    The stream never looks at a file again; ``refresh`` does.
    """
    rows = _with_file((spark.readStream.schema(_schema(names)).options(**_options(sep, header))
                       .option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)), names)

    def publish(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        found = steps(session, store)
        again = [n for n, _, b in found if b == batch_id]
        last = found[-1][0] if found else 0
        base = max([n for n, name, _ in found if name.endswith(".base")], default=0)
        if not again or again[0] > base:
            _write(_evidence(batch, names), store, again[0] if again else last + 1, f"b{batch_id}")
        compact(session, store, compact_after)

    return (rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _schema(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def _options(sep: str, header: bool) -> dict:
    return {"sep": sep, "header": header, "escape": '"'}


def refresh(spark: SparkSession, folder: str, names: Sequence[str], store: str, sep: str = ",", header: bool = True,
            fmt: str = "csv", compact_after: int = 16) -> int:
    """Bring the store up to the folder: files that are new or whose size or time changed are read again and their
    evidence replaced, that of vanished files is dropped.  Returns how many files changed.

    Only changed files are opened, ``SLICE`` of them a step.
    """
    listed = spark.read.format("binaryFile").load(folder).select(
        F.col("path"), F.col("_metadata.file_path").alias(FILE[0]), F.col("_metadata.file_modification_time").alias(FILE[1]),
        F.col("_metadata.file_size").alias(FILE[2]))
    known = state(spark, store)
    seen = None if known is None else known.filter(~F.col("_gone")).select(*FILE).distinct()
    fresh = listed if seen is None else listed.join(seen, FILE, "left_anti")
    total, last = 0, max((n for n, _, _ in steps(spark, store)), default=0)
    if seen is not None:
        vanished = _marks(seen.join(listed.select(FILE[0]), FILE[0], "left_anti"), True)
        gone = vanished.count()
        if gone:
            last, total = last + 1, gone
            _write(vanished, store, last, "r")
    paths = fresh.select("path").toLocalIterator()
    while chosen := [re.sub(r"([\\*?\[\]{}])", r"\\\1", r[0]) for r in itertools.islice(paths, SLICE)]:
        rows = _with_file(spark.read.schema(_schema(names)).options(**_options(sep, header)).format(fmt).load(chosen), names)
        marks = _marks(spark.read.format("binaryFile").load(chosen).select(
            F.col("_metadata.file_path").alias(FILE[0]), F.col("_metadata.file_modification_time").alias(FILE[1]),
            F.col("_metadata.file_size").alias(FILE[2])), False)
        last, total = last + 1, total + len(chosen)
        _write(_evidence(rows, names).unionByName(marks), store, last, "r")
    compact(spark, store, compact_after)
    return total


def stored_profile(spark: SparkSession, store: str, complete: bool = True, as_of: int | None = None) -> DataFrame:
    """Profile of everything seen so far, or up to step ``as_of`` while it is kept
    (``complete=False`` while data is still coming)."""
    evidence = state(spark, store, as_of)
    if evidence is None:
        raise FileNotFoundError(store)
    return infer.finish_columns(merge_stored(evidence.filter(F.col("pos") != MARK)), full=complete)
