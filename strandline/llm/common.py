"""Shared column expressions of the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII blanks; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"

#: A side with more rows than this is never broadcast by hint.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words between ASCII blanks; a null text has none."""
    plain = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":           # one blank splits without a regular expression
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2 ** 53))


def small(df: DataFrame) -> DataFrame:
    """The broadcast hint, if a count shows that the side is small; else the side as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finisher of the splitmix64 generator (public domain): spreads all bits of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: int, size: int = 2 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text, so that work per part is bounded whatever the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (held + n > size or i - at >= rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if batch.num_rows > at:
        yield batch.slice(at)
