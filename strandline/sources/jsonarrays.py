"""JSON arrays of any size, cut into their elements by many tasks.

A file is read in pieces between commas, which are found in any byte range.  Whether a comma stands between elements depends on
the strings and brackets before it.  Every block of a file says what it does to that state, once for a start outside a string and once
for a start inside one; the few blocks of a file are composed, and then each block knows its own start.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import FEW_ROWS, few, materialise


def _pieces(spark: SparkSession, places: Sequence[str]) -> DataFrame:
    r = spark.read.format("text").option("lineSep", ",").load(list(places))
    return r.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))


def _brackets(text: Column) -> Column:
    """Brackets opened minus brackets closed."""
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _effects(pieces: DataFrame) -> DataFrame:
    """``q`` (quotes) of a piece, and what it does to the depth outside (``d0``) and inside (``d1``) a string at its start."""
    bare = F.when(F.col("piece").contains("\\"), F.regexp_replace("piece", r"(?s)\\.", "")).otherwise(F.col("piece"))
    split = pieces.withColumn("_p", F.split(bare, '"', -1))
    side = lambda k: _brackets(F.array_join(F.filter("_p", lambda x, i: i % 2 == k), ""))
    quoted = F.size("_p") > 1
    return split.select("path", "block", "at", "piece", (F.size("_p") - 1).alias("q"),
                        F.when(quoted, side(0)).otherwise(_brackets(F.col("_p")[0])).alias("d0"),
                        F.when(quoted, side(1)).otherwise(F.lit(0)).alias("d1"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """``path, block, start, end`` of the stretches of a batch that come from one block."""
    path, block = batch.column("path"), batch.column("block").to_numpy()
    differ = (block[1:] != block[:-1]) | pc.not_equal(path.slice(1), path.slice(0, max(0, len(path) - 1))).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(differ) + 1).tolist(), len(block)]
    return ((path[a].as_py(), int(block[a]), a, b) for a, b in itertools.pairwise(edges) if a < b)


def _parity(q: np.ndarray, start: int) -> np.ndarray:
    """Whether each piece starts inside a string."""
    return (start + np.cumsum(q) - q) % 2


def _block_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, block, q, even, odd``: quotes of a block and what it does to the depth, for a start outside and inside a string.

    A block comes as one stretch of rows, in one or more batches.
    """
    open_, names = None, ["path", "block", "q", "even", "odd"]
    row = lambda b: pa.RecordBatch.from_arrays([pa.array([v]) for v in b], names)
    for batch in batches:
        q, d0, d1 = (batch.column(c).to_numpy() for c in ("q", "d0", "d1"))
        for path, block, a, b in _runs(batch):
            if open_ is None or (open_[0], open_[1]) != (path, block):
                if open_ is not None:
                    yield row(open_)
                open_ = (path, block, 0, 0, 0)
            r = _parity(q[a:b], open_[2])
            open_ = (path, block, open_[2] + int(q[a:b].sum()), open_[3] + int(np.where(r == 0, d0[a:b], d1[a:b]).sum()),
                     open_[4] + int(np.where(r == 0, d1[a:b], d0[a:b]).sum()))
    if open_ is not None:
        yield row(open_)


def _block_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, block, at, doc, edge, closed``: the pieces of a block joined up to each comma between elements.

    The first and the last part of a block are its edges, which may belong to an element that goes on in other blocks;
    ``closed`` says whether an element ends with the part.
    """
    def rows(path, block, at, doc, edge, closed):
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n), pa.array([block] * n, pa.int64()), pa.array(at, pa.int64()), pa.array(doc, pa.binary()),
             pa.array([edge] * n), pa.array([closed] * n)], ["path", "block", "at", "doc", "edge", "closed"])

    key, held, parts, first = None, None, [], None      # the block, its last whole part, the pieces of the open one and their place
    alone = True                                        # the part held is the block's first

    def finish():
        if held is not None:
            yield rows(*key, [held[0]], [held[1]], alone or not parts, True)
        if parts:
            yield rows(*key, [first], [b",".join(parts)], True, False)

    for batch in batches:
        q, d0, d1, at, carry, depths = (batch.column(c).to_numpy() for c in ("q", "d0", "d1", "at", "carry", "depth"))
        pieces = batch.column("piece")
        for path, block, a, b in _runs(batch):
            if key != (path, block):
                if key is not None:
                    yield from finish()
                key, held, parts, first, alone = (path, block), None, [], None, True
                state, depth = int(carry[a]), int(depths[a])
            s = _parity(q[a:b], state)
            end = depth + np.cumsum(np.where(s == 0, d0[a:b], d1[a:b]))
            ends = a + 1 + np.flatnonzero((end == 1) & ((s + q[a:b]) % 2 == 0))
            state, depth = (state + int(q[a:b].sum())) % 2, int(end[-1])
            if not len(ends):
                first = int(at[a]) if first is None else first
                parts += pieces.slice(a, b - a).to_pylist()
                continue
            if held is not None:
                yield rows(*key, [held[0]], [held[1]], alone, True)
                alone = False
            whole = b",".join([*parts, *pieces.slice(a, int(ends[0]) - a).to_pylist()])
            held, parts, first = (int(at[a]) if first is None else first, whole), [], None
            if len(ends) > 1:
                yield rows(*key, [held[0]], [held[1]], alone, True)
                alone = False
                offsets = pa.array(ends - ends[0], pa.int32())
                docs = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.slice(int(ends[0]), int(ends[-1] - ends[0]))), b",")
                if len(ends) > 2:
                    yield rows(*key, at[ends[:-2]], docs.slice(0, len(docs) - 1), False, True)
                held = int(at[ends[-2]]), docs[-1].as_py()
            if ends[-1] < b:
                parts, first = pieces.slice(int(ends[-1]), b - int(ends[-1])).to_pylist(), int(at[ends[-1]])
    if key is not None:
        yield from finish()


def array_elements(spark: SparkSession, places: Sequence[str]) -> DataFrame:
    """``path, block, at, doc``: the elements of files that hold one array, as text; (block, at) follows their order.

    Files that do not start with a bracket give no rows (``read_json_doc`` is for those), empty arrays neither.  An element
    is held whole by one task, an array never is.  Text after the array stays with the last element, which then is no JSON.
    Pieces are joined where they are read; only the parts at the edges of blocks are moved.
    """
    pieces = _effects(_pieces(spark, places))
    # what a block does, for both states at its start
    blocks = materialise(pieces.select("path", "block", *[F.col(c).cast("long").alias(c) for c in ("q", "d0", "d1")]).mapInArrow(
        _block_effects, "path string, block long, q long, even long, odd long"), "array-blocks")
    by_file = Window.partitionBy("path").orderBy("block")
    files = by_file.rowsBetween(Window.unboundedPreceding, -1)
    state = blocks.withColumn("carry", F.coalesce(F.sum("q").over(files), F.lit(0)) % 2) \
        .withColumn("depth", F.coalesce(F.sum(F.when(F.col("carry") == 0, F.col("even")).otherwise(F.col("odd"))).over(files), F.lit(0))) \
        .select("path", "block", "carry", "depth")
    placed = pieces.join(few(state), ["path", "block"])
    if state.count() > FEW_ROWS:                        # shuffled then
        placed = placed.repartition("path", "block").sortWithinPartitions("path", "block", "at")
    known = placed.select(
        "path", "block", "at", F.col("piece").cast("binary").alias("piece"),
        *[F.col(c).cast("long").alias(c) for c in ("q", "d0", "d1", "carry", "depth")])
    parts = materialise(known.mapInArrow(_block_parts, "path string, block long, at long, doc binary, edge boolean, closed boolean")
                        .withColumn("doc", F.col("doc").cast("string")), "array-parts")
    # an edge goes on with the edge before it, unless that is closed
    order = Window.partitionBy("path").orderBy("block", "at")
    here, all_ = F.struct("block", "at"), Window.partitionBy("path")
    starts = F.coalesce(F.lag("closed").over(order), F.lit(True))
    edges = parts.where("edge").select("path", "block", "at", "closed").withColumn("starts", starts) \
        .withColumn("e", F.max(F.when(F.col("starts"), here)).over(order.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("head", F.min("e").over(all_)).withColumn("tail", F.max("e").over(all_)).drop("closed", "starts")
    joined = parts.where("edge").select("path", "block", "at", "doc").join(few(materialise(edges, "array-edges")), ["path", "block", "at"]) \
        .groupBy("path", "e", "head", "tail").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("block", "at", "doc"))), lambda x: x["doc"]), ",").alias("doc"))
    joined = joined.withColumn("is_head", F.col("e") == F.col("head")).withColumn("is_tail", F.col("e") == F.col("tail"))
    arrays = materialise(joined.where("is_head").where(F.col("doc").rlike(r"^[\s﻿]*\[")).select("path"), "arrays")
    bare = lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    doc = F.when(F.col("is_head"), F.regexp_replace("doc", r"^[\s﻿]*\[", "")).otherwise(F.col("doc"))
    doc = F.when(F.col("is_tail"), F.regexp_replace(doc, r"\]\s*$", "")).otherwise(doc)
    outer = joined.select("path", F.col("e.block").alias("block"), F.col("e.at").alias("at"), bare(doc).alias("doc"),
                          (F.col("head") != F.col("tail")).alias("many")).where((F.col("doc") != "") | F.col("many")).drop("many")
    inner = parts.where("NOT edge").select("path", "block", "at", bare(F.col("doc")).alias("doc"))
    return inner.unionByName(outer).join(few(arrays), "path", "left_semi")
