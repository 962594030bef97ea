"""Hard negatives by bounds along spanning trees of anchors.

Anchors are taken in blocks.  Each block has a minimum spanning tree over its vectors; an edge of length e between a parent
and a child bounds the child's score of a candidate c to the parent's score plus or minus e * |c|.  Down the tree only
candidates whose bounds overlap what an anchor still looks for (scores not below its worst positive so far, or inside the
window of one of its positives) are scored again, exactly; the others pass their bounds on.

The blocks of a pass are broadcast, at most ``ANCHORS`` vectors whatever the table, and every row is held against them where it lies.
A task sends its best few rows for an anchor, which Spark ranks.  Scores are integers, so any split of the rows gives the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import materialise, shared_dir, spread_small

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Anchors of one pass over the rows, and of one tree.
ANCHORS, TREE = 4096, 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score as hundredths of the positive's.
LEAST, MOST = 50, 95
#: Rows that are scored at once.
ROWS = 4096
#: Vectors must be shorter, so that scores are whole 64-bit numbers.
LONGEST = float(2 ** 31)

_ANCHORS = "anchor long, anchor_id long"


class Tree(NamedTuple):
    """Anchors, parents before children; ``edge`` is the distance to the parent (-1: the root)."""
    number: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    parent: list[int]
    edge: list[float]


def spanning_tree(vectors: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Order, parents (as places in the order) and edge lengths of a minimum spanning tree, grown from the first vector."""
    n = len(vectors)
    v = vectors.astype(float)
    near, link = np.full(n, np.inf), np.zeros(n, np.int64)
    place = np.zeros(n, np.int64)
    order, parent, edge, now = [0], [-1], [0.0], 0
    near[0] = -1.0
    for _ in range(n - 1):
        far = np.sqrt(((v - v[now]) ** 2).sum(axis=1))
        closer = far < near
        near[closer], link[closer] = far[closer], now
        free = np.where(near < 0, np.inf, near)
        now = int(free.argmin())
        place[now] = len(order)
        order.append(now)
        parent.append(int(place[link[now]]))
        edge.append(float(near[now]))
        near[now] = -1.0
    return order, parent, edge


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Vectors as lines; missing components are zero."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for line, r in zip(out, rows):
        line[:len(r)] = r
    return out


def trees(rows: list[tuple[int, int, int, list[int]]], size: int = TREE) -> list[Tree]:
    """Trees over (number, vec_id, label, vector), anchors of one label side by side."""
    rows = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    out = []
    for at in range(0, len(rows), size):
        part = rows[at:at + size]
        m = _matrix([r[3] for r in part])
        order, parent, edge = spanning_tree(m)
        number, vec_id, label = (np.array([part[k][c] for k in order], np.int64) for c in range(3))
        m = m[order]
        out.append(Tree(number, vec_id, label, m, np.sqrt((m.astype(float) ** 2).sum(axis=1)), parent, edge))
    return out


def exact_scores(rows: np.ndarray, norms: np.ndarray, vector: np.ndarray, norm: float) -> np.ndarray:
    """Integer inner products; floating point is exact while the product of the lengths is below 2**53."""
    d = min(rows.shape[1], len(vector))
    if norms.max(initial=0.0) * norm < 2.0 ** 52:
        return (rows[:, :d].astype(float) @ vector[:d].astype(float)).astype(np.int64)
    return rows[:, :d] @ vector[:d]


def down_the_tree(tree: Tree, rows: np.ndarray, norms: np.ndarray, wanted: Callable, take: Callable) -> int:
    """Visit the anchors of a tree: ``wanted(k, lo, hi)`` marks the rows whose bounds overlap what anchor k looks for,
    ``take(k, which, scores)`` gets their exact scores.  Returns how many scores were computed."""
    lo, hi, done = [], [], 0
    plain = rows.astype(float) if norms.max(initial=0.0) * tree.norms.max(initial=0.0) < 2.0 ** 52 else rows
    for k, parent in enumerate(tree.parent):
        if parent < 0:
            low = high = np.empty(len(rows))
            which = np.arange(len(rows))
        else:
            slack = tree.edge[k] * norms * (1 + 1e-9) + 1e-3
            low, high = lo[parent] - slack, hi[parent] + slack
            which = np.flatnonzero(wanted(k, low, high))
        part = plain if len(which) == len(rows) else plain[which]
        scores = exact_scores(part, norms, tree.vectors[k], tree.norms[k]) if len(which) else np.zeros(0, np.int64)
        done += len(which)
        if parent < 0:
            low = high = scores.astype(float)
        else:
            low[which] = high[which] = scores
        lo.append(low)
        hi.append(high)
        take(k, which, scores)
    return done


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((ids, -scores))[:most]
    return scores[top], ids[top]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels, vectors and lengths of a bounded number of rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            q = b.column(2)
            sizes = np.diff(q.offsets.to_numpy())
            flat = q.flatten().to_numpy()
            if len(sizes) and (sizes == sizes[0]).all():
                m = flat.reshape(len(sizes), -1) if sizes[0] else np.zeros((len(sizes), 0), np.int64)
            else:
                m = _matrix(q.to_pylist())
            yield b.column(0).to_numpy(), b.column(1).to_numpy(), m, np.sqrt((m.astype(float) ** 2).sum(axis=1))


NO_SCORES = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def best_positives(forest: list[Tree], batches: Iterator[pa.RecordBatch], most: int) -> dict[int, tuple]:
    """Scores and ids of the best rows of the same label, by anchor number."""
    best: dict[int, tuple] = {}
    for ids, labels, rows, norms in _batches(batches):
        for tree in forest:
            def wanted(k, low, high):
                scores, _ = best.get(int(tree.number[k]), NO_SCORES)
                open_ = labels == tree.label[k]
                return open_ & (high >= scores[-1]) if len(scores) == most else open_

            def take(k, which, scores):
                good = (labels[which] == tree.label[k]) & (ids[which] != tree.vec_id[k])
                if good.any():
                    old = best.get(int(tree.number[k]), NO_SCORES)
                    best[int(tree.number[k])] = _best(np.append(old[0], scores[good]),
                                                      np.append(old[1], ids[which][good]), most)
            down_the_tree(tree, rows, norms, wanted, take)
    return best


def best_negatives(forest: list[Tree], windows: dict[int, list[tuple[int, int]]], batches: Iterator[pa.RecordBatch],
                   most: int) -> dict[tuple[int, int], tuple]:
    """Scores and ids of the best rows of other labels in every window (lowest, highest score), by anchor and window."""
    best: dict[tuple[int, int], tuple] = {}
    for ids, labels, rows, norms in _batches(batches):
        for tree in forest:
            def wanted(k, low, high):
                n, overlap = int(tree.number[k]), np.zeros(len(ids), bool)
                for j, (least, top) in enumerate(windows.get(n, ())):
                    scores, _ = best.get((n, j), NO_SCORES)
                    overlap |= (high >= (max(least, scores[-1]) if len(scores) == most else least)) & (low <= top)
                return overlap & (labels != tree.label[k])

            def take(k, which, scores):
                n = int(tree.number[k])
                other = (labels[which] != tree.label[k]) & (ids[which] != tree.vec_id[k])
                for j, (least, top) in enumerate(windows.get(n, ())):
                    good = other & (scores >= least) & (scores <= top)
                    if good.any():
                        old = best.get((n, j), NO_SCORES)
                        best[n, j] = _best(np.append(old[0], scores[good]), np.append(old[1], ids[which][good]), most)
            down_the_tree(tree, rows, norms, wanted, take)
    return best


def score_window(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """Lowest and highest negative score that the hundredths of a positive score allow."""
    return -(-least * score // 100), most * score // 100


def _ranked(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
           scale: int = SCALE) -> DataFrame:
    """``vec_id, label, q`` of the rows that take part, each once: components times ``scale``, rounded down."""
    component = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731   NaN is above infinity
    short = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(F.lit(float(scale)) * x.cast("double"), F.lit(2.0))) \
        < LONGEST ** 2 / 2
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                       F.col(vector).alias("v")) \
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()) \
        .where(F.forall("v", finite)).withColumnRenamed("v", vector).where(short) \
        .select("vec_id", "label", F.transform(vector, component).alias("q")).distinct()


def mine(rows: DataFrame, is_anchor: Callable[[Column], Column], vec_id: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
         most: int = MOST, anchors: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each anchor (rows whose id satisfies ``is_anchor``) its best ``positives`` other rows of the same label, and for each of
    them the best ``negatives`` rows of another label whose score is ``least`` to ``most`` hundredths of the positive's.  Higher
    inner products come first, ties by smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part, nor do vectors of scaled length
    2**30.5 or more, whose products could leave 64 bits.  Repeated rows count once; rows that share an id but differ are rows
    of their own (and anchors of their own), but never positives or negatives of an anchor with their id.  Vectors of different
    lengths are filled up with zeros.  Anchors without positives or fitting negatives, and empty tables, give no rows.
    """
    spark = rows.sparkSession
    vectors = materialise(usable(rows, vec_id, vector, label), "vectors")
    number = F.xxhash64("vec_id", "label", "q")
    marked = vectors.where(is_anchor(F.col("vec_id")))
    passes = -(-marked.count() // anchors)
    dealt = spread_small(vectors)
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex[:8]}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for k in range(passes):
        mine_k = marked.where(F.pmod(F.xxhash64(F.lit(7), "vec_id", "q"), F.lit(passes)) == k)
        block = [(r["n"], r["vec_id"], r["label"], r["q"]) for r in
                 mine_k.select(number.alias("n"), "vec_id", "label", "q").collect()]
        forest = spark.sparkContext.broadcast(trees(block))

        def positive_rows(batches: Iterator[pa.RecordBatch], forest=forest) -> Iterator[pa.RecordBatch]:
            for n, (scores, ids) in best_positives(forest.value, batches, positives).items():
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)],
                                                 ["anchor", "vec_id", "score"])
        own = materialise(_ranked(dealt.mapInArrow(positive_rows, "anchor long, vec_id long, score long"), ["anchor"],
                                  positives), "positives")
        windows: dict[int, list[tuple[int, int]]] = {}
        for r in own.orderBy("anchor", "rank").collect():           # ``positives`` rows an anchor of the pass
            windows.setdefault(r["anchor"], []).append(score_window(r["score"], least, most))
        shared = spark.sparkContext.broadcast(windows)

        def negative_rows(batches: Iterator[pa.RecordBatch], forest=forest, shared=shared) -> Iterator[pa.RecordBatch]:
            for (n, j), (scores, ids) in best_negatives(forest.value, shared.value, batches, negatives).items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(ids), pa.int64()), pa.array([j + 1] * len(ids), pa.int32()), pa.array(ids),
                     pa.array(scores)], ["anchor", "window", "vec_id", "score"])
        found = _ranked(dealt.mapInArrow(negative_rows, "anchor long, window int, vec_id long, score long"),
                        ["anchor", "window"], negatives)
        ids = spark.createDataFrame([(n, i) for n, i, _, _ in block], _ANCHORS)
        (found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
         .join(F.broadcast(own.select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"),
                                      F.col("score").alias("positive_score"))), ["anchor", "window"])
         .join(F.broadcast(ids), "anchor").select(*[c.split()[0] for c in schema.split(", ")])
         .write.mode("append").parquet(path))
        forest.destroy()
        shared.destroy()
    return spark.read.schema(schema).parquet(path) if passes else spark.createDataFrame([], schema)
