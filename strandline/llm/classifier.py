"""Quality classifier: nearest neighbours among labelled latent-semantic vectors.

A text becomes a histogram of terms (hashed words, hashed triples of character
classes, repetition marks); a truncated SVD of the labelled texts gives the
latent space.  The labelled vectors are broadcast; each document's cosine
products with all of them are computed in blocks, and its nearest neighbours vote
with weights that grow with the similarity.

The model is fitted on at most ``PER_CLASS`` labelled texts of each class, so its
size, and that of the broadcast, is fixed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Bound of the labelled sample per class; the rows with the smallest hash of their id are taken.
PER_CLASS = 1500
WORD_TERMS = 1024
SHAPE_TERMS = 1024
MARKS = 8
TERMS = WORD_TERMS + SHAPE_TERMS + MARKS
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 6
BLOCK = 256
ACCEPT = 0.7
#: A text is read in pieces of this many bytes; a histogram is the sum of those of its pieces.
PIECE = 1 << 20

_CLASS = np.full(256, 1, dtype=np.int64)                     # 1: letters of any case but capitals, and non-ASCII
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[33:48] = np.arange(4, 19)
_CLASS[58:65] = np.arange(19, 26)
_CLASS[91:97] = np.arange(26, 32)
_CLASS[123:127] = np.arange(32, 36)
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = 36
_CLASS[10] = 37
# Weights of the three groups of terms.
_GROUPS = np.concatenate([np.full(WORD_TERMS, 0.5), np.full(SHAPE_TERMS, 1.0), np.full(MARKS, 1.0)])


def _pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Pieces cut at blanks where there is one near the end."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield data[at:end]
        at = end


def _word_hashes(b: np.ndarray) -> np.ndarray:
    """One 64-bit number per word: sum of byte numbers times powers of an odd base."""
    n = len(b)
    blank = _CLASS[b]
    inside = (blank != 0) & (blank != 37)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * _POWERS[:n], dtype=np.uint64)))
        return mix64((sums[ends] - sums[starts]) * _INVERSE[starts])


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, dtype=np.uint64))))


_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS = _powers(PIECE + 1, _BASE)
_INVERSE = _powers(PIECE + 1, pow(_BASE, -1, 1 << 64))


def term_counts(data: bytes) -> np.ndarray:
    """Square roots of the relative term counts of a UTF-8 text, by group."""
    words, shapes = np.zeros(WORD_TERMS), np.zeros(SHAPE_TERMS)
    n_words = same = distinct = 0
    for piece in _pieces(data):
        b = np.frombuffer(piece, dtype=np.uint8)
        h = _word_hashes(b)
        words += np.bincount((h % np.uint64(WORD_TERMS)).astype(np.int64), minlength=WORD_TERMS)
        n_words += len(h)
        same += int((h[1:] == h[:-1]).sum())
        distinct += len(np.unique(h))
        c = _CLASS[b]
        # runs of one class count once, so a shape is a change of class
        c = c[np.concatenate(([True], c[1:] != c[:-1]))]
        if len(c) > 2:
            t = (c[:-2] * 1444 + c[1:-1] * 38 + c[2:]) % 1021
            shapes += np.bincount(t, minlength=SHAPE_TERMS)
    marks = np.zeros(MARKS)
    marks[0] = 0.05                                          # keeps empty texts from being without direction
    if n_words:
        marks[1] = same / n_words
        marks[2] = max(0.0, 0.5 - distinct / n_words)
    out = np.concatenate((np.sqrt(words / max(1.0, words.sum())), np.sqrt(shapes / max(1.0, shapes.sum())),
                          np.sqrt(marks)))
    return (out * _GROUPS).astype(np.float32)


def fit(vectors: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 7) -> dict:
    """Latent axes by a randomised truncated SVD, and the labelled texts in that space."""
    x = vectors.astype(np.float64)
    rng = np.random.default_rng(seed)
    k = min(rank, *x.shape)
    y = x @ rng.standard_normal((x.shape[1], min(k + 12, x.shape[1])))
    for _ in range(3):
        y = np.linalg.qr(x @ (x.T @ y))[0]
    _, _, vt = np.linalg.svd(np.linalg.qr(y)[0].T @ x, full_matrices=False)
    axes = vt[:k].T.astype(np.float32)
    return {"axes": axes, "points": _unit(vectors @ axes), "labels": labels.astype(np.float32),
            "prior": float((labels.sum() + 1) / (len(labels) + 2))}


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def vote(model: dict, vectors: np.ndarray) -> np.ndarray:
    """Scores of a block of texts."""
    if not len(model["labels"]):
        return np.full(len(vectors), model["prior"])
    sims = _unit(vectors @ model["axes"]) @ model["points"].T
    k = min(NEIGHBOURS, sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    w = np.clip(np.take_along_axis(sims, near, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
    total = w.sum(axis=1)
    score = (w * model["labels"][near]).sum(axis=1) / np.maximum(total, 1e-12)
    return np.round(np.clip(np.where(total > 1e-9, score, model["prior"]), 0, 1), 6)


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality",
                    per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, label`` of at most ``per_class`` documents of each class, by the order of a hash.

    Rows without id or label are left out; a document with several labels takes the smallest.
    """
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train)
           .groupBy("doc_id").agg(F.min(label).cast("int").alias("label")))
    there = one.join(docs.select("doc_id"), "doc_id", "left_semi")
    ordered = [there.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
               for v in (0, 1)]
    return ordered[0].unionAll(ordered[1])


def train_model(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality",
                per_class: int = PER_CLASS) -> dict:
    """Fitted by one task on the sample's vectors (a fixed number of fixed length); only the model comes to the driver."""
    sample = labelled_sample(docs, labels, train, label, per_class)

    def vectors(batches):
        for b in batches:
            yield pd.DataFrame({"v": [term_counts(t or b"").tobytes() for t in b["text"]], "label": b["label"],
                                "doc_id": b["doc_id"]})

    def model(batches):
        x, y = [], []
        for b in batches:
            x += [np.frombuffer(v, dtype=np.float32) for v in b["v"]]
            y += b["label"].tolist()
        if y:
            yield pd.DataFrame({"model": [pickle.dumps(fit(np.array(x), np.array(y, dtype=np.float32)))]})
    # the sample is bounded by 2 * per_class rows
    rows = (docs.select("doc_id", F.col("text").cast("binary").alias("text"))
            .join(F.broadcast(sample), "doc_id")
            .mapInPandas(vectors, "v binary, label int, doc_id long")
            .orderBy("doc_id", "v").limit(4 * per_class))
    found = rows.repartition(1).sortWithinPartitions("doc_id", "v").mapInPandas(model, "model binary").first()
    if found is None:
        return {"axes": np.zeros((TERMS, 1), np.float32), "points": np.zeros((0, 1), np.float32),
                "labels": np.zeros(0, np.float32), "prior": 0.5}
    return pickle.loads(found[0])


def score_column(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """Score of each whole text; the text is its only input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            out = np.empty(len(texts))
            for at in range(0, len(texts), BLOCK):
                block = np.stack([term_counts(t or b"") for t in texts.iloc[at:at + BLOCK]])
                out[at:at + len(block)] = vote(m, block)
            yield pd.Series(out)
    return score(F.col(text).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out and never trains."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``docs`` in a struct ``row``, with ``score`` (0 to 1) and ``predicted``.

    ``docs`` needs ``doc_id`` and ``text``; a null text counts as empty.  Equal texts get equal scores.  Without
    labelled rows every score is 0.5; with one class only, that class wins.  Of repeated ids with different texts
    all texts may be in the sample, up to its bound.
    """
    model = train_model(docs, labels, ~held_out(F.col("doc_id")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("_text"))
    scored = rows.withColumn("score", score_column(rows, model, "_text")).drop("_text")
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
