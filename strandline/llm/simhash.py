"""SimHash near-duplicates by pivot distance tables.

The fingerprints' Hamming distances to fixed reference fingerprints (pivots) are computed once, split by
block of bits.  Two fingerprints at distance d differ by at most d in every pivot distance,
and in all but d blocks their distances to every pivot are equal.  So with six blocks and three
differing bits, some three blocks have equal pivot distances: these are the join key.  Pairs in a key are
discarded by the largest difference of their whole pivot distances; what survives is verified.

Exact copies of a fingerprint are merged first.  A key shared by very many fingerprints is not compared
inside: its members are keyed again by seven of ten blocks.  At most 2**21 fingerprints can agree there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: A key with more fingerprints than this is keyed again.
LARGE_KEY = 4096
PIVOTS = 16
# Reference fingerprints: multiples of an odd number, as signed 64-bit values.
REFERENCES = [int(np.uint64(((i + 1) * 0x9E3779B97F4A7C15) % (1 << 64)).astype(np.int64)) for i in range(PIVOTS)]
CHUNK = 1 << 14


def shingle_hashes(data: bytes | None, shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of the shingles in text order, in parts; a text of fewer words is one shingle, one without words has none."""
    ws = (data or b"").lower().split()              # ASCII letters and blanks only
    h = xxhash.xxh64_intdigest
    n = max(1, len(ws) - shingle + 1) if ws else 0
    for at in range(0, n, CHUNK):
        part = ws[at:min(at + CHUNK, n) + shingle - 1]
        if len(part) < shingle:
            hashes = [h(b" ".join(part), seed)]
        else:
            line = b" ".join(part)
            ends = list(itertools.accumulate(len(w) + 1 for w in part))
            starts = [0, *ends]
            hashes = [h(line[a:b - 1], seed) for a, b in zip(starts, ends[shingle - 1:])]
        yield np.array(hashes, dtype="<u8")


def fingerprint(data: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text's shingles."""
    return fingerprint_of(shingle_hashes(data, shingle, seed))


def fingerprint_of(parts: Iterable[np.ndarray]) -> int:
    """Signed 64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        n += len(hashes)
        ones += bits.sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")
    return of(text.cast("binary"))


def _blocks(n: int) -> list[int]:
    """Masks of ``n`` blocks of nearly equal width, as signed 64-bit values."""
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def pivot_codes(fp: Column, mask: int) -> Column:
    """The block's distances to all pivots, four bits each (a block has at most 11 bits)."""
    distance = lambda r: F.bit_count(fp.bitwiseXOR(F.lit(r)).bitwiseAND(F.lit(mask))).cast("long")
    code = F.lit(0).cast("long")
    for i, r in enumerate(REFERENCES):
        code = code.bitwiseOR(F.shiftleft(distance(r), 4 * i))
    return code


def keyed(fps: DataFrame, blocks: int, equal: int) -> DataFrame:
    """``key, fp``: one row for every choice of ``equal`` blocks, keyed by their pivot distances."""
    with_codes = fps.select("fp", *[pivot_codes(F.col("fp"), m).alias(f"c{i}") for i, m in enumerate(_blocks(blocks))])
    keys = [F.xxhash64(F.lit(k), *[F.col(f"c{i}") for i in chosen])
            for k, chosen in enumerate(itertools.combinations(range(blocks), equal))]
    return with_codes.select("fp", F.explode(F.array(*keys)).alias("key"))


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius``, one fewer than the members of each connected part.

    Grows each part from a member: members not reached yet are compared with it, first by their
    pivot distances, then bit by bit.  Whoever is reached leaves the rest, so dense parts end quickly.
    """
    x = np.unique(fps.astype(np.int64)).view(np.uint64)
    pivots = np.array(REFERENCES, dtype=np.int64).view(np.uint64)
    if len(x) == 2:                                 # the most common key
        return [(int(fps.min()), int(fps.max()))] if np.bitwise_count(x[0] ^ x[1]) <= radius else []
    table = np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int8)
    rest, links = np.arange(len(x)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.abs(table[rest, 0] - table[i, 0]) <= radius
            for p in range(1, table.shape[1]):
                if near.sum() * 4 < len(rest) or p > 3:
                    break
                near &= np.abs(table[rest, p] - table[i, p]) <= radius
            cand = rest[near]
            cand = cand[np.abs(table[cand] - table[i]).max(axis=1, initial=0) <= radius]
            cand = cand[np.bitwise_count(x[cand] ^ x[i]) <= radius]
            if len(cand):
                links += [(int(x.view(np.int64)[i]), int(v)) for v in x.view(np.int64)[cand]]
                rest = np.setdiff1d(rest, cand, assume_unique=True)
                queue += cand.tolist()
    return links


def _links(groups: DataFrame, radius: int) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for members in b["fps"]:
                if links := spanning_links(np.asarray(members), radius):
                    yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    # keys are few bytes but real work: dealt out by number, or they would be merged into one task
    spread = groups.repartition(4 * groups.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(find, "a long, b long")


def near_links(fps: DataFrame, radius: int = RADIUS, large: int = LARGE_KEY) -> DataFrame:
    """``a, b``: links that connect all fingerprints (column ``fp``, distinct) within ``radius`` bits."""
    if radius > 3:
        raise ValueError("the blocks are laid out for at most three differing bits")
    rows = keyed(fps, 6, 3)
    sizes = rows.groupBy("key").count().where("count > 1")
    shared = materialise(rows.join(sizes, "key"), "fingerprint-keys")
    plain = shared.where(F.col("count") <= large).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    again = keyed(shared.where(F.col("count") > large).select("fp").distinct(), 10, 7)
    # at most 2**21 values agree on seven of ten blocks
    fine = again.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return _links(plain.select("fps").unionAll(fine.select("fps")), radius)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every document.

    ``component_id`` is the smallest id that chains of near fingerprints reach.  Null and empty texts have
    fingerprint 0 and are linked like any other.  A null id takes part and gets the smallest id of its
    component, null if there is none.  Repeated rows stay repeated.
    """
    marked = materialise(docs.select(F.col(doc_id).alias("doc_id"),
                                     fingerprint_column(F.col(text), shingle).alias("fp")), "fingerprints")
    return marked.join(component_ids(marked, radius), "fp").select("doc_id", "fp", "component_id")


def component_ids(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, component, component_id`` for ``doc_id, fp`` rows; ``component`` is the smallest fingerprint."""
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    parts = components(near_links(fps.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    joined = fps.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return materialise(joined.select("fp", "component").join(least, "component")
                       .select("fp", "component", "component_id"), "components")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id.

    Of rows with the same smallest id one stays (that of the smallest text hash); rows without id stay only if their
    component has no id at all, one of them.  Columns are unchanged.
    """
    marked = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                                     fingerprint_column(F.col(text), **options).alias("fp")), "fingerprints")
    ids = component_ids(marked.select("doc_id", "fp")).select("fp", "component")
    return first_rows(docs, marked.join(ids, "fp"), text, doc_id)


def first_rows(docs: DataFrame, parts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component of ``parts (doc_id, text_hash, component)``, ids before no id.

    Ids may repeat in several components, or be missing there; equal texts are in one component.

    Whole rows are dealt out once, by a hash of id and text; conditions on these are written so that they do not become keys of
    the join as well, whose rows would be dealt out again to leave one of each component.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = parts.groupBy("component").agg(F.min(order).alias("k")) \
        .select("component", F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("_i"),
                      F.xxhash64(text).alias("_h")).withColumn("_at", F.xxhash64("_i", "_h"))
    same = F.when(F.col("_i").isNull(), F.col("_id").isNull()).otherwise(F.col("_i") == F.col("_id")) \
        & (F.col("_h").bitwiseXOR(F.col("_hash")) == 0)
    best = row.join(kept.withColumn("_to", F.xxhash64("_id", "_hash")), (F.col("_at") == F.col("_to")) & same)
    return best.dropDuplicates(["_at", "component"]).select("row.*")
