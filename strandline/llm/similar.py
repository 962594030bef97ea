"""Near-duplicates by SimHash and exact similarity of their shingle sets.

Fingerprints of the shingles within three bits, found by pivot distance tables as in ``simhash``, give the first pairs.  Each is
verified on the whole sets, and what they connect is not compared again.  Similar texts often differ by more bits, so a
prefix filter finds every pair that is left:

Two sets of Jaccard similarity 4 / 5 or more share a shingle among the first fifth (and one) of each, whatever the order of
shingles, as long as it is one order: the prefix filter.  Shingles that are common in a sample of the texts come last,
so that lines found everywhere are seldom keys; the sample decides on the order only, never on a result.

Texts that share a key are pairs to be compared.  Keys of many texts are compared with three of their members
together with the first pairs; what then is in different components is compared pair by pair.  Pairs whose sketches already differ too much
are left out.  The sketch says little of long texts: these have some more keys than the prefix filter needs, and similar ones share as many
keys as either has more.  Two long texts that have a sentence in common are no pair by that, or pairs would grow with the square of such
texts.  Every pair that is left is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .common import slices, small
from .components import components
from .simhash import fingerprint_of, first_rows, near_links, shingle_hashes

SHINGLE = 5
#: Least similarity, as numerator and denominator.
SIMILAR = (4, 5)
#: Texts in the sample that orders shingles, and how many of these make a shingle common.
SAMPLE, COMMON, MOST_COMMON = 20_000, 5, 500_000
#: A set of more shingles has one more key for every so many beyond.
LONG, LONG_STEP = 1024, 64
#: Keys with more texts are compared with three of them first.
LARGE_KEY = 64
#: Rows and bytes of text that a task marks or compares at once, and hashes of sets that it remembers.
ROWS, BYTES, REMEMBERED = 256, 1 << 20, 1 << 21
#: Bits of the sketch that a set's shingles flip: two sets differ in as many shingles at least as their sketches in bits.
BITS = 1024


def shingle_set(data: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    return _set_of(list(shingle_hashes(data, shingle)))


def _set_of(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64)


def least_shared(n: np.ndarray) -> np.ndarray:
    """Keys that a set of ``n`` shingles shares at least with a similar one; the smaller number holds for a pair."""
    return 1 + np.maximum(0, n - LONG) // LONG_STEP


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order (rank among the common ones, hash), so many that similar sets share ``least_shared``.

    Of the shingles that two similar sets share, the first ``least_shared`` in the order are followed in each set by all others that
    it shares, four fifths of the set or more together.
    """
    up, down = SIMILAR
    n = len(found)
    if not n:
        return np.zeros(1, np.int64)                # texts without words are alike
    take = n - -(-n * up // down) + int(least_shared(n))
    at = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
    known = common[at] == found if len(common) else np.zeros(n, bool)
    rare = found[~known]
    if len(rare) >= take:
        return np.partition(rare, take - 1)[:take]
    late = found[known][np.argsort(rank[at[known]], kind="stable")]
    return np.concatenate([rare, late[:take - len(rare)]])


def sketch(found: np.ndarray) -> bytes:
    """Which bits an odd number of shingles flips."""
    flips = np.bincount(found.view(np.uint64) % np.uint64(BITS), minlength=BITS)
    return np.packbits(flips % 2 == 1).tobytes()


def marks_of(batch: pa.RecordBatch, common: np.ndarray, rank: np.ndarray, shingle: int) -> pa.RecordBatch:
    """``node, n, keys, sketch, fp`` for ``node, text``; only what is returned is held for more than one text."""
    n, keys, sketches, fps = [], [], [], []
    for t in batch.column(1):
        parts = list(shingle_hashes(t.as_py(), shingle))
        found = _set_of(parts)
        n.append(len(found))
        keys.append(prefix(found, common, rank).copy())      # a view would hold the whole set
        sketches.append(sketch(found))
        fps.append(fingerprint_of(parts))
    edges = np.cumsum([0, *map(len, keys)], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(keys)))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), lists, pa.array(sketches, pa.binary()),
                                       pa.array(fps, pa.int64())], ["node", "n", "keys", "sketch", "fp"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    up, down = SIMILAR
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


def _common(texts: DataFrame, rows: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample share, sorted, and their ranks (the most frequent one is last)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle))], ["key"])
    part = max(1, rows // SAMPLE)
    counts = (texts.where(F.pmod(F.col("node"), F.lit(part)) == 0).dropDuplicates(["node"]).select("text")
              .mapInArrow(sets, "key long").groupBy("key").count().where(F.col("count") >= COMMON)
              .orderBy(F.desc("count"), "key").limit(MOST_COMMON).toPandas())
    keys = counts["key"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def _pairs(groups: DataFrame, star: bool = False) -> DataFrame:
    """``a, b`` for ``members``, arrays of (size, node, part, sketch) that share ``shared`` keys: members of different parts,
    sizes and the keys that they share in all groups permitting.

    With ``star`` members of large groups are compared with three of them only.
    """
    up, down = SIMILAR

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, shared in zip(batch.column(0), batch.column(1).to_pylist()):
                m = g.values
                n, node, part = (m.field(k).to_numpy() for k in ("n", "node", "part"))
                marks = np.frombuffer(b"".join(m.field("sketch").to_pylist()), np.uint64).reshape(len(n), -1)
                large = star and len(n) > LARGE_KEY
                for i in {0, len(n) // 2, len(n) - 1} if large else range(len(n) - 1):
                    end = np.searchsorted(n, n[i] * down // up, side="right")     # members are sorted by size
                    start = np.searchsorted(n, -(-n[i] * up // down)) if large else i + 1
                    flipped = np.bitwise_count(marks[start:end] ^ marks[i]).sum(axis=1, dtype=np.int64)
                    near = (up + down) * flipped <= (down - up) * (n[start:end].astype(np.int64) + n[i])
                    near &= part[start:end] != part[i]
                    other = node[start:end][near]
                    if len(other):
                        least = np.minimum(least_shared(n[start:end][near].astype(np.int64)), least_shared(int(n[i])))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.minimum(other, node[i])), pa.array(np.maximum(other, node[i])),
                             pa.array(np.full(len(other), shared, np.int64)), pa.array(least)], ["a", "b", "shared", "least"])
    spread = groups.repartition(4 * groups.sparkSession.sparkContext.defaultParallelism)
    found = spread.select("members", "shared").mapInArrow(find, "a long, b long, shared long, least long")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")) \
        .where("shared >= least").select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs with similar sets."""
    pairs = materialise(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    found = materialise(texts.join(small(nodes), "node", "left_semi").dropDuplicates(["node"]), "pair-texts")
    side = lambda name: found.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        held = 0

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if node not in seen:
                if held > REMEMBERED:
                    seen.clear()
                    held = 0
                seen[node] = shingle_set(text.as_py(), shingle)
                held += len(seen[node])
            return seen[node]
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            keep = [alike(of(i, s), of(j, t)) for i, j, s, t in zip(a, b, batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    # the exchange of distinct() lets many small tasks end in few files
    return materialise(both.mapInArrow(similar, "a long, b long").distinct(), "similar-pairs")


def _groups(held: DataFrame, texts_of: DataFrame) -> DataFrame:
    """``members, shared`` for :func:`_pairs`: the texts of several parts that share keys (``held``: key, node), each group once,
    and how many keys these are.

    Keys collect only the nodes.  Sizes and sketches come to a group after the keys with the same nodes are one; two groups
    of the same hash would be compared as one, which loses no pair.
    """
    sets = (held.join(texts_of.select("node", "part"), "node").groupBy("key")
            .agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.min("part").alias("lo"), F.max("part").alias("hi"))
            .where("lo <> hi").groupBy("nodes").agg(F.count(F.lit(1)).alias("shared")))
    member = F.struct("n", "node", "part", "sketch")
    return (sets.select(F.xxhash64("nodes").alias("group"), "shared", F.explode("nodes").alias("node")).join(texts_of, "node")
            .groupBy("group", "shared").agg(F.array_sort(F.collect_list(member)).alias("members")))


def _near_pairs(marked: DataFrame) -> DataFrame:
    """``a, b``: nodes that connect all texts whose fingerprints (``node, fp``) are equal or within reach of the pivot tables."""
    fps = materialise(marked.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    links = near_links(fps.select("fp"))
    side = lambda name: fps.select(F.col("fp").alias(name), F.col("first").alias(f"node_{name}"))
    near = links.join(side("a"), "a").join(side("b"), "b").select("node_a", "node_b")
    pairs = near.unionAll(marked.select("node", "fp").join(fps, "fp").select("first", "node"))
    return pairs.where("node_a <> node_b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def similar_parts(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``node, component`` of the texts (``node``, ``text``; equal nodes have equal texts) with another one like them.

    Chains of similar texts are one component, named by its smallest node.
    """
    texts = texts.select("node", F.col("text").cast("binary").alias("text"))
    common, rank = _common(texts, texts.count(), shingle)
    shared = texts.sparkSession.sparkContext.broadcast((common, rank))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, BYTES, ROWS):
                yield marks_of(part, *shared.value, shingle)
    marked = materialise(texts.mapInArrow(mark, "node long, n int, keys array<bigint>, sketch binary, fp long"), "prefixes")
    rows = marked.select("node", F.explode("keys").alias("key"))
    keys = materialise(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                       .where("lo <> hi").select("key"), "shared-keys")
    held = materialise(rows.join(small(keys), "key").distinct(), "shared-rows")
    texts_of = materialise(marked.join(small(held.select("node").distinct()), "node", "left_semi")
                           .select("node", "n", "sketch").distinct(), "marks")
    large = held.join(small(held.groupBy("key").count().where(F.col("count") > LARGE_KEY).select("key")), "key")
    first = _pairs(_groups(large, texts_of.withColumn("part", F.col("node"))), star=True)
    links = _verified(_near_pairs(marked).unionAll(first).distinct(), texts, shingle)
    parts = components(links)
    known = texts_of.join(small(parts), "node", "left").withColumn("part", F.coalesce("component", "node"))
    more = _verified(_pairs(_groups(held, known)), texts, shingle)
    return components(links.unionAll(more))


def one_of_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component of similar texts, chosen as ``one_of_each`` does.  Columns are unchanged."""
    parts = similar_parts(docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("text")), shingle)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(small(parts.withColumnsRenamed({"node": "text_hash"})), "text_hash", "left")
    return first_rows(docs, joined.withColumn("component", F.coalesce("component", "text_hash")), text, doc_id)
