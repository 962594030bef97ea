"""Removal of repeated byte strings by distributed prefix doubling.

Of every ``length`` bytes that follow one another the place of the least mixed 8-byte gram is the sample place: equal strings
have it at the same offset, and only some two in a hundred bytes are such places.  A block of offsets stands for the
strings that start that far before a place.  All of them hold the block's inner bytes, and the block's outer bytes hold all of them.

Places are ranked by the inner bytes of two wide blocks.  Then rounds follow: Spark sorts the pairs (rank, the bytes by which a
narrower block's inner bytes grow to both sides) and ranks them again.  What is unique drops out, since nothing that long
occurs twice there; what has outer bytes that occur elsewhere is past the threshold and settled as a whole, one place going on for
all equal ones.  In the last round a block is one string, inner and outer bytes are the same and nothing is left open.

Ranks only choose what is compared; what is removed rests on equal 128-bit digests of outer bytes, built up from those of inner
bytes and the margins around them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .common import mix64, slices, small

LENGTH = 200
GRAM = 8


def widths(length: int) -> list[int]:
    """Offsets in a block, round by round."""
    out = [-(-(length - GRAM + 1) // 2)]
    while out[-1] > 1:
        out.append(-(-out[-1] // 4) if out[-1] > 8 else 1)
    return out


def least_of(keys: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbouring keys."""
    n = len(keys)
    if n < size:
        return keys[:0]
    blocks = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, size)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - size + 1], before[size - 1:n])


def sample_places(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample places of texts joined to ``data``, and the least and greatest offset at which strings hold each."""
    n = len(data) - GRAM + 1
    if n < length - GRAM + 1:
        return (np.zeros(0, np.int64),) * 3
    grams = np.ndarray((n,), "<u8", data, strides=(1,))
    keys = (mix64(grams) >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    at = (least_of(keys, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(at) + 1, np.int64)        # strings that lie in one text
    whole = ends - starts >= length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, np.minimum(ends[whole] - length + 1, len(at)), -1)
    where = np.flatnonzero(np.cumsum(inside[:-1]))
    at = at[where]
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else where
    last = np.append(new[1:], len(at)) - 1 if len(at) else where
    return at[new], at[new] - where[last], at[new] - where[new]


#: A place and its block in one number: place, first and last offset.
_A, _B = 1 << 24, 1 << 12


def _unpacked() -> tuple[Column, Column, Column]:
    v = F.col("place")
    return F.shiftright(v, 24), F.shiftright(v, 12).bitwiseAND(_B - 1), v.bitwiseAND(_B - 1)


def places(length: int):
    """Rows ``k, place, inner``: places in texts with the wide blocks that hold a string, and the digest of the inner bytes."""
    w, top = widths(length)[0], length - GRAM

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [x.as_py() for x in batch.column(1)]
                data = b"".join(texts)
                sizes = np.array([len(x) for x in texts])
                ends = np.cumsum(sizes)
                p, least, most = sample_places(data, ends, length)
                owner = np.searchsorted(ends, p, side="right")
                for a in range(0, top + 1, w):
                    b = min(a + w - 1, top)
                    has = (least <= b) & (most >= a)
                    q, mine = p[has], owner[has]
                    inner = [digest(data[i:j], a) for i, j in zip((q - a).tolist(), (q - b + length).tolist())]
                    place = (q - ends[mine] + sizes[mine]) * _A + a * _B + b
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(mine)), pa.array(place, pa.int64()),
                         pa.array(np.array(inner, np.uint64).view(np.int64))], ["k", "place", "inner"])
    return find


def _listed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """Number, text, places, ranks and where outer and inner bytes start and end, row by row, of few rows at a time."""
    for whole in batches:
        for batch in slices(whole, 1, rows=128):
            for n, text, found in zip(batch.column(0), batch.column(1), batch.column(2)):
                n, text, found = n.as_py(), text.as_py(), found.values
                place, rank = (found.field(k).to_numpy() for k in ("place", "rank"))
                p, a, b = place // _A, place // _B % _B, place % _B
                here = (p >= a) & (p - b + length <= len(text))     # a list may hold places of another text, too
                place, rank, p, a, b = (x[here] for x in (place, rank, p, a, b))
                outer = np.maximum(p - b, 0), np.minimum(p - a + length, len(text))
                yield n, text, place, rank, outer, (p - a, p - b + length), a


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def outer_digests(length: int):
    """Rows ``n, place, rank, w1, w2`` for texts with a list of places: the digest of the outer bytes, null where the text has not
    all of them."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, text, place, rank, (s, e), _, a in _listed(batches, length):
            w = _halves([xxhash.xxh3_128_digest(text[i:j], k) for i, j, k in zip(s.tolist(), e.tolist(), a.tolist())])
            part = pa.array(e - s < length + place % _B - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), n)), pa.array(place), pa.array(rank),
                 *[pc.if_else(part, pa.scalar(None, pa.int64()), x) for x in w]], ["n", "place", "rank", "w1", "w2"])
    return find


def margins(length: int):
    """Rows ``n, place, rank, c1, c2, left, right``: the digest of the inner bytes and the outer ones to both sides."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, text, place, rank, (s, e), (i, j), a in _listed(batches, length):
            at = list(zip(s.tolist(), i.tolist(), j.tolist(), e.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), n)), pa.array(place), pa.array(rank),
                 *_halves([xxhash.xxh3_128_digest(text[x:y]) for _, x, y, _ in at]),
                 pa.array([text[x:y] for x, y, _, _ in at], pa.binary()),
                 pa.array([text[x:y] for _, _, x, y in at], pa.binary())],
                ["n", "place", "rank", "c1", "c2", "left", "right"])
    return cut


def digest(*parts: Column) -> list[Column]:
    """128 bits as two numbers."""
    return [F.xxhash64(F.lit(k), *parts) for k in (1, 2)]


def reranked(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys that occur more than once, at a row that is still open, with their rank in sorted order."""
    many = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("many"), F.max("open").alias("open")).where("many > 1 AND open")
    return materialise(many.select(*keys).orderBy(*keys).withColumn("next", F.monotonically_increasing_id()), name)


def settle(rows: DataFrame, more: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """Spans (``n, s, e``) whose outer bytes (``w1, w2``) occur elsewhere, and the rows that go on, with the columns ``more``:
    one for all equal ones.  It is not ``open`` any more, but others are compared with it."""
    me = F.struct("n", "place")
    shared = rows.where("w1 IS NOT NULL").groupBy("w1", "w2").agg(F.min(me).alias("speaker"), F.max(me).alias("other")) \
        .where("speaker <> other").select("w1", "w2", F.col("speaker.n").alias("n0"), F.col("speaker.place").alias("place0"))
    both = rows.join(shared, ["w1", "w2"], "left").withColumn("open", F.col("n0").isNull())
    on = F.col("open") | ((F.col("n0") == F.col("n")) & (F.col("place0") == F.col("place")))
    if not more:                                    # the last round
        both, on = both.where("NOT open"), F.lit(False)
    judged = materialise(both.withColumn("on", on).select(
        "n", "place", "open", "on", *[F.when(F.col("on"), F.col(c)).alias(c) for c in more]), "judged")
    p, a, b = _unpacked()
    return judged.where("NOT open").select("n", (p - b).alias("s"), (p - a + length).alias("e")), judged.where("on")


def narrower(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Every row's narrower blocks; ``grown`` names the bytes by which their inner bytes are longer."""
    p, a, b = _unpacked()
    rows = rows.select("*", p.alias("p"), a.cast("int").alias("a"), b.cast("int").alias("b"),
                       F.octet_length("left").alias("l"), F.octet_length("right").alias("r"))
    child = rows.withColumn("c", F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(width)))) \
        .withColumn("d", F.least(F.col("c") + width - 1, F.col("b")))
    a, b, c, d, l, r = map(F.col, "abcdlr")
    child = child.where((c - a <= l) & (b - d <= r))                # else no string of the block lies in the text
    # of the margins, what the block's inner bytes grow by and what its outer bytes still have
    before, after = F.substring("left", l - (c - a) + 1, c - a), F.substring("right", F.lit(1), b - d)
    more_l, more_r = F.least(d - c, l - (c - a)), F.least(d - c, r - (b - d))
    left, right = F.substring("left", l - (c - a) - more_l + 1, more_l), F.substring("right", b - d + 1, more_r)
    core = digest(F.col("c1"), F.col("c2"), before, after, c - a)
    child = child.select(
        "n", (F.col("p") * _A + c * _B + d).alias("place"), "rank", "open", F.xxhash64(c - a, before, after).alias("grown"),
        core[0].alias("c1"), core[1].alias("c2"), left.alias("left"), right.alias("right"),
        ((more_l == d - c) & (more_r == d - c)).alias("full"))
    whole = digest(F.col("c1"), F.col("c2"), F.col("left"), F.col("right"), F.col("place").bitwiseAND(_A - 1))
    return child.withColumns({f"w{k + 1}": F.when(F.col("full"), w) for k, w in enumerate(whole)}).drop("full")


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Spans ``n, s, e`` of the texts (``t, text``, each text once) whose strings of ``length`` bytes also start elsewhere
    among them, and the texts that hold some such spans as ``n, t, text``.

    Spans overlap and repeat; together they cover just those bytes.
    """
    lists = lambda rows, key: rows.groupBy(key).agg(F.collect_list(F.struct("place", "rank")).alias("found"))
    texts = texts.where(F.octet_length("text") >= length).select(F.xxhash64("t").alias("k"), "text", "t")
    first = materialise(texts.select("k", "text").mapInArrow(places(length), "k long, place long, inner long"), "places")
    ranks = reranked(first.select("inner", F.lit(True).alias("open")), ["inner"], "ranks")
    kept = materialise(lists(first.join(ranks, "inner").withColumnRenamed("next", "rank"), "k"), "places-kept")
    held = materialise(texts.join(small(kept.select("k")), "k", "left_semi").join(kept, "k").select(
        F.monotonically_increasing_id().alias("n"), "text", "found", "t"), "texts-held")
    spans, rows = settle(held.select("n", "text", "found").mapInArrow(
        outer_digests(length), "n long, place long, rank long, w1 long, w2 long"), ["rank"], length)
    going = rows.groupBy("n").agg(F.collect_list(F.struct("place", "rank")).alias("found"))
    cut = materialise(held.select("n", "text").join(going, "n").mapInArrow(
        margins(length), "n long, place long, rank long, c1 long, c2 long, left binary, right binary"), "margins")
    rows = cut.join(rows.select("n", "place", "open"), ["n", "place"])
    steps = widths(length)[1:]
    for width in steps:
        rows = narrower(rows, width, length)
        if width > 1:
            ranks = reranked(rows, ["rank", "grown"], "ranks")
            rows = rows.join(ranks, ["rank", "grown"]).withColumn("rank", F.col("next"))
        hits, rows = settle(rows, ["rank", "c1", "c2", "left", "right"] if width > 1 else [], length)
        spans = spans.unionAll(hits)
    return spans, held.select("n", "t", "text")


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``t, n_removed, n_spans, kept`` for ``t, text`` and lists of starts and ends."""
    for whole in batches:
        for batch in slices(whole, 1, rows=128):
            out = []
            for t, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, found.values.field("s").to_numpy(), 1)
                np.add.at(depth, found.values.field("e").to_numpy(), -1)
                gone = np.cumsum(depth[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((t, int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
                ["t", "n_removed", "n_spans", "kept"])


def remove_matches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left, where something was removed) with ``kept_sha256``.

    A byte goes if it lies in a string of ``length`` bytes of its text that also starts at any other place of any text; strings are those of
    the input and never cross texts.  Null texts are empty; an empty text loses nothing.  Rows of equal texts lose
    all (if they have ``length`` bytes), repeated rows and rows without id too; equal rows get equal results.
    """
    if not 3 * GRAM <= length < _B:
        raise ValueError(f"strings must have {3 * GRAM} to {_B - 1} bytes")
    data = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), data.alias("text")) \
        .select("doc_id", "text", F.sha2("text", 256).alias("sha")) \
        .withColumn("t", F.unhex(F.substring("sha", 1, 32)))
    long = F.octet_length("text") >= length
    copies = materialise(rows.where(long).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
                         .where("n > 1"), "copies")
    # of equal texts the row of the smallest id speaks for all (rows that share it repeat places of a text that goes as a whole)
    one = rows.where(long).join(small(copies), "t", "left").where("n IS NULL OR doc_id <=> first_id").select("t", "text")
    spans, held = repeated_spans(one, length)
    lists = spans.groupBy("n").agg(F.collect_set(F.struct("s", "e")).alias("found"))
    cut = materialise(held.join(lists, "n").select("t", "text", "found").mapInArrow(
        cut_spans, "t binary, n_removed long, n_spans long, kept binary").dropDuplicates(["t"]), "cut")
    out = rows.select("doc_id", "t", F.octet_length("text").cast("long").alias("n_bytes"), "sha") \
        .join(small(copies.select("t", "n")), "t", "left").join(cut, "t", "left")
    copy, some = F.col("n").isNotNull(), F.col("n_removed") > 0
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(b"")).when(some, F.col("kept")).alias("kept"),
        F.when(copy, F.sha2(F.lit(b""), 256)).when(some, F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"))
