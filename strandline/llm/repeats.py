"""Removal of long repeats by recompression.

Each text's words are compressed in rounds: short runs of one name get a name,
then neighbouring pairs do.  A name is a hash of what it stands for, and which
neighbours pair up depends on their names alone, so everywhere in the corpus equal
stretches of words get the same interior symbols; only symbols within ``MARGIN`` words
of a stretch's ends may differ.  In a window of 50 words the symbols that lie between the
margins are therefore the same wherever the window occurs, and so is the one among
them with the smallest mixed name, the window's anchor.

An anchor's key hashes it with ``MARGIN`` words to either side.  Keys are counted over
the corpus; only texts with keys that other texts share are looked at again.  There the
stretch that the anchor's windows cover is compared as a whole, and window by window where
stretches of one key differ.  No pairs of documents are ever listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .common import mix64, slices

WINDOW = 50
#: Longest run that is named as one; the widths after the pair rounds; what the rounds may spoil at an end.
RUN, WIDTHS = 3, (6, 8)
MARGIN = RUN + RUN + 7
#: Texts are worked on in stretches of this many words, which overlap by a window.
STRETCH = 1 << 17
PIECE = 1 << 20

_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
NO_ID = (1 << 63) - 1


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = lambda b: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))))
        return up(base), up(pow(base, -1, 1 << 64))


class _Powers:
    """Tables of powers, made in the process that needs them."""
    kept: dict = {}

    @classmethod
    def of(cls, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls.kept.get(base)
        if have is None or len(have[0]) < n:
            have = cls.kept[base] = _powers(max(n, PIECE + 1), base)
        return have


def word_names(data: bytes) -> np.ndarray:
    """64-bit names of the words of a UTF-8 text, in order."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and not _BLANK[data[end]]:
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        inside = ~_BLANK[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        up, down = _Powers.of(len(b) + 1, _BASE)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * up[:len(b)], dtype=np.uint64)))
            out.append(mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class _Sums:
    """Hashes of any stretches of a sequence of names."""

    def __init__(self, names: np.ndarray):
        up, self.down = _Powers.of(len(names) + 1, _WORD_BASE)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64),
                                        np.cumsum(names * up[:len(names)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _merge(name: np.ndarray, start: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols where ``joined[i]`` says that symbol i goes into the one before it."""
    first = np.flatnonzero(~joined)
    new = name[first].copy()
    pair = np.flatnonzero(joined)
    group = np.cumsum(~joined) - 1
    with np.errstate(over="ignore"):
        # at most three parts each, added one after the other
        place = pair - first[group[pair]]
        for k in range(1, int(place.max(initial=0)) + 1):
            now = pair[place == k]
            g = group[now]
            new[g] = mix64(new[g] * np.uint64(0xFF51AFD7ED558CCD) + name[now] + np.uint64(k))
    return new, start[first]


def compress(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, end) of the symbols after the rounds.  Symbols never cross from one owner to the next."""
    n = len(names)
    start = np.arange(n)
    # runs: maximal, of at most RUN words
    same = np.zeros(n, bool)
    same[1:] = (names[1:] == names[:-1]) & (owner[1:] == owner[:-1])
    run = np.cumsum(~same) - 1
    short = np.bincount(run, minlength=run[-1] + 1 if n else 0) <= RUN if n else np.zeros(0, bool)
    name, start = _merge(names, start, same & short[run])
    for k, widest in enumerate(WIDTHS):
        end = np.append(start[1:], n)
        left = ((name >> np.uint64(11 + k)) & np.uint64(1)).astype(bool)
        own = owner[start]
        joined = np.zeros(len(name), bool)
        joined[1:] = (left[:-1] & ~left[1:] & (own[1:] == own[:-1]) & (end[1:] - start[:-1] <= widest))
        name, start = _merge(name, start, joined)
    return name, start, np.append(start[1:], n)


def window_anchors(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """First words of all windows, and (key, start) of each window's anchor."""
    n = len(names)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none.astype(np.uint64), none
    at = np.arange(n - WINDOW + 1)
    at = at[owner[at] == owner[at + WINDOW - 1]]
    if not len(at):
        return none, none.astype(np.uint64), none
    name, start, end = compress(names, owner)
    symbol = np.repeat(np.arange(len(start)), end - start)
    lo, hi = symbol[at + MARGIN], symbol[at + WINDOW - MARGIN - 1]
    lo = lo + (start[lo] < at + MARGIN)
    hi = hi - (end[hi] > at + WINDOW - MARGIN)
    # smallest mixed name between lo and hi, the first of equals: table of minima over 2**k symbols
    weight = mix64(name ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    best = np.zeros(len(at), np.int64)
    level = np.arange(len(name))
    for step in range(int(k.max()) + 1):
        if step:
            half = 1 << (step - 1)
            a, b = level[:-half], level[half:]
            level = np.where(weight[a] <= weight[b], a, b)
        use = np.flatnonzero(k == step)
        a, b = level[lo[use]], level[hi[use] - (1 << step) + 1]
        best[use] = np.where(weight[a] <= weight[b], a, b)
    sums = _Sums(names)
    key = sums.of(start[best] - MARGIN, end[best] + MARGIN)
    return at, mix64(key ^ name[best]), start[best]


def _stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names of several texts together: (names, text number, place in the text), overlapping inside long texts."""
    names, owner, place, held = [], [], [], 0
    for i, t in enumerate(texts):
        w = word_names(t)
        for a in range(0, max(1, len(w) - WINDOW + 1), STRETCH):
            part = w[a:a + STRETCH + WINDOW - 1]
            names.append(part)
            owner.append(np.full(len(part), i))
            place.append(np.arange(a, a + len(part)))
            held += len(part)
            if held >= STRETCH:
                yield np.concatenate(names), np.concatenate(owner), np.concatenate(place)
                names, owner, place, held = [], [], [], 0
    if names:
        yield np.concatenate(names), np.concatenate(owner), np.concatenate(place)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64), pa.int64())


def text_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) -> a row a text: its words' count and digest, and its distinct anchor keys."""
    for whole in batches:
        for batch in slices(whole, 2):
            texts = [t.as_py() or b"" for t in batch.column(2)]
            keys: list[list[np.ndarray]] = [[] for _ in texts]
            for names, owner, _ in _stretches(texts):
                at, key, _ = window_anchors(names, owner)
                own, change = owner[at], np.ones(len(at), bool)
                change[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
                key, own = key[change], own[change]
                for i in np.unique(own).tolist():
                    keys[i].append(key[own == i])
            ws = [t.split() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in ws], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in ws]),
                 pa.array([np.unique(np.concatenate(k)).view(np.int64).tolist() if k else [] for k in keys],
                          pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_words", "words_sha256", "keys"])


def shared_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text, shared keys) -> a row for each stretch of windows with one shared anchor.

    ``stretch`` hashes all words the windows cover and where the anchor lies; ``windows`` has a hash for each.
    """
    for whole in batches:
        for batch in slices(whole, 2):
            texts = [t.as_py() or b"" for t in batch.column(2)]
            shared = [set(np.array(k.as_py() or [], np.int64).view(np.uint64).tolist()) for k in batch.column(3)]
            for names, owner, place in _stretches(texts):
                at, key, anchor = window_anchors(names, owner)
                if not len(at):
                    continue
                own = owner[at]
                change = np.ones(len(at), bool)
                change[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(change)
                last = np.append(first[1:], len(at)) - 1
                keep = np.array([k in shared[i] for k, i in zip(key[first].tolist(), own[first].tolist())], bool)
                first, last = first[keep], last[keep]
                if not len(first):
                    continue
                sums = _Sums(names)
                digest = sums.of(at[first], at[last] + WINDOW)
                digest = mix64(digest ^ (anchor[first] - at[first]).astype(np.uint64))
                each = sums.of(at, at + WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own[first])), batch.column(1).take(pa.array(own[first])),
                     _signed(key[first]), _signed(digest), pa.array(place[at[first]], pa.int64()),
                     pa.array([each[a:b + 1].view(np.int64).tolist() for a, b in zip(first, last)],
                              pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "key", "stretch", "at", "windows"])


def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text, first words of windows to remove) -> (text_key, n_removed, kept)."""
    for whole in batches:
        for batch in slices(whole, 1):
            removed, kept = [], []
            for t, at in zip(batch.column(1), batch.column(2)):
                ws = (t.as_py() or b"").split()
                gone = np.zeros(len(ws) + 1, np.int64)
                a = np.unique(np.array(at.as_py() or [], np.int64))
                gone[a] += 1
                np.add.at(gone, a + WINDOW, -1)
                out = np.cumsum(gone)[:len(ws)] > 0
                removed.append(int(out.sum()))
                kept.append(b" ".join([ws[i] for i in np.flatnonzero(~out).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], ["text_key", "n_removed", "kept"])


def _first_places(stretches: DataFrame) -> DataFrame:
    """``key, stretch, ats``: for each window of a stretch the smallest id of a text with that window."""
    by_stretch = stretches.groupBy("key", "stretch").agg(F.min("doc_id").alias("least"))
    by_key = by_stretch.groupBy("key").agg(F.min("least").alias("key_least"), F.count(F.lit(1)).alias("n"))
    ranked = materialise(by_stretch.join(by_key, "key"), "stretches-ranked")
    # whoever has the window has the key: a stretch that the key's first text has needs no closer look
    plain = ranked.where(F.col("least") == F.col("key_least")).select(
        "key", "stretch", F.col("key_least").alias("all"), F.lit(None).cast("array<bigint>").alias("each"))
    mixed = ranked.where("n > 1").select("key", "stretch", "least")
    one = (stretches.join(mixed, ["key", "stretch"]).where(F.col("doc_id") == F.col("least"))
           .dropDuplicates(["key", "stretch"]))
    windows = one.select("key", "stretch", "least", F.posexplode("windows").alias("i", "w"))
    least = windows.groupBy("key", "w").agg(F.min("least").alias("first"))
    late = ranked.where(F.col("least") > F.col("key_least")).select("key", "stretch")
    # a stretch has at most WINDOW windows
    each = (windows.join(late, ["key", "stretch"], "left_semi").join(least, ["key", "w"])
            .groupBy("key", "stretch").agg(F.array_sort(F.collect_list(F.struct("i", "first"))).alias("l"))
            .select("key", "stretch", F.lit(None).cast("bigint").alias("all"),
                    F.transform("l", lambda x: x["first"]).alias("each")))
    return plain.unionAll(each)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words left, joined by blanks) with ``kept_sha256`` of each row.

    A word goes if it lies in a window of 50 words that also starts in a document of smaller id; windows are
    those of the input.  ``kept`` is null where nothing was removed.  Null and empty texts have no words.  A
    null id is larger than all others.  Rows of one id never remove from each other; equal rows get equal results.
    """
    rows = docs.select(F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("binary").alias("text"),
                       F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32)).alias("text_key"))
    keyed = materialise(rows.select("doc_id", "text_key", "text").mapInArrow(
        text_keys, "doc_id long, text_key binary, n_words long, words_sha256 string, keys array<long>"), "text-keys")
    # of equal texts the one with the smallest id speaks for all
    texts = materialise(keyed.groupBy("text_key").agg(F.min("doc_id").alias("first_id")), "texts")
    one = keyed.where("n_words >= 50").join(texts, "text_key").where("doc_id = first_id")
    each_key = one.select("doc_id", "text_key", F.explode("keys").alias("key"))
    common = materialise(each_key.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                         .where("a < b").select("key"), "shared-keys")
    again = materialise(each_key.join(common, "key").groupBy("doc_id", "text_key")
                        .agg(F.collect_set("key").alias("shared")), "texts-again")
    seen = materialise(rows.select("doc_id", "text_key", "text").join(again, ["doc_id", "text_key"])
                       .dropDuplicates(["doc_id", "text_key"]), "texts-shared")
    stretches = materialise(seen.select("doc_id", "text_key", "text", "shared").mapInArrow(
        shared_stretches, "doc_id long, text_key binary, key long, stretch long, at long, windows array<long>"),
        "stretches")
    firsts = materialise(_first_places(stretches.select("doc_id", "key", "stretch", "windows")), "first-places")
    hit = stretches.select("doc_id", "text_key", "key", "stretch", "at", F.size("windows").alias("n")) \
        .join(firsts, ["key", "stretch"])
    gone = F.when(F.col("all").isNotNull(), F.when(F.col("all") < F.col("doc_id"),
                                                   F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))
                  .otherwise(F.array().cast("array<bigint>"))) \
        .otherwise(F.filter(F.transform("each", lambda f, i: F.when(f < F.col("doc_id"), F.col("at") + i)),
                            lambda x: x.isNotNull()))
    places = (hit.select("text_key", gone.alias("gone")).where(F.size("gone") > 0)
              .groupBy("text_key").agg(F.flatten(F.collect_list("gone")).alias("gone")))
    cut = materialise(seen.select("text_key", "text").join(places, "text_key").mapInArrow(
        cut_windows, "text_key binary, n_removed long, kept string"), "cut")
    out = keyed.drop("keys").join(texts, "text_key").join(cut, "text_key", "left")
    late = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    return out.select(
        F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(late, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(late, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(late, F.sha2(F.lit(""), 256)).when(F.col("n_removed") > 0, F.sha2("kept", 256))
        .otherwise(F.col("words_sha256")).alias("kept_sha256"))
