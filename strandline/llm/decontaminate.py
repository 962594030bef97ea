"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items become one suffix automaton.  A document's
words are streamed through it: the automaton's state is the longest stretch of
words that ends here and occurs in an item, cut back to ``WINDOW`` words.  Whenever
the stretch is that long, or a whole shorter item ends here, its words are hit.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, so an automaton (and its
broadcast) has a fixed bound; every document meets every block in turn, inside one stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: A document is contaminated if at least this share of its words is hit: 1 / 20.
COVERAGE = 20
BLOCK_WORDS = 500_000
# Words are runs of digits, lower-case letters and everything beyond ASCII.
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127
                else 32 for c in range(256))
#: Texts are streamed in pieces of about this many bytes.
PIECE = 1 << 20


def normal_words(data: bytes) -> list[bytes]:
    return data.translate(_NORMAL).split()


def stream(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a long text, a piece at a time."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and _NORMAL[data[end]] != 32:     # finish the word
            end += 1
        yield normal_words(data[at:end])
        at = end


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items behind each full window.

    ``next``, ``link``, ``length`` are its states; ``whole[state]`` lists (item, words) of short items that are
    suffixes of the state's longest stretch, ``behind[state]`` the items that hold its window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, ws in items:
            codes = [self.ids.setdefault(w, len(self.ids)) for w in ws]
            coded.append((name, codes))
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.behind: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[str, int]]] = {}
        for name, codes in coded:
            if len(codes) >= window:
                for s, n in self.walk(codes):
                    if n == window:
                        self.behind.setdefault(s, set()).add(name)
            elif codes:
                *_, (s, _) = self.walk(codes)
                self.whole.setdefault(s, []).append((name, len(codes)))
        # a state also ends with the short items of the states that it links to
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if up := self.whole.get(self.link[s]):
                self.whole[s] = self.whole.get(s, []) + up

    def _copy(self, q: int, p: int, c: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        """State of ``last`` followed by ``c``; items share the states they have in common."""
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(q, last, c)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(q, p, c)
        return new

    def walk(self, codes, state: int = 0, n: int = 0) -> Iterator[tuple[int, int]]:
        """(state, matched words) after each code; a code of -1 is in no item."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for c in codes:
            t = nxt[state].get(c)
            while t is None and state:
                state = link[state]
                n = length[state]
                t = nxt[state].get(c)
            if t is None:
                n = 0
            else:
                state = t
                n += 1
                if n > window:
                    n = window
                while length[link[state]] >= n:         # the state that holds exactly these n words
                    state = link[state]
            yield state, n

    def scan(self, pieces: Iterator[list[bytes]]) -> tuple[int, list[list[int]], set[str]]:
        """Words of the text, hit stretches (from, to) in order, items with a window in the text."""
        ids, window, behind, whole = self.ids, self.window, self.behind, self.whole
        hits: list[list[int]] = []
        items: set[str] = set()
        at, state, n = 0, 0, 0
        for ws in pieces:
            codes = [ids.get(w, -1) for w in ws]
            for state, n in self.walk(codes, state, n):
                at += 1
                if n == window:
                    size = window
                    items |= behind[state]
                elif n and state in whole:
                    size = 0
                else:
                    continue
                for name, k in whole.get(state, ()):
                    if k <= n:
                        items.add(name)
                        size = max(size, k)
                if size:
                    while hits and hits[-1][0] >= at - size:
                        hits.pop()
                    if hits and hits[-1][1] >= at - size:
                        hits[-1][1] = at
                    else:
                        hits.append([at - size, at])
        return at, hits, items


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with words, in blocks; only one block at a time is held besides the automata."""
    block, n = [], 0
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")) \
        .where("i IS NOT NULL AND t IS NOT NULL").dropDuplicates()
    for r in rows.toLocalIterator():
        ws = normal_words(bytes(r["t"]))
        if not ws:
            continue
        if block and n + len(ws) > block_words:
            yield block
            block, n = [], 0
        block.append((r["i"], ws))
        n += len(ws)
    if block:
        yield block


FOUND = "struct<n_words:bigint,hits:array<struct<a:bigint,b:bigint>>,items:array<string>>"
_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                   ("items", pa.list_(pa.string()))])


def scan_column(docs: DataFrame, text: Column, items: DataFrame, item_id: str = "item_id", item_text: str = "text",
                window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Column:
    """What of the items each whole text holds: its words, the hit stretches and the items."""
    context = docs.sparkSession.sparkContext
    automata = [context.broadcast(ItemAutomaton(b, window)) for b in _blocks(items, item_id, item_text, block_words)]

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts:
                data = t.as_py() or b""
                n, hits, names = 0, [], set()
                if not automata:
                    n = sum(len(ws) for ws in stream(data))
                for k, a in enumerate(automata):
                    n, more, some = a.value.scan(stream(data))
                    hits, names = (_union(hits, more) if k else more), names | some
                out.append({"n_words": n, "hits": [{"a": a, "b": b} for a, b in hits], "items": sorted(names)})
            yield pa.array(out, _TYPE)
    return scan(text.cast("binary"))


def _union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted(a + b):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW,
                       coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of ``docs`` in a struct ``row``, with ``n_words, n_hit, hits, items, contaminated``.

    ``hits`` are stretches of words, ends exclusive.  Items without id, text or words are not looked for; without
    items nothing is hit.  A null text has no words and is clean.  Equal texts get equal results, and
    each row is judged by itself.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("_text"))
    found = rows.withColumn("f", scan_column(rows, F.col("_text"), items, window=window, block_words=block_words))
    hit = F.aggregate("f.hits", F.lit(0).cast("long"), lambda a, h: a + h["b"] - h["a"])
    return found.select("row", F.col("f.n_words").alias("n_words"), F.col("f.hits").alias("hits"),
                        F.col("f.items").alias("items"), hit.alias("n_hit")) \
        .withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def remove_hits(found: DataFrame, text: str = "text") -> DataFrame:
    """Rows with ``cleaned``: the text without its hit words, everything between words left in place."""
    @F.arrow_udf("string")
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(texts, hits):
            data, stretches = t.as_py(), h.as_py()
            if data is None or not stretches:
                out.append(data and data.decode())
                continue
            flat, keep, at, k, word = data.translate(_NORMAL), [], 0, 0, 0
            for s in stretches:
                while word < s["a"]:
                    k = _word_end(flat, k)
                    word += 1
                start = _word_start(flat, k)
                keep.append(data[at:start])
                while word < s["b"]:
                    k = _word_end(flat, k)
                    word += 1
                at = k
            keep.append(data[at:])
            out.append(b"".join(keep).decode())
        return pa.array(out, pa.string())
    return found.withColumn("cleaned", cut(F.col("row")[text].cast("binary"), F.col("hits")))


def _word_start(flat: bytes, at: int) -> int:
    while at < len(flat) and flat[at] == 32:
        at += 1
    return at


def _word_end(flat: bytes, at: int) -> int:
    end = flat.find(b" ", _word_start(flat, at))
    return len(flat) if end < 0 else end


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
