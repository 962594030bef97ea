"""Maximal periodic runs of words by recompression.

The words of some texts, ends marked by symbols of their own, are compressed in rounds: blocks of one symbol
become (symbol, length), then neighbouring pairs of a left and a right symbol get names.  What pairs up depends on the symbols alone, so
equal stretches have equal symbols but for a few at their ends, and the longest common extension of two places climbs
and descends the rounds with a bounded number of comparisons in each.

A run of period q and length 2q or more covers a place g and g + q for a multiple g of q.  So candidates lie on the
harmonic grid: g = 0, q, 2q, ... for every q.  Those with three equal words at one of the two sides are extended to both sides exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices

#: Least length of a run in words; a run also has two periods at least.
LEAST = 12
#: Candidates that are extended at once.
AT_ONCE = 1 << 16

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = "struct<n_words:bigint,runs:" + RUNS + ",collapsed:binary>"


class Round(NamedTuple):
    """The symbols after a round; ``first[k]`` is where symbol k starts in the round before, ``up`` the symbol above."""
    symbols: np.ndarray
    first: np.ndarray | None
    up: np.ndarray | None
    blocks: bool            # the next round joins blocks of one symbol


def _name(keys: np.ndarray, base: int) -> tuple[np.ndarray, int]:
    found, names = np.unique(keys, return_inverse=True)
    return names + base, base + len(found)


def recompress(symbols: np.ndarray, enough: int, most: int = 200) -> list[Round]:
    """Rounds of block and pair compression until ``enough`` symbols are left."""
    rounds, first, free = [], None, int(symbols.max()) + 1
    for k in range(most):
        m = len(symbols)
        if m <= enough:
            break
        blocks = k % 2 == 0
        joined = np.zeros(m, bool)                  # with the symbol before it
        if blocks:
            np.equal(symbols[1:], symbols[:-1], out=joined[1:])
        else:
            right = mix64(symbols + (k << 40)) & np.uint64(1) > 0
            joined[1:] = right[1:] & ~right[:-1]
        if not joined.any():
            continue
        starts = np.flatnonzero(~joined)
        ends = np.append(starts[1:], m)
        many = ends - starts > 1
        above = symbols[starts].copy()
        other = ends[many] - starts[many] if blocks else symbols[starts[many] + 1]
        above[many], free = _name(above[many] << 32 | other, free)
        rounds.append(Round(symbols, first, np.cumsum(~joined) - 1, blocks))
        symbols, first = above, np.append(starts, m)
    rounds.append(Round(symbols, first, None, False))
    return rounds


def _edge(first: np.ndarray, symbol: np.ndarray, way: int) -> np.ndarray:
    return first[symbol] if way > 0 else first[symbol + 1] - 1


def extension(rounds: list[Round], a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """How many words are equal from the places ``a`` and ``b`` on (way 1), or up to and with them (way -1)."""
    a, b, start, halt = a.copy(), b.copy(), a, np.zeros(len(a), np.int64)

    def steps(level: int, which: np.ndarray, above: Round | None) -> np.ndarray:
        """How far the places can move over equal symbols of a round."""
        if not rounds[level].blocks or above is None:
            return np.ones(len(which), np.int64)
        up = rounds[level].up
        far = lambda x: np.abs(_edge(above.first, up[x], -way) - x) + 1
        return np.minimum(far(a[which]), far(b[which]))

    going = np.arange(len(a))
    for level, now in enumerate(rounds):
        above = rounds[level + 1] if level + 1 < len(rounds) else None
        climbed, left = [], going
        while len(left):
            x, y = a[left], b[left]
            if above is not None:
                p, q = now.up[x], now.up[y]
                rise = (_edge(above.first, p, way) == x) & (_edge(above.first, q, way) == y) \
                    & (above.symbols[p] == above.symbols[q])
                up = left[rise]
                a[up], b[up] = p[rise], q[rise]
                climbed.append(up)
                left, x, y = left[~rise], x[~rise], y[~rise]
            same = now.symbols[x] == now.symbols[y]
            halt[left[~same]] = level
            left = left[same]
            far = steps(level, left, above) * way
            a[left] += far
            b[left] += far
        going = np.concatenate(climbed) if climbed else going[:0]
    falling = np.zeros(0, np.int64)
    for level in range(len(rounds) - 1, 0, -1):
        falling = np.concatenate([falling, np.flatnonzero(halt == level)])
        a[falling], b[falling] = (_edge(rounds[level].first, x[falling], way) for x in (a, b))
        left, below = falling, rounds[level - 1]
        while len(left):
            left = left[below.symbols[a[left]] == below.symbols[b[left]]]
            far = steps(level - 1, left, rounds[level]) * way
            a[left] += far
            b[left] += far
    return np.abs(a - start)


def periodic_runs(symbols: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """Start, end and smallest period of all maximal runs in ``symbols``, sorted by start and period.

    The first and last symbol and those between texts occur once only, so that no run holds them; ``longest`` is the
    length of the longest text.
    """
    n = len(symbols)
    rounds = recompress(symbols, max(64, int((np.bincount(symbols) == 1).sum())))
    # three words at a place, or before it; what sticks out of the ends equals nothing
    with np.errstate(over="ignore"):
        gram = mix64(symbols[:-2] + (symbols[1:-1] << 21) + (symbols[2:] << 42) + np.int64(1))
    gram = np.concatenate([np.arange(3, dtype=np.uint64), gram, np.arange(3, 5, dtype=np.uint64)])
    here, before = gram[3:3 + n], gram[:n]
    until, of = np.zeros(n, np.int64), np.full(n, 1 << 62)      # end and period of a long run over a place
    found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
    waiting: list[np.ndarray] = []

    def extend() -> None:
        every = np.concatenate(waiting)
        waiting.clear()
        for at in range(0, len(every), AT_ONCE):
            g, p = every[at:at + AT_ONCE].T
            new = (p % of[g] != 0) | (until[g] <= g + p)        # a run's multiples say nothing new
            g, p = g[new], p[new]
            start = g - extension(rounds, g - 1, g - 1 + p, -1)
            end = g + p + extension(rounds, g, g + p, 1)
            good = end - start >= np.maximum(least, 2 * p)
            runs = np.unique(np.stack([start, end, p], axis=1)[good], axis=0)
            found.append(runs)
            for s, e, q in runs[runs[:, 1] - runs[:, 0] >= 4 * runs[:, 2]].tolist():
                until[s:e], of[s:e] = e, q

    held = 0
    for p in range(1, longest // 2 + 1):
        g = here[:n - p:p] == here[p::p]
        if p <= 3:                                  # a run has three such words, and neighbours on the grid are in one run
            g[1:] &= ~g[:-1]
        else:
            g |= before[:n - p:p] == before[p::p]
        g = np.flatnonzero(g)
        if g.size and g[0] == 0:
            g = g[1:]                               # the first symbol is no word
        if len(g):
            waiting.append(np.stack([g * p, np.full(len(g), p)], axis=1))
            held += len(g)
        if held >= AT_ONCE or p & (p - 1) == 0 and held:
            extend()
            held = 0
    if held:
        extend()
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)       # of equal stretches the one of smallest period
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _runs_of(texts: list[list[bytes]], least: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs (start, length, period) of each list of words, and the words that stay."""
    sizes = np.array([len(ws) for ws in texts])
    flat = pa.array([w for ws in texts for w in ws], pa.binary())
    names = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(sizes + 1) - sizes            # of each text, behind its own mark
    n = len(names) + len(texts) + 1
    marks = np.append(first - 1, n - 1)
    symbols = np.empty(n, np.int64)
    is_word = np.ones(n, bool)
    is_word[marks] = False
    symbols[is_word] = names
    symbols[marks] = (names.max() + 1 if len(names) else 0) + np.arange(len(marks))
    runs = periodic_runs(symbols, int(sizes.max(initial=0)), least)
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, ws in enumerate(texts):
        mine = runs[cuts[k]:cuts[k + 1]] - (first[k], first[k], 0)
        if len(mine):
            depth = np.zeros(len(ws) + 1, np.int64)
            np.add.at(depth, mine[:, 0] + mine[:, 2], 1)
            np.add.at(depth, mine[:, 1], -1)
            ws = [w for w, d in zip(ws, np.cumsum(depth).tolist()) if not d]
        yield np.stack([mine[:, 0], mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1), ws


def runs_column(text: Column, least: int = LEAST) -> Column:
    """Struct of ``n_words``, ``runs`` and ``collapsed`` (binary) of each text."""
    @F.arrow_udf(_FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            parts = [pa.nulls(0, pa.struct([("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.binary())]))]
            for batch in slices(pa.RecordBatch.from_arrays([whole], ["t"]), 0):
                texts = [(t.as_py() or b"").split() for t in batch.column(0)]       # at ASCII blanks
                runs, kept = zip(*_runs_of(texts, least))
                flat = np.concatenate(runs)
                ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                parts.append(pa.StructArray.from_arrays(
                    [pa.array([len(ws) for ws in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows),
                     pa.array([b" ".join(ws) for ws in kept], pa.binary())], ["n_words", "runs", "collapsed"]))
            yield pa.concat_arrays(parts)
    return find(text.cast("binary"))


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The columns of ``docs`` in a struct ``row``, with ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are all maximal stretches with smallest period ``period``, two periods and ``least`` words long at
    least, by start and period.  ``collapsed`` has the words, joined by blanks, that no run holds after its first period.
    Words lie between ASCII blanks; null and empty texts have none, and an empty text is what is left of them.  Each row
    is judged by itself, so repeated rows get equal results and an empty table stays empty.  A text is worked on whole, in memory
    that grows with its words.
    """
    if least < 9:
        raise ValueError("the screen finds every run of nine words or more")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       runs_column(F.col(f"`{text}`"), least).alias("f"))
    return rows.select("row", "f.n_words", "f.runs", F.col("f.collapsed").cast("string").alias("collapsed"))


def longest_run(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then smallest period; null without runs."""
    later = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"),
                                                 r.alias("run")))
    return F.array_min(later)["run"]


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    line = lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]),
                              F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def plant_runs(doc_id: Column, words: Column) -> Column:
    """The words of a text, of which a tenth (by the id) repeat from some place on: known runs to find.

    A null id plants nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    part = lambda x, start, length: F.slice(x, start.cast("int"), length.cast("int"))
    again = F.flatten(F.array_repeat(part(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(part(words, F.lit(1), a), part(again, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(words)
