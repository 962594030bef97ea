"""Removal of repeated byte strings against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import suffixes

RNG = np.random.default_rng(12)
SCHEMA = "doc_id long, text string, t string, outer int"


def plain(rows, length=200):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(d[i:i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(d) else 0
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def prose(n):
    return " ".join(f"w{i}é" if i % 9 == 0 else f"w{i}" for i in RNG.integers(0, 3000, n))


def some_rows():
    base, passage = prose(300), prose(60)
    near = base.split()
    for k in (20, 21, 90, 170, 260):
        near[k] = "changed"
    rows = [None, "", "short", base, base, " ".join(near), prose(200) + passage + prose(50), passage + prose(100), prose(40) + passage,
            base[100:500], base[100:299], base[100:300], "x" * 1000, "y" * 199, "z" * 200, "q" * 201, "ab" * 400 + "c" + "ab" * 99,
            prose(2000), (line := prose(25) + "\n") * 7 + prose(30), line + prose(5), prose(50) + base[700:899] + "!" + prose(9)]
    rows += [f"{prose(3)} {passage} {prose(3)}" for _ in range(25)]                     # one passage in many contexts
    rows += [f"{base[:600 + 3 * k]}{prose(2)}" for k in range(12)]                      # matches of every length
    return [(k * 7 % 61, t, "extra", None) for k, t in enumerate(rows)] + [(None, passage, None, 1), (None, passage, None, 1), (3, prose(99), "x", 2)]


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("length", [200, 64])
def test_against_brute_force(spark, length):
    rows = some_rows()
    got = suffixes.remove_matches(spark.createDataFrame(rows, SCHEMA).repartition(4), length=length)
    found = got.select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain(rows, length)))
    kept = got.where("n_removed > 0").select(F.sha2("kept", 256) == F.col("kept_sha256")).distinct().collect()
    assert [tuple(r) for r in kept] == [(True,)]


def test_places_cover_every_string():
    texts = [prose(100).encode(), b"", b"x" * 500, prose(3).encode(), b"ab" * 150, prose(60).encode()]
    ends = np.cumsum([len(t) for t in texts])
    data = b"".join(texts)
    p, least, most = suffixes.sample_places(data, ends, 200)
    held = {q - o for q, a, b in zip(p.tolist(), least.tolist(), most.tolist()) for o in range(a, b + 1)}
    assert held == {e - len(t) + i for t, e in zip(texts, ends.tolist()) for i in range(len(t) - 199)}
    assert least.min() >= 0 and most.max() <= 192


def test_widths():
    assert suffixes.widths(200) == [97, 25, 7, 1]


def test_empty(spark):
    assert suffixes.remove_matches(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r)[:4] for r in suffixes.remove_matches(spark.createDataFrame([(1, None, None, None)], SCHEMA)).collect()] == [(1, 0, 0, 0)]
