"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import runs
from strandline.llm.common import words

RNG = np.random.default_rng(8)
SCHEMA = "doc_id long, text string, n_words string, runs int, row string"


def plain_runs(w, least=12):
    """Every maximal periodic stretch, one period after the other."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1) if j == i else j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words():
    kind = RNG.integers(0, 6)
    n = int(RNG.integers(0, 120))
    w = RNG.integers(0, (2, 3, 6, 40, 1, 2)[kind], n).tolist()
    if kind >= 3:
        for _ in range(RNG.integers(1, 4)):         # a planted repeat
            p, k = int(RNG.integers(1, 12)), int(RNG.integers(2, 7))
            at = int(RNG.integers(0, len(w) + 1))
            w[at:at] = RNG.integers(0, 5, p).tolist() * k + w[:2]
    if kind == 5:                                   # Fibonacci words have many runs of many periods
        a, b = [0], [0, 1]
        while len(b) < 200:
            a, b = b, b + a
        w = b[:int(RNG.integers(50, 200))]
    return [f"w{x}" for x in w]


def test_runs_of_many_texts_at_once():
    for _ in range(60):
        texts = [some_words() for _ in range(RNG.integers(1, 12))]
        got = list(runs._runs_of([[x.encode() for x in w] for w in texts], 12))
        for w, (found, kept) in zip(texts, got):
            expected = plain_runs(w)
            assert list(map(tuple, found.tolist())) == expected
            assert b" ".join(kept).decode() == plain_collapsed(w, expected)


def test_extension_climbs_every_round():
    text = RNG.integers(0, 3, 400).tolist() * 3 + [0] * 500 + [1] + [0] * 300
    symbols = np.array([10, *text, 11])
    rounds = runs.recompress(symbols, 4)
    assert len(rounds) > 8
    a, b = np.sort(RNG.integers(1, len(symbols) - 1, (2, 3000)), axis=0)
    a, b = a[a < b], b[a < b]
    right, left = runs.extension(rounds, a, b, 1), runs.extension(rounds, a, b, -1)
    for i, j, r, le in zip(a.tolist(), b.tolist(), right.tolist(), left.tolist()):
        assert (symbols[i:i + r] == symbols[j:j + r]).all() and symbols[i + r] != symbols[j + r]
        assert (symbols[i - le + 1:i + 1] == symbols[j - le + 1:j + 1]).all() and symbols[i - le] != symbols[j - le]


def test_long_runs_stay_cheap():
    texts = [[b"x"] * 60_000, [b"a", b"b", b"c"] * 20_000, [str(i).encode() for i in range(5000)] * 4]
    got = [list(map(tuple, found.tolist())) for found, _ in runs._runs_of(texts, 12)]
    assert got == [[(0, 60_000, 1)], [(0, 60_000, 3)], [(0, 20_000, 5000)]]


TEXTS = [None, "", " \t\n", "one", "x " * 11, "x\t" * 12, "a b " * 40 + "c " + "a b " * 30, "é ü " * 9 + "\x0b end",
         " ".join(map(str, range(40))) * 3, " ".join(f"w{i}" for i in range(50)), "no blank " * 13]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "extra", None, "r") for k, t in enumerate(TEXTS)] + [(None, "a b c " * 9, None, 1, "r")] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_find_runs_on_awkward_rows(spark, docs):
    got = runs.find_runs(docs).select("row.*", F.col("n_words").alias("n"), F.col("runs").alias("found"), "collapsed").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        w = [x.decode() for x in (r["text"] or "").encode().split()]
        expected = plain_runs(w)
        assert (r["n"], [tuple(x) for x in r["found"]]) == (len(w), expected)
        assert r["collapsed"] == plain_collapsed(w, expected)
    empty = spark.createDataFrame([], SCHEMA)
    assert runs.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs, least=5)


def test_longest_and_text(docs):
    found = runs.find_runs(docs).select("row.doc_id", runs.longest_run(F.col("runs")).alias("top"),
                                        runs.runs_text(F.col("runs")).alias("t")).where("doc_id in (6, 9)").orderBy("doc_id")
    first, none = found.collect()
    assert tuple(first["top"]) == (0, 80, 2) and first["t"] == "0,80,2\n81,60,2\n"
    assert none["top"] is None and none["t"] == ""


def test_planted_words(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b c")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", words(F.col("text")).alias("w"), runs.plant_runs(F.col("doc_id"), words(F.col("text"))).alias("p")).collect()
    changed = 0
    for r in got:
        w, n = r["w"], len(r["w"])
        if r["doc_id"] is not None:
            h = zlib.crc32(str(r["doc_id"]).encode())
            g = h // 10
            if h % 10 == 0 and n:
                a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
                changed += w != r["w"]
        assert r["p"] == w
    assert changed > 10


def test_query_has_the_digests_of_brute_force(spark, tmp_path):
    from strandline.llm import catalog
    rows = [(i, " ".join(some_words())) for i in range(400)] + [(7, None), (None, "b " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for i, t in rows:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = plain_runs(w)
        s, m, p = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        expected.append((i, len(found), s, m, p, m and 1000 * m // p, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
                         sha(plain_collapsed(w, found))))
    got = catalog.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
