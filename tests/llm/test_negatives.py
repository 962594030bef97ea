"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import negatives

RNG = np.random.default_rng(3)
SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, score string"


def quantised(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def plain(rows, every=50):
    v = {(i, c, tuple(quantised(e))) for i, e, c, *_ in rows
         if i is not None and c is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, c, q in v:
        if i % every:
            continue
        near = sorted((-dot(q, o[2]), o[0]) for o in v if o[1] == c and o[0] != i)[:5]
        far = sorted((-dot(q, o[2]), o[0]) for o in v if o[1] != c and o[0] != i)
        for s, j in near:
            fit = [(t, k) for t, k in far if -50 * s <= -100 * t <= -95 * s][:3]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(fit, 1)]
    return sorted(out)


def some_rows(n=400, d=8):
    centre = RNG.normal(size=(4, d))
    rows = [(i, (centre[i % 4] * 0.3 + RNG.normal(size=d) * 0.2).tolist(), int(i % 3), "x", None) for i in range(n)]
    rows += [(1000 + k, rows[k][1], (k + 1) % 3, None, "y") for k in range(30)]                 # ties across labels
    rows += rows[50:60]                                                                        # repeated rows
    rows += [(2000, None, 1, None, None), (2050, [], 1, None, None), (2100, [1.0, None] * 4, 1, None, None),
             (2150, [float("nan")] * d, 1, None, None), (2151, [float("inf")] + [0.0] * (d - 1), 0, None, None),
             (None, [0.5] * d, 1, None, None), (2200, [0.5] * d, None, None, None), (2250, [0.1] * 3, 2, None, None),
             (2300, [0.0] * d, 0, None, None)]
    return rows


@pytest.mark.parametrize("size", [4096, 3])
def test_mine_against_brute_force(spark, size):
    rows = some_rows()
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), lambda v: v % 50 == 0, anchors=size)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_empty_and_lone_rows(spark):
    every = lambda v: v % 50 == 0
    assert negatives.mine(spark.createDataFrame([], SCHEMA), every).count() == 0
    assert negatives.mine(spark.createDataFrame([(50, [1.0], 1, None, None)], SCHEMA), every).count() == 0


def test_spanning_tree_is_minimal():
    v = RNG.integers(-50, 50, (40, 3))
    order, parent, edge = negatives.spanning_tree(v)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and all(p < k for k, p in enumerate(parent))
    for k in range(1, 40):
        assert edge[k] == pytest.approx(np.linalg.norm(v[order[k]] - v[order[parent[k]]]))
    far = np.linalg.norm(v[:, None] - v[None], axis=2)          # Kruskal
    group, total = list(range(40)), 0.0
    for d, a, b in sorted((far[a, b], a, b) for a in range(40) for b in range(a)):
        if group[a] != group[b]:
            total += d
            group = [group[a] if g == group[b] else g for g in group]
    assert sum(edge) == pytest.approx(total)


def test_bounds_spare_scores_on_close_anchors():
    base = RNG.integers(-60, 60, 16)
    block = [(k, k, 0, (base + RNG.integers(-1, 2, 16)).tolist()) for k in range(64)]
    tree = negatives.trees(block)[0]
    rows = RNG.integers(-60, 60, (500, 16))
    norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    seen = {}
    done = negatives.down_the_tree(tree, rows, norms, lambda k, lo, hi: hi >= 20_000,
                                   lambda k, which, scores: seen.update({k: dict(zip(which.tolist(), scores.tolist()))}))
    for k, v in enumerate(tree.vectors):
        exact = rows @ v
        assert all(exact[i] == s for i, s in seen[k].items())
        assert set(np.flatnonzero(exact >= 20_000)) <= set(seen[k])
    assert done < 64 * 500 / 4


def test_exact_beyond_floating_point():
    a, b = np.array([[2 ** 30, 3]]), np.array([2 ** 30 - 1, 1])
    assert negatives.exact_scores(a, np.array([float(2 ** 30)]), b, float(2 ** 30))[0] == 2 ** 30 * (2 ** 30 - 1) + 3


def test_query_shifts_labels(spark, tmp_path):
    from strandline.llm import catalog
    rows = [r[:3] for r in some_rows()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, e, None if c is None else (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, e, c in rows]
    got = catalog.QUERIES["op11_hard_negatives"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == plain(moved)
    assert got.where(F.col("rank") > 3).count() == 0
