"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, v int, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)


def plain(rows, asks, positives=5, negatives=10, low=30, high=90):
    bad = lambda x: x is None or math.isnan(x) or math.isinf(x)
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and not any(map(bad, v))]
    out = []
    for k, (i, v, y) in enumerate(kept):
        if not asks(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z == y) for n, (j, w, z) in enumerate(kept) if n != k and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2])[:positives]:
            found = sorted(s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p)[:negatives]
            out += [(i, j, n, m, -p, -s) for n, (s, m, _) in enumerate(found, 1)]
    return sorted(out)


def vectors(rng, n, d=6, grid=4):
    """Few values a component, so that scores tie; copies, ids given twice, hot label 1."""
    rows = [(i, [rng.randint(-1, grid) / 8 for _ in range(d)], rng.choice([0, 1, 1, 1, 2])) for i in range(n)]
    rows += [(rng.randrange(n), rows[k][1], rng.choice([0, 1])) for k in rng.sample(range(n), 30)]
    rows += [(7000 + i, [0.5] * d, i % 2) for i in range(60)]
    return rows + [(9001, [0.0] * d, 1), (9000, [0.0] * d, 0), (None, [1.0] * d, 1), (9003, None, 1), (9004, [1.0] * d, None), (9005, [math.nan] + [1.0] * (d - 1), 1), (9006, [math.inf] * d, 1), (9007, [None] * d, 1), (9010, [], 1), (9020, [1.0, 2.0], 1), (9021, [1.0, 3.0], 1), (9022, [0.5, 1.0], 0)]


@pytest.mark.parametrize("block,batch,leaf", [(8192, 4096, 64), (16, 3, 4), (50, 7, 1)])
def test_all_pairs_agree(spark, block, batch, leaf):
    rows = vectors(random.Random(block), 300)
    got = H.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, block=block, batch=batch, leaf=leaf).collect()
    assert sorted(map(tuple, got)) == plain(rows, lambda i: i % 10 == 0)


def test_few_rows_and_extremes(spark):
    assert H.mine(frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    rows = vectors(random.Random(1), 40)
    assert H.mine(frame(spark, rows), F.lit(False)).collect() == []
    tiny = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 3.0], 0)]
    assert sorted(map(tuple, H.mine(frame(spark, tiny), F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2, 65536, 32768)]
    # beyond 2**53 products are taken in whole numbers
    big = [(0, [3e5, 1e5 + 1 / 256], 1), (1, [3e5, 1e5], 1), (2, [2e5, 1e5], 0), (3, [2e5, 1e5 + 1 / 256], 0), (4, [1e300, 1e300], 0)]
    assert sorted(map(tuple, H.mine(frame(spark, big), F.col("vec_id") == 0).collect())) == plain(big, lambda i: i == 0)


def test_trees_leave_balls_out():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 300
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 10)
    tree, ids, q = H.Tree(x), np.arange(4000), x[:50]
    scores = H.products(q, x)
    for low, high in ((-(1 << 50), 1 << 50), (100_000, 300_000)):
        best = H.Best(50, 5, ids)
        taken = tree.search(best, q, np.arange(50), np.full(50, low), np.full(50, high), np.full(50, -1))
        assert taken < 0.5 * scores.size  # of all products
        for i in range(50):
            want = sorted(((-s, j) for j, s in enumerate(scores[i].tolist()) if low <= s <= high))[:5]
            assert [(-s, r) for s, r in zip(best.score[i].tolist(), best.row[i].tolist()) if s > H.NONE] == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, q = np.floor(rng.normal(size=(30, 5)) * 10 ** rng.integers(0, 7)), np.floor(rng.normal(size=(4, 5)) * 1000)
        centre, radius = H.ball(x)
        lower, upper = H.bounds(q, centre[None], np.array([radius]))
        s = q @ x.T
        assert (lower <= s.min(1, keepdims=True)).all() and (upper >= s.max(1, keepdims=True)).all()
