"""Hard negatives against a search of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import negatives


def plain(rows):
    """rows: (vec_id, label, vector); anchors are ids divisible by 100."""
    fit = set()
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            fit.add((i, label, tuple(math.floor(256 * c) for c in x)))
    out = []
    for a in fit:
        if a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in fit if b != a and len(b[2]) == len(a[2]))
        for s, i, label in [r for r in scored if r[2] == a[1]][:5]:
            near = [r for r in scored if r[2] != a[1] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a[0], i, k + 1, n[1], -s, -n[0]) for k, n in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **how):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, id int, `size` string").repartition(3)
    found = negatives.mine(table, F.col("vec_id") % 100 == 0, **how)
    assert found.columns == list(negatives.RESULT)
    return sorted(map(tuple, found.collect()))


def vectors(rng, n, d, labels):
    centres = rng.normal(size=(12, d))
    near = centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, d))
    return [(i * 10, int(rng.integers(0, labels)), [round(float(c), 2) for c in x]) for i, x in enumerate(near)]


@pytest.mark.parametrize("leaf", [4, 128])
def test_negatives_of_near_vectors(spark, leaf):
    rows = vectors(np.random.default_rng(leaf), 600, 6, 3)
    want = plain(rows)
    assert len(want) > 500 and mined(spark, rows, points=150, queries=16, leaf=leaf) == want


def test_negatives_of_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 150, 4, 2)
    one = rows[7][2]
    rows += [(5000 + 50 * i, i % 3, one) for i in range(90)]  # copies under ids and labels of their own, anchors among them
    rows += [rows[0], rows[0], (None, 1, one), (100, None, one), (200, 1, None), (300, 1, [1.0, None, 1.0, 1.0]), (400, 1, [1.0, math.nan, 1.0, 1.0]), (500, 1, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(100 * i, i % 2, [0.0, 0.0, 0.0, 0.0]) for i in range(70, 80)] + [(100 * i, i % 2, [float(i), 1.0]) for i in range(80, 90)] + [(100 * i, 1, []) for i in range(90, 93)]
    rows += [(9000, 7, one), (9500, 1, [1e15, 1.0, 1.0, 1.0])]
    want = plain([r for r in rows if r[0] != 9500])
    assert mined(spark, rows, points=40, queries=8, leaf=8) == want
    assert mined(spark, rows[:0]) == []


def test_large_numbers_are_exact(spark):
    rng = random.Random(3)
    rows = [(50 * i, i % 2, [rng.randrange(-(1 << 20), 1 << 20) / 256 * 256.0 for _ in range(3)]) for i in range(60)]
    assert mined(spark, rows, leaf=4) == plain(rows)


def test_bounds_leave_out_most_of_a_tree():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.floor(centres[rng.integers(0, 40, 8000)] + 8 * rng.normal(size=(8000, 16))).astype(np.int32)
    forest = negatives.Forest(np.arange(8000), np.zeros(8000, np.int64), x, leaf=64)
    q = x[:50]
    best = negatives.Best(np.full((50, 1), negatives.NONE), np.full((50, 1), -negatives.NONE), 6)
    taken = forest.search(q, np.zeros(50, np.int64), best, own_label=True)
    scores = q.astype(np.int64) @ x.T.astype(np.int64)
    want = np.array([np.lexsort((np.arange(8000), -s))[:6] for s in scores])
    assert (best.id == want).all()
    assert taken < 0.3 * scores.size
