"""Hard negatives against all products on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import hard_negatives as H

KINDS = "vec_id long, embedding array<float>, label int, row int, part string, block int"


def by_all_products(rows):
    """The contract on lists; the position of a row tells repeated rows apart."""
    used = []
    for at, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((at, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = []
    for at, i, v, label in used:
        if i is None or i % 50:
            continue
        scored = sorted(((-score(v, w), last(j), j, k == label) for b, j, w, k in used if b != at), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in scored if x[3]][:5]:
            hits = [(j, -t) for t, _, j, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, p, n + 1, j, -s, t) for n, (j, t) in enumerate(hits)]
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], KINDS).repartition(3)
    return sorted(map(tuple, H.hard_negatives(docs, F.col("vec_id") % 50 == 0).collect()), key=repr)


def clustered(n, width, centres, seed, spread=0.05):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(0, 0.3, (centres, width))
    return [(k, [float(x) for x in middle[k % centres] + rnd.normal(0, spread, width)], int(rnd.integers(0, 4))) for k in range(n)]


def test_odd_rows(spark):
    one = [0.5, 0.25, -0.125, 0.3]
    rows = [(0, one, 1), (0, one, 1), (50, one, 2), (1, one, 1), (2, [x * 0.7 for x in one], 2), (3, [x * 0.7 for x in one], 3), (4, [0.4], 2), (5, [], 2), (None, [x * 0.6 for x in one], 2), (100, None, 1)]
    rows += [(6, one, None), (7, [0.5, None, 0.1, 0.1], 2), (8, [0.5, float("nan"), 0.1, 0.1], 2), (9, [float("inf"), 0.0, 0.0, 0.0], 2), (150, [0.0] * 4, 1), (10, [-x for x in one], 1), (None, one, 1)]
    assert run(spark, rows) == by_all_products(rows) != []
    assert run(spark, []) == [] == run(spark, [(0, None, 1)]) == run(spark, [(0, [0.5], 1)])
    with pytest.raises(ValueError):
        run(spark, [(0, [1e9, 1.0], 1)])


def test_small_parts_and_blocks(spark, monkeypatch):
    """Large cells split over parts, several blocks of anchors, small steps."""
    for name, value in {"PART_ROWS": 20, "BLOCK": 4, "BATCH": 3, "STEP": 8, "CENTROIDS": 4}.items():
        monkeypatch.setattr(H, name, value)
    rows = clustered(900, 8, 3, 1) + [(k * 50, [0.1] * 8, k % 3) for k in range(60, 75)]
    assert run(spark, rows) == by_all_products(rows)


def test_cells_come_in_the_order_of_their_bounds():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = np.array([rnd.uniform(-1, 1) for _ in range(rnd.randint(1, 6))]), np.array([rnd.uniform(-1, 1) for _ in range(rnd.randint(1, 6))])
        cells = list(itertools.product(range(len(a)), range(len(b))))
        present = {c for c in cells if rnd.random() < 0.6}
        got = list(H.cells_in_order(a, b, present))
        assert {c[1:] for c in got} == present and [c[0] for c in got] == sorted((a[i] + b[j] for i, j in present), reverse=True)


def test_bounds_hold_and_leave_cells_out(spark):
    """Bounds are never below a score; on clustered vectors most cells aren't visited."""
    rows = clustered(4000, 16, 40, 5, spread=0.01)
    vectors = np.floor(256 * np.array([np.float32(r[1]) for r in rows], float))
    books = H.fit(vectors[:1000], 30)
    near = books.nearest(vectors)
    books.radii = tuple(np.array([r[n == c].max(initial=0) for c in range(len(book))]) for (n, r), book in zip(near, books.centroids))
    a, b = books.bounds(vectors[:100])
    assert (a[:, near[0][0]] + b[:, near[1][0]] >= vectors[:100] @ vectors.T).all()
    layout = H.Layout.of([(*map(int, c), 1) for c in np.unique(np.stack([near[0][0], near[1][0]], 1), axis=0)], 1)
    bound = a[:, layout.cells[:, 0]] + b[:, layout.cells[:, 1]]
    best = np.sort(vectors[:100] @ vectors.T, 1)[:, -6]
    assert (bound >= best[:, None]).mean() < 0.5
