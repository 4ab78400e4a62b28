"""Hard negatives against a loop over all pairs; the tree's bounds; odd rows."""

import math

import numpy as np

from clickwarden.llm.gnat import Tree, distances, lift
from clickwarden.llm.hard_negatives import Settings, mine_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, label_ string, slot int"
SMALL = Settings(leaf_rows=32, inner_leaf=8, block_bytes=1 << 13, group=3, arity=4)


def expected(rows, anchor_every, s=Settings()):
    kept = {}
    for vec_id, label, x in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        row = (label, [math.floor(s.scale * v) for v in x])
        kept[vec_id] = min(kept.get(vec_id, row), row)
    out = []
    for a, (label, x) in kept.items():
        if a % anchor_every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, (other, y) in kept.items() if b != a)
        for p, positive, _ in [t for t in scores if t[2] == label][: s.positives]:
            fits = [(n, b) for n, b, other in scores
                    if other != label and s.low_percent * -p <= 100 * -n <= s.high_percent * -p][: s.negatives]
            out += [(a, positive, rank, b, -p, -n) for rank, (n, b) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, anchor_every, settings=SMALL):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mine_hard_negatives(df, anchor_every, settings=settings).collect())


def test_bounds_hold_every_distance():
    rng = np.random.default_rng(1)
    points = lift(rng.integers(-100, 100, (500, 5)).astype(float), 60_000.0)
    tree = Tree.grow(points[::3], 4, 20)
    leaf = tree.route(points)
    tree.widen(tree.ranges, points, leaf)
    queries = np.column_stack([rng.integers(-100, 100, (20, 5)), np.zeros(20)])
    low, high = tree.bounds(queries, 1e-6)
    d = distances(queries, points)
    assert tree.leaves > 10 and (low[:, leaf] <= d).all() and (high[:, leaf] >= d).all()
    # some leaves are told apart
    assert (low > d.min(axis=1)[:, None] + 1).any()


def test_all_pairs_with_ties_and_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(i % 4), (centres[i % 6] + rng.normal(size=8) * 0.3).tolist()) for i in range(600)]
    # few distinct values: many equal scores
    rows += [(i, int(i % 3), rng.integers(-1, 2, 8).astype(float).tolist()) for i in range(600, 900)]
    # a third of the rows is one vector, anchors among them
    rows += [(i, int(i % 2), [0.5] * 8) for i in range(900, 1350)]
    want = expected(rows, 50)
    assert len(want) > 500 and mined(spark, rows, 50) == want
    assert mined(spark, rows, 50, Settings()) == want


def test_long_vectors_score_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (rng.normal(size=6) * (1e5 if i % 5 else 1)).tolist()) for i in range(200)]
    assert mined(spark, rows, 20) == expected(rows, 20)


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.6, 0.4]), (3, 2, [0.5]), (4, 1, []),
            (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [None, 1.0]), (8, 2, [float("nan"), 1.0]), (9, 2, [float("inf"), 0.0]),
            (None, 2, [0.5, 0.5]), (10, 3, [-1.0, -1.0]), (2, 5, [9.0, 9.0]), (11, 4, [0.6, 0.4]), (100, 7, [1.0, 1.0]),
            (-100, 3, [-1.0, 0.0])]
    assert mined(spark, rows, 100) == expected(rows, 100) != []
    # a norm without 64-bit scores takes no part
    assert mined(spark, [*rows, (12, 2, [1e30, 0.0])], 100) == expected(rows, 100)
    assert mined(spark, [], 100) == [] and mined(spark, [(0, 1, [1.0])], 100) == []
