import numpy as np
import pytest
from pyspark.sql import functions as F

from clickwarden.llm.ann import Settings, _slot, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, most=20):
    good = {}
    for vec_id, v, *_ in rows:
        if v and vec_id is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16:
            good[vec_id] = np.array(v, np.float32).astype(np.float64)
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for i, vec_id in enumerate(ids):
        if vec_id % 20 == 0:
            score = x @ x[i]
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != i][:most]
            out[int(vec_id)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found.get(q, set()) & {v for v, _ in own}) / len(own) for q, own in want.items() if own])


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_odd_vectors(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms:
        x *= rng.uniform(0.3, 2, (3000, 1))
    x[200:700] = x[200]  # a vector that many rows have
    rows = [(i, [float(np.float32(c)) for c in v], 1, 0.5) for i, v in enumerate(x)]
    rows += [(5000, None, 1, 0.5), (5020, [0.0] * 16, 1, 0.5), (5040, [float("nan")] + [1.0] * 15, 1, 0.5), (5060, [float("inf")] * 16, 1, 0.5),
             (5080, [None] + [1.0] * 15, 1, 0.5), (5100, [1.0, 2.0], 1, 0.5), (None, rows[3][1], 1, 0.5), rows[40], (5120, [], 1, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    want = brute(rows)
    assert {r.query_id for r in got} == set(want)
    assert recall(got, want) >= 0.9
    vectors = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows[:3000]}
    own = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12 and r.vec_id != r.query_id
        own.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for listed in own.values():
        assert len(listed) == 20 and listed == sorted(listed)
    # a query that is one of the copies gets the copies of smallest id
    assert [v for _, v in own[300]] == [i for i in range(200, 700)][:20]


@pytest.mark.parametrize("doors", [4096, 128])
def test_vectors_of_very_large_and_very_small_norm(spark, doors):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7:12] *= 100
    x[1000:2000] *= 3
    x[2500:2600] *= 1e-3
    rows = [(i, [float(np.float32(c)) for c in v], 1, 0.5) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert recall(nearest_neighbours(df, F.col("vec_id") % 20 == 0, settings=Settings(doors=doors)).collect(), brute(rows)) >= 0.9


def test_more_neighbours_than_the_usual_beam(spark):
    x = np.random.default_rng(5).normal(size=(1500, 16))
    rows = [(i, [float(np.float32(c)) for c in v], 1, 0.5) for i, v in enumerate(x)]
    got = nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, most=100).collect()
    want = brute(rows, 100)
    assert len(got) == 100 * len(want) and recall(got, want) >= 0.9


def test_few_rows_and_none(spark):
    rows = [(i * 20, [float(i + 1), 1.0], 1, 0.5) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in (0, 20, 40, 60) for k in (1, 2, 3)]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == [60, 40, 20]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_neighbours(df.limit(1), F.lit(True)).count() == 0


def test_marks_of_a_list_change_with_the_round():
    ids = np.arange(2000)
    same = [_slot(ids, turn) == _slot(ids[:1], turn) for turn in range(2)]
    # ids that share the bit of id 0 in one round mostly don't in the next
    assert (same[0] & same[1]).sum() < 4 < same[0].sum() + 4
