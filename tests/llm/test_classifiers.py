import random
import zlib

import numpy as np
import pytest

from clickwarden.llm.labelled import fit_logistic, labelled_sample
from clickwarden.llm.quality import FEATURES, fit_quality, forward, gradient, initial_parameters, passage_features, score_quality
from clickwarden.llm.toxicity import fit_toxicity, maximal_segments, score_toxicity


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition: best segment, then both sides."""
    best = None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            s = sum(scores[a: b + 1])
            if s > 0 and (best is None or s > best[0] or (s == best[0] and b - a > best[2] - best[1])):
                best = (s, a, b)
    if best is None:
        return []
    s, a, b = best
    left = brute_segments(scores[:a])
    right = [(x + b + 1, y + b + 1, v) for x, y, v in brute_segments(scores[b + 1:])]
    return [*left, (a, b, s), *right]


@pytest.mark.parametrize("seed", range(40))
def test_linear_scan_finds_the_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.uniform(-1, 1) for _ in range(rng.randint(0, 30))]
    running = np.cumsum(scores) - scores
    at = [i for i, s in enumerate(scores) if s > 0]
    got = maximal_segments(at, [scores[i] for i in at], [running[i] for i in at])
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(1)
    p, x = initial_parameters(3), rng.random((7, FEATURES))
    borders, label, weight = np.array([0, 1, 4, 7]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss(q):
        y = forward(q, x, borders)["y"]
        return -(weight * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum() / weight.sum()

    g = gradient(p, x, borders, label, weight)
    for k in p:
        for at in {0, p[k].size // 2, p[k].size - 1}:
            high, low = ({**p, k: p[k].copy()} for _ in range(2))
            high[k].ravel()[at] += 1e-6
            low[k].ravel()[at] -= 1e-6
            assert abs((loss(high) - loss(low)) / 2e-6 - g[k].ravel()[at]) < 1e-6


def test_passages_cover_every_row_and_do_not_depend_on_neighbours():
    texts = [b"", b"one two", b" \n ", b"w " * 1000, "é ü".encode(), b"x" * 5000, b""]
    borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    of_row, x = passage_features(np.frombuffer(b"".join(texts), np.uint8), borders)
    assert np.bincount(of_row).tolist() == [1, 1, 1, 16, 1, 1, 1]
    for i, t in enumerate(texts):
        _, alone = passage_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone, x[of_row == i], atol=1e-6)


def test_logistic_fit_separable_and_constant():
    slope, intercept = fit_logistic(np.array([-1.0, 1.0]), np.array([0, 1]), np.array([5.0, 5.0]))
    assert slope > 2 and abs(intercept) < 1e-6
    slope, _ = fit_logistic(np.array([0.0, 0.0]), np.array([0, 1]), np.array([1.0, 3.0]))
    assert abs(slope) < 1e-9


def corpus(spark, bad_word, column):
    rng, rows, labels = random.Random(5), [], []
    words = [f"word{i}" for i in range(60)]
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(bad_word if bad and rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(30, 200)))
        rows.append((i, text, "x", 1))
        labels.append((i, int(bad) if column == "toxic" else int(not bad)))
    rows += [(400, None, "x", 1), (401, "", "x", 1), (None, "word1", "x", 1), (3, rows[3][1], "x", 1), (402, bad_word + " long " * 60_000, "x", 1)]
    labels += [(None, 1), (5, None), (7, labels[7][1]), (9, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score int").repartition(3)
    return docs, spark.createDataFrame(labels, f"doc_id long, {column} int"), rows, dict(x for x in labels[:400])


@pytest.mark.parametrize("column", ["toxic", "quality"])
def test_held_out_accuracy_and_odd_rows(spark, column):
    docs, labels, rows, truth = corpus(spark, "IDIOTIC%%%" if column == "quality" else "idiotic", column)
    modulus, held = (5, 0) if column == "toxic" else (3, 1)
    fit, score = (fit_toxicity, score_toxicity) if column == "toxic" else (fit_quality, score_quality)
    model = fit(docs, labels, **({} if column == "toxic" else {"turns": 8, "epochs": 8}))
    got = score(docs, model).select("doc_id", "score").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % modulus == held]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in own]) > 0.95
    # no labels, one label only, no documents
    for some in (labels.limit(0), labels.where(f"{column} = 1")):
        flat = {round(r.score, 12) for r in score(docs, fit(docs, some)).collect()}
        assert len(flat) == 1
    assert score(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_skips_held_out_rows(spark):
    labels = spark.range(1000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    sample, sizes = labelled_sample(labels.unionByName(labels), "toxic", 5, 0, 50)
    rows = sample.collect()
    assert len(rows) == 100 and len({r.doc_id for r in rows}) == 100
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in rows)
    assert sum(sizes.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1000))


def test_passages_of_a_toxic_text(spark):
    docs, labels, *_ = corpus(spark, "idiotic", "toxic")
    model = fit_toxicity(docs, labels)
    text = "word1 " * 30 + "idiotic idiotic idiotic" + " word2" * 30
    row = score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert any(text.encode()[p.start:p.end] == b"idiotic idiotic idiotic" for p in row.passages)
