"""Conditions of the optimum hold for fitted models and fail for others."""

import random

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from clickwarden.operators import certificates
from clickwarden.operators.models import fit_calibrated_svm, fit_gradient_boosting, fit_logistic_regression

COLUMNS = ["fast", "wide", "constant"]


@pytest.fixture(scope="module")
def training(spark):
    draw = random.Random(5)
    rows = []
    for i in range(300):
        bot = draw.random() < 0.3
        rows.append((f"s{i}", "bot" if bot else "human", draw.gauss(1.0 if bot else 0.0, 1.0), draw.gauss(5.0, 20.0), 7.0))
    return spark.createDataFrame(rows, "session_id string, label string, fast double, wide double, constant double").cache()


def test_logistic_moments_meet_at_the_optimum_only(spark, training):
    fitted = fit_logistic_regression(training, COLUMNS)
    rows = {r["feature"]: r for r in certificates.logistic_moments(fitted, training, COLUMNS).collect()}
    assert set(rows) == {"intercept", *COLUMNS}
    assert max(abs(r["gradient"]) for r in rows.values()) < 1e-6
    assert rows["intercept"]["target_moment"] == pytest.approx(0.5)
    assert rows["constant"]["coefficient"] == 0.0

    # by hand: half of the scaled distance of the bots' mean
    values = training.select("label", "fast").toPandas()
    bots = values[values.label == "bot"].fast.mean()
    want = 0.5 * (bots - values.fast.mean()) / values.fast.std()
    assert rows["fast"]["target_moment"] == pytest.approx(want)

    # the same model over other rows is not the optimum
    other = training.where(F.col("fast") < 1.0)
    moved = certificates.logistic_moments(fitted, other, COLUMNS).agg(F.max(F.abs("gradient"))).head()[0]
    assert moved > 1e-3
    assert any(isinstance(s, LogisticRegressionModel) for s in fitted.pipeline.stages)


def test_svm_folds_and_duality_gap(training):
    fitted = fit_calibrated_svm(training, COLUMNS, iterations=100)
    folds = {r["fold"]: r for r in certificates.sigmoid_moments(fitted, training).collect()}
    assert sum(r["num_rows"] for r in folds.values()) == 300 and set(folds) == {0, 1, 2}
    for row in folds.values():
        assert row["expected_bots"] == pytest.approx(row["bots"], abs=1e-2)
        assert row["expected_margins"] == pytest.approx(row["margins"], abs=1e-2)
    gaps = {r["fold"]: r for r in certificates.svm_gaps(fitted, training).collect()}
    # a weaker model has the larger loss, and no bound exceeds any loss
    weak = {r["fold"]: r for r in certificates.svm_gaps(fit_calibrated_svm(training, COLUMNS, iterations=1), training).collect()}
    for fold, row in gaps.items():
        assert row["num_rows"] == 300 - folds[fold]["num_rows"]
        assert 0.0 < row["dual"] <= row["primal"] + 1e-9 <= weak[fold]["primal"] + 2e-9
        assert weak[fold]["dual"] <= row["primal"] + 1e-9
        assert row["primal"] - row["dual"] < 0.1 * row["primal"]


def test_first_boosted_tree(training):
    fitted = fit_gradient_boosting(training, COLUMNS, rounds=2)
    leaves = certificates.first_tree_leaves(fitted, training)
    rows = leaves.collect()
    assert len(rows) > 1 and sum(r["num_rows"] for r in rows) == 300
    assert max(abs(r["gradient"]) for r in rows) < 1e-9
    balance = certificates.tree_balance(leaves).head()
    sides = sum(1 if r["label"] == "bot" else -1 for r in training.collect())
    assert balance["answer_sum"] == pytest.approx(sides)
    assert balance["squares"] == pytest.approx(300 - sides * sides / 300)
    # answers that are not their leaf's mean do not balance
    off = certificates.tree_balance(leaves.withColumn("answer", F.col("answer") + 0.1)).head()
    assert off["answer_sum"] != pytest.approx(sides)
