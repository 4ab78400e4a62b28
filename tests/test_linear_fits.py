"""Linear fits over nearly dependent columns: passes they take and the optimum they reach."""

import random

import pytest
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel

from clickwarden.operators import certificates
from clickwarden.operators.models import feature_coefficients, fit_calibrated_svm, fit_logistic_regression

COLUMNS = [f"x{i}" for i in range(40)]


@pytest.fixture(scope="module")
def training(spark):
    draw = random.Random(11)
    rows = []
    for i in range(1500):
        bot = draw.random() < 0.4
        base = draw.gauss(0.6 if bot else 0.0, 1.0)
        # each column is the one before it and a little noise; the last repeats the first
        values = [base]
        while len(values) < 39:
            values.append(draw.choice(values[-2:]) + draw.gauss(0.0, (0.3, 0.03, 0.01)[len(values) % 3]))
        rows.append((f"s{i}", "bot" if bot else "human", *values, 1.0 - values[0]))
    return spark.createDataFrame(rows, ["session_id", "label", *COLUMNS]).cache()


def test_logistic_fit_takes_few_passes(training):
    fitted = fit_logistic_regression(training, COLUMNS)
    model = next(s for s in fitted.pipeline.stages if isinstance(s, LogisticRegressionModel))
    assert model.summary.totalIterations < 100
    moments = certificates.logistic_moments(fitted, training, COLUMNS).collect()
    assert max(abs(r["gradient"]) for r in moments) < 1e-8
    # mirrored columns share their weight evenly
    weights = dict(zip(COLUMNS, feature_coefficients(fitted, model)))
    assert weights["x0"] == pytest.approx(-weights["x39"], abs=1e-6) and abs(weights["x0"]) > 1e-3


def test_svm_fits_converge(training):
    fitted = fit_calibrated_svm(training, COLUMNS)
    machines = [s for s in fitted.pipeline.stages if isinstance(s, LinearSVCModel)]
    assert len(machines) == 3
    assert max(m.summary().totalIterations for m in machines) < 400
    assert {s["session_id"] for s in fitted.score(training, ["session_id"]).collect()} == {f"s{i}" for i in range(1500)}
