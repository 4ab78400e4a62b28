"""Labelled rows for the two classifiers: held-out rows, a bounded sample, a logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has remainder 0 of the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")) % modulus


def labelled_sample(labels: DataFrame, label: str, modulus: int, held_out: int, per_label: int) -> tuple[DataFrame, dict]:
    """At most ``per_label`` ids of each label from rows that aren't held out, and how many there were.

    Rows without id or with another label than 0 and 1 are left out; an id labelled twice has its
    larger label. The sample takes the smallest hashes of the ids, so it doesn't depend on row order.
    """
    rows = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder("doc_id", modulus) != held_out))
            .groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {row.label: row.n for row in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for value in (0, 1)]
    return parts[0].unionByName(parts[1]), {value: counts.get(value, 0) for value in (0, 1)}


def sampled_documents(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Documents of the sample with their label; the sample is small by its bound, so it is sent to all tasks."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.join(F.broadcast(sample), "doc_id")


def fit_logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic fit with a small ridge, by Newton steps."""
    # pulled slightly inward, so that separable labels have a finite fit
    target = np.where(label > 0, 1 - 1e-3, 1e-3)
    features = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.zeros(2)

    def loss(t):
        z = features @ t
        return float(weight @ (np.logaddexp(0, z) - target * z) + 0.5e-3 * t @ t)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -35, 35)))
        gradient = features.T @ (weight * (p - target)) + 1e-3 * theta
        hessian = (features * (weight * p * (1 - p) + 1e-9)[:, None]).T @ features + 1e-3 * np.eye(2)
        step, scale = np.linalg.solve(hessian, gradient), 1.0
        while scale > 1e-6 and loss(theta - scale * step) > loss(theta):
            scale /= 2
        theta = theta - scale * step
        if np.abs(step).max() * scale < 1e-9:
            break
    return float(theta[0]), float(theta[1])
