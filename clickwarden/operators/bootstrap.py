"""Percentile intervals of detection metrics from weighted replicates, in two passes over sorted scores.

A replicate weights each session by a Poisson(1) draw hashed from its id, so a row's weights in all replicates are
one vector that any task can make. Rows are range partitioned by group and score. The first pass adds the vectors of
each partition; running sums over partitions give what lies below each. The second pass walks the sorted scores with
these offsets and adds the terms of the curves, again one vector per partition and group. Rows are never multiplied
by replicates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..constants import BOT
from ..session import materialized

# cumulative Poisson(1) probabilities: a draw below the k-th is at most k
# as far as the remaining tail is below the step of the 32-bit uniform numbers
POISSON_CUMULATIVE = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(13)]).tolist()
#: Uniform numbers in one digest.
WORDS = 4
#: Rows whose weights are held at once, and rows of one partition.
CHUNK_ROWS, PARTITION_ROWS = 2000, 100_000
METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def replicate_weights(sessions: Sequence[str], replicates: int) -> np.ndarray:
    """Poisson(1) counts, a row per session and a column per replicate.

    Replicate r takes word (r - 1) mod 4 of the md5 of ``session|(r - 1) div 4``.
    """
    blocks = -(-replicates // WORDS)
    digests = b"".join(hashlib.md5(f"{s}|{b}".encode()).digest() for s in sessions for b in range(blocks))
    words = np.frombuffer(digests, dtype=">u4").reshape(len(sessions), blocks * WORDS)[:, :replicates]
    return np.searchsorted(POISSON_CUMULATIVE, words / 4294967296.0, side="right").astype(np.int64)


def _vector(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, dtype=np.float64).tobytes()


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """Stretches of rows with one part and group, in order."""
    for batch in batches:
        frame = batch.select(columns).to_pandas()
        edges = np.flatnonzero((frame["part"].ne(frame["part"].shift()) | frame["grp"].ne(frame["grp"].shift())).to_numpy())
        for lo, hi in zip(edges, [*edges[1:], len(frame)]):
            yield (int(frame["part"].iat[lo]), frame["grp"].iat[lo]), frame.iloc[lo:hi]


def _first_pass(replicates: int):
    """Per part and group: weights of bots, others, flagged bots and flagged others in each replicate."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, None

        def row():
            return pa.record_batch([pa.array([current[0]], pa.int32()), pa.array([current[1]]),
                                    pa.array([_vector(sums)], pa.binary())], names=["part", "grp", "sums"])

        for place, rows in _groups(batches, ["part", "grp", "session_id", "truth", "flagged"]):
            if place != current:
                if current:
                    yield row()
                current, sums = place, np.zeros((4, replicates))
            for at in range(0, len(rows), CHUNK_ROWS):
                chunk = rows.iloc[at: at + CHUNK_ROWS]
                weights = replicate_weights(chunk["session_id"].tolist(), replicates)
                truth, flagged = chunk["truth"].to_numpy(bool), chunk["flagged"].to_numpy(bool)
                for i, chosen in enumerate((truth, ~truth, truth & flagged, ~truth & flagged)):
                    sums[i] += weights[chosen].sum(axis=0)
        if current:
            yield row()

    return add


def _offsets(replicates: int):
    """Sums of all lower parts of a group beside each part, and the totals of the group."""

    def running(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        sums = np.stack([np.frombuffer(s).reshape(4, replicates) for s in parts["sums"]])
        below = np.cumsum(sums, axis=0) - sums
        total = _vector(sums.sum(axis=0))
        return pd.DataFrame({"part": parts["part"], "grp": parts["grp"], "below": [_vector(b[:2]) for b in below], "total": total})

    return running


def _second_pass(replicates: int):
    """Terms of both curves of each part and group; its row of offsets comes first."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, below, total, terms, tie, score = None, None, None, None, None, None

        def close_tie():
            """All rows of one score are in: positives win over lower negatives and half of the equal ones."""
            nonlocal below, tie
            pos, neg = tie
            terms[0] += pos * (below[1] + 0.5 * neg)
            reached = total[:2] - below
            flagged = reached.sum(axis=0)
            terms[1] += pos * np.divide(reached[0], flagged, out=np.zeros(replicates), where=flagged > 0)
            below, tie = below + tie, np.zeros((2, replicates))

        def row():
            close_tie()
            return pa.record_batch([pa.array([current[1]]), pa.array([_vector(terms)], pa.binary())], names=["grp", "terms"])

        for place, rows in _groups(batches, ["part", "grp", "session_id", "truth", "score", "below", "total"]):
            if place != current:
                if current:
                    yield row()
                first, rows = rows.iloc[0], rows.iloc[1:]
                current, score = place, None
                below, total = (np.frombuffer(first[c]).reshape(-1, replicates) for c in ("below", "total"))
                terms, tie = np.zeros((2, replicates)), np.zeros((2, replicates))
            for at in range(0, len(rows), CHUNK_ROWS):
                chunk = rows.iloc[at: at + CHUNK_ROWS]
                weights = replicate_weights(chunk["session_id"].tolist(), replicates)
                truth, scores = chunk["truth"].to_numpy(bool)[:, None], chunk["score"].to_numpy(float)
                edges = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
                pos, neg = (np.add.reduceat(np.where(side, weights, 0), edges, axis=0) for side in (truth, ~truth))
                for k, edge in enumerate(edges):
                    if score is not None and scores[edge] != score:
                        close_tie()
                    score = scores[edge]
                    tie = tie + np.stack([pos[k], neg[k]])
        if current:
            yield row()

    return walk


def _intervals(replicates: int, alpha: float, metrics: Sequence[str]):
    def of_group(parts: pd.DataFrame) -> pd.DataFrame:
        pos, neg, hit, false = np.frombuffer(parts["total"].iat[0]).reshape(4, replicates)
        wins, steps = np.stack([np.frombuffer(t).reshape(2, replicates) for t in parts["terms"]]).sum(axis=0)
        ratio = lambda a, b: np.divide(a, b, out=np.zeros(replicates), where=b > 0)
        drawn, both = pos + neg > 0, (pos > 0) & (neg > 0)
        values = {
            "accuracy": (ratio(hit + neg - false, pos + neg), drawn), "precision": (ratio(hit, hit + false), drawn),
            "recall": (ratio(hit, pos), drawn), "f1": (ratio(2 * hit, hit + false + pos), drawn),
            "roc_auc": (ratio(wins, pos * neg), both), "pr_auc": (ratio(steps, pos), both),
        }
        rows = []
        for name in metrics:
            value, defined = values[name]
            kept = value[defined]
            low, high = np.quantile(kept, [alpha / 2, 1 - alpha / 2]) if len(kept) else (None, None)
            rows.append((parts["grp"].iat[0], name, low, high, len(kept)))
        return pd.DataFrame(rows, columns=["grp", "metric", "ci_low", "ci_high", "n_bootstrap"])

    return of_group


def replicate_intervals(
    predictions: DataFrame, keys: Sequence[str], replicates: int, alpha: float, metrics: Sequence[str]
) -> DataFrame:
    """Percentile interval per group and metric: keys, metric, ci_low, ci_high, n_bootstrap (replicates with a value).

    Rows of one group and score meet in one task; a row without score lies below all others.
    """
    rows = predictions.select(
        F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("grp"), F.col("session_id").cast("string").alias("session_id"),
        (F.col("label") == BOT).alias("truth"), F.coalesce(F.col("predicted_bot") == 1, F.lit(False)).alias("flagged"),
        # adding zero turns -0.0 into 0.0
        F.coalesce(F.col("bot_probability").cast("double") + F.lit(0.0), F.lit(float("-inf"))).alias("score"),
    )
    order = ["grp", "score"]
    parts = max(1, -(-predictions.count() // PARTITION_ROWS), int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # stored, so that both passes see the same borders
    placed = materialized(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    narrow = placed.repartition(parts, "part").sortWithinPartitions("part", "grp")
    sums = narrow.select("part", "grp", "session_id", "truth", "flagged").mapInArrow(
        _first_pass(replicates), "part int, grp string, sums binary")
    offsets = materialized(sums.groupBy("grp").applyInPandas(_offsets(replicates), "part int, grp string, below binary, total binary"))
    empty = lambda kind: F.lit(None).cast(kind)
    both = offsets.withColumns({"session_id": empty("string"), "truth": F.lit(False), "score": empty("double"), "kind": F.lit(0)})
    both = both.unionByName(placed.drop("flagged").withColumns({"below": empty("binary"), "total": empty("binary"), "kind": F.lit(1)}))
    terms = both.repartition(parts, "part").sortWithinPartitions("part", "grp", "kind", "score").drop("kind").mapInArrow(
        _second_pass(replicates), "grp string, terms binary")
    totals = offsets.groupBy("grp").agg(F.first("total").alias("total"))
    done = terms.join(totals, "grp").groupBy("grp").applyInPandas(
        _intervals(replicates, alpha, metrics), "grp string, metric string, ci_low double, ci_high double, n_bootstrap bigint")
    names = predictions.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("grp"), *keys).dropDuplicates(["grp"])
    return done.join(names, "grp").select(*keys, "metric", "ci_low", "ci_high", "n_bootstrap")
