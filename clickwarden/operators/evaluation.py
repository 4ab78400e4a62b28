"""Detection metrics, thresholds, detection delay and bootstrap intervals.

Curves need a running count over scores. Rows are first counted per distinct score; the counts are
cut into ranges of (group, score) at sampled quantiles, as many as their number asks for, and each range
adds the totals of the lower ones of its group, so no task sees all scores of a group and the result
is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import BOT, UNKNOWN
from ..functions.values import ratio
from ..session import materialized
from .bootstrap import METRICS, replicate_intervals

# distinct scores of one range
RANGE_SCORES = 500_000
CANDIDATE_THRESHOLDS = np.linspace(0.05, 0.95, 19).tolist()
BOOTSTRAP_METRICS = ["f1", "roc_auc", "pr_auc"]


def known_labels(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label") != UNKNOWN)


def _confusion() -> dict[str, Column]:
    truth, flagged = F.col("label") == BOT, F.col("predicted_bot") == 1
    return {
        "tp": F.count_if(truth & flagged), "fp": F.count_if(~truth & flagged),
        "fn": F.count_if(truth & ~flagged), "tn": F.count_if(~truth & ~flagged),
    }


def _binary_metrics() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(predictions: DataFrame, keys: Sequence[str] = ("prefix_len",)) -> DataFrame:
    """Accuracy, precision, recall and F1 per group; 0 where undefined."""
    counts = predictions.groupBy(*keys).agg(
        *[c.alias(name) for name, c in _confusion().items()]
    )
    return counts.select(*keys, *[c.alias(name) for name, c in _binary_metrics().items()])


def score_counts(rows: DataFrame, keys: Sequence[str], score: str = "bot_probability") -> DataFrame:
    """Positives and negatives per group and distinct score."""
    truth = F.col("label") == BOT
    # adding zero turns -0.0 into 0.0, so both fall into one group
    return rows.groupBy(*keys, (F.col(score) + F.lit(0.0)).alias("score")).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg")
    )


def running_counts(counts: DataFrame, keys: Sequence[str], range_scores: int | None = None) -> DataFrame:
    """Add ``pos_below`` and ``neg_below`` (strictly lower scores), and the group totals."""
    keys, counts = list(keys), materialized(counts)
    ranges = max(1, -(-counts.count() // (range_scores or RANGE_SCORES)))
    placed = counts.withColumn("range", F.lit(0))
    if ranges > 1:
        # written, so that both readers below see one set of sampled borders
        placed = materialized(counts.repartitionByRange(ranges, *keys, "score").withColumn("range", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    lower = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        *keys, "range",
        F.coalesce(F.sum("p").over(lower), F.lit(0)).alias("p"), F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("n"),
        F.sum("p").over(group).alias("pos_total"), F.sum("n").over(group).alias("neg_total"),
    )
    before = Window.partitionBy(*keys, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda name, offset: F.col(offset) + F.coalesce(F.sum(name).over(before), F.lit(0))
    return (
        placed.join(offsets, [*keys, "range"])
        .withColumns({"pos_below": below("pos", "p"), "neg_below": below("neg", "n")})
        .drop("p", "n", "range")
    )


def curve_metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per group; NULL with one class only."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pos_total, neg_total = F.max("pos_total").cast("double"), F.max("neg_total").cast("double")
    # at this threshold and above
    flagged_pos = F.col("pos_total") - F.col("pos_below")
    flagged_neg = F.col("neg_total") - F.col("neg_below")
    both = (pos_total > 0) & (neg_total > 0)
    wins = F.sum(pos * (F.col("neg_below") + 0.5 * neg))
    precision_steps = F.sum(pos * ratio(flagged_pos, flagged_pos + flagged_neg))
    return running_counts(counts, keys).groupBy(*keys).agg(
        F.when(both, wins / (pos_total * neg_total)).alias("roc_auc"),
        F.when(both, precision_steps / pos_total).alias("pr_auc"),
    )


def roc_auc(rows: DataFrame, keys: Sequence[str] = ("prefix_len",), score: str = "bot_probability") -> DataFrame:
    return curve_metrics(score_counts(rows, keys, score), keys).drop("pr_auc")


def average_precision(rows: DataFrame, keys: Sequence[str] = ("prefix_len",), score: str = "bot_probability") -> DataFrame:
    return curve_metrics(score_counts(rows, keys, score), keys).drop("roc_auc")


def metrics_by_group(predictions: DataFrame, keys: Sequence[str] = ("prefix_len",)) -> DataFrame:
    """All six metrics per group."""
    keys = list(keys)
    return binary_metrics(predictions, keys).join(curve_metrics(score_counts(predictions, keys), keys), keys)


def _f1_by_candidate(scores: DataFrame, keys: Sequence[str], candidates: Sequence[float]) -> DataFrame:
    """F1 at every candidate from one count per group and threshold step."""
    ordered = sorted(float(c) for c in candidates)
    steps = F.array(*map(F.lit, ordered))
    reached = F.size(F.filter(steps, lambda t: t <= F.col("bot_probability")))
    truth = F.col("label") == BOT
    counted = scores.groupBy(*keys, reached.alias("reached")).agg(
        F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg")
    )
    totals = [
        value.alias(f"{name}_{i}")
        for i in range(len(ordered))
        for name, value in (
            ("tp", F.sum(F.when(F.col("reached") > i, F.col("pos")).otherwise(0))),
            ("fp", F.sum(F.when(F.col("reached") > i, F.col("neg")).otherwise(0))),
        )
    ]
    grouped = counted.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *totals)
    f1 = lambda i: ratio(
        2 * F.col(f"tp_{i}"), F.col(f"tp_{i}") + F.col(f"fp_{i}") + F.col("pos")
    )
    # the struct maximum prefers the higher F1, then the lower threshold
    options = [F.struct(f1(i).alias("f1"), F.lit(-t).alias("minus_threshold")) for i, t in enumerate(ordered)]
    return grouped.select(*keys, "pos", "neg", F.array_max(F.array(*options)).alias("best"))


def tune_thresholds(
    scores: DataFrame, keys: Sequence[str] = ("prefix_len",), default: Column | float = 0.5,
    candidates: Sequence[float] = CANDIDATE_THRESHOLDS, min_rows: int = 4,
) -> DataFrame:
    """Threshold with the best F1 per group, the lowest on ties; the default for small or one-class groups."""
    fallback = default if isinstance(default, Column) else F.lit(float(default))
    usable = (F.col("pos") + F.col("neg") >= min_rows) & (F.col("pos") > 0) & (F.col("neg") > 0)
    return _f1_by_candidate(scores, list(keys), candidates).select(
        *keys,
        F.when(usable, -F.col("best.minus_threshold")).otherwise(fallback).alias("threshold"),
        F.when(usable, F.col("best.f1")).alias("f1"),
    )


def tune_threshold(scores: DataFrame, default: float = 0.5, candidates: Sequence[float] = CANDIDATE_THRESHOLDS) -> Column:
    """One threshold over all rows, as a scalar."""
    tuned = tune_thresholds(scores.withColumn("_all", F.lit(1)), ["_all"], default, candidates, min_rows=1)
    return F.coalesce(tuned.select("threshold").scalar(), F.lit(float(default)))


def detection_delay(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per label: sessions, share detected and mean first detecting prefix. Only bots are detected."""
    hit = (F.col("predicted_bot") == 1) & (F.col("label") == BOT)
    sessions = predictions.groupBy(*keys, "session_id", "label").agg(
        F.min(F.when(hit, F.col("prefix_len"))).alias("first_prefix")
    )
    return sessions.groupBy(*keys, "label").agg(
        F.count("*").alias("num_sessions"),
        ratio(F.count("first_prefix"), F.count("*")).alias("detection_rate"),
        F.when(F.count("first_prefix") > 0, F.sum("first_prefix") / F.count("first_prefix")).alias(
            "mean_first_detected_prefix"
        ),
    )


def bootstrap_intervals(
    predictions: DataFrame, keys: Sequence[str] = ("prefix_len",), n_bootstrap: int = 500, alpha: float = 0.05,
    metrics: Sequence[str] = BOOTSTRAP_METRICS,
) -> DataFrame:
    """Point estimate and percentile interval per group and metric.

    Each replicate weights a session by a Poisson(1) draw hashed from its id, which resamples
    without moving rows (``bootstrap``). Undefined replicates are left out.
    """
    keys = list(keys)
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unsupported metrics: {sorted(unknown)}")
    bounds = replicate_intervals(predictions, keys, int(n_bootstrap), alpha, list(metrics))
    point = metrics_by_group(predictions, keys).unpivot(keys, list(metrics), "metric", "point_estimate")
    used = predictions.groupBy(*keys).agg(F.max("threshold_used").alias("threshold_used"))
    return (
        point.join(bounds, [*keys, "metric"], "left")
        .join(used, keys)
        .select(*keys, "metric", "point_estimate", "ci_low", "ci_high",
                F.coalesce("n_bootstrap", F.lit(0)).alias("n_bootstrap"), "threshold_used")
    )


def trajectory_sessions(predictions: DataFrame) -> DataFrame:
    """Example sessions: the lowest mean score of the humans, the highest and the middle of the bots."""
    from .ranking import with_global_row_number

    means = predictions.groupBy("session_id", "label").agg(F.avg("bot_probability").alias("mean_probability"))
    pick = lambda df, series: df.select(
        F.lit(series).alias("series"), "session_id", F.col("mean_probability")
    )
    row = F.struct("mean_probability", "session_id")
    human = means.where(F.col("label") == "human").agg(F.min(row).alias("r")).select("r.*")
    bots = means.where(F.col("label") == BOT)
    ranked = with_global_row_number(
        bots, [F.col("mean_probability"), F.col("session_id")], "rank"
    )
    count = ranked.agg(F.count("*")).scalar()
    top = ranked.where(F.col("rank") == count)
    middle = ranked.where((F.col("rank") == F.floor(count / 2) + 1) & (count >= 2))
    chosen = pick(human.where(F.col("session_id").isNotNull()), "human").unionByName(pick(top, "bot_high")).unionByName(pick(middle, "bot_mid"))
    return chosen.join(predictions.select("session_id", "prefix_len", "bot_probability"), "session_id").select(
        "series", "session_id", "prefix_len", "bot_probability"
    )


def leaderboard(predictions: DataFrame, keys: Sequence[str] = ("protocol", "model_name", "ablation_name", "notes")) -> DataFrame:
    """Metrics at the last prefix of each run with its detection of bots, best first.

    A column ``report_prefix`` replaces the prefix in the metrics, not in the detection delay.
    """
    keys = list(keys)
    reported = predictions
    if "report_prefix" in predictions.columns:
        reported = predictions.withColumn("prefix_len", F.col("report_prefix"))
    metrics = metrics_by_group(reported, [*keys, "prefix_len"])
    names = ["prefix_len", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
    final = metrics.groupBy(*keys).agg(F.max_by(F.struct(*names), "prefix_len").alias("last")).select(*keys, "last.*")
    delay = detection_delay(predictions, keys).where(F.col("label") == BOT).select(
        *keys, F.col("detection_rate").alias("bot_detection_rate"),
        F.col("mean_first_detected_prefix").alias("mean_first_detected_prefix_bot"),
    )
    threshold = predictions.groupBy(*keys).agg(F.max_by("threshold_used", "prefix_len").alias("threshold"))
    return order_leaderboard(
        final.withColumnRenamed("prefix_len", "final_prefix").join(delay, keys, "left").join(threshold, keys)
    )


def order_leaderboard(board: DataFrame) -> DataFrame:
    best_first = [F.desc_nulls_last(F.nanvl(c, F.lit(None).cast("double"))) for c in ("f1", "roc_auc", "pr_auc")]
    return board.orderBy(*best_first)
