"""Rule score of feature rows and the shape of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import RULE_SCORE_WEIGHTS
from ..functions.values import clip01

PREDICTION_COLUMNS = ["session_id", "prefix_len", "label", "bot_probability", "threshold_used", "predicted_bot"]


def rule_score(columns: list[str]) -> Column:
    """Transparent bot score in [0, 1] from the cues that are present."""
    terms = {
        "navigation_entropy_score": clip01(1.0 - F.coalesce("navigation_entropy_score", F.lit(0.5))),
        **{
            name: clip01(F.coalesce(name, F.lit(0.0)))
            for name in ("repeated_transition_ratio", "low_latency_ratio", "leaf_visit_ratio", "far_jump_ratio")
        },
        "has_suspect_user_agent": F.coalesce("has_suspect_user_agent", F.lit(0.0)),
        "ua_browser_like": 1.0 - F.coalesce("ua_browser_like", F.lit(0.0)),
    }
    score, weight_total = F.lit(0.0), 0.0
    for name, weight in RULE_SCORE_WEIGHTS.items():
        if name in columns:
            score = score + weight * terms[name]
            weight_total += weight
    return clip01(score / max(weight_total, 1.0))


def rule_scores(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """Feature rows' ids with their rule score; agent cues come from the session metadata."""
    cues = [c for c in ("has_suspect_user_agent", "ua_browser_like") if c in metadata.columns]
    joined = features.join(metadata.select("session_id", *cues), "session_id", "left")
    return joined.select(
        "session_id", "prefix_len", "label", rule_score(joined.columns).alias("bot_probability")
    )


def decide(scores: DataFrame, threshold: Column) -> DataFrame:
    """Add the threshold and the decision to scored rows."""
    return scores.withColumn("threshold_used", threshold.cast("double")).withColumn(
        "predicted_bot", (F.col("bot_probability") >= F.col("threshold_used")).cast("int")
    )


def decide_by_prefix(scores: DataFrame, thresholds: DataFrame, default: Column) -> DataFrame:
    """Decisions with one threshold per prefix, the default where none was tuned."""
    joined = scores.join(thresholds.select("prefix_len", "threshold"), "prefix_len", "left")
    return decide(joined, F.coalesce("threshold", default)).select(*PREDICTION_COLUMNS)


def spread_session_scores(features: DataFrame, session_scores: DataFrame) -> DataFrame:
    """One score per session copied to each of its prefix rows; sessions without a score are dropped."""
    scored = session_scores.where(F.col("bot_probability").isNotNull()).select("session_id", "bot_probability")
    return features.select("session_id", "prefix_len", "label").join(scored, "session_id")
