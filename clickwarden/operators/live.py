"""Ranking and totals of scored live sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import BOT, HUMAN

RECENT_PATHS = 8
_SHOWN = ["navigation_entropy_score_v2", "mean_delta_t", "low_latency_ratio", "unique_node_ratio"]


def scored_sessions(events: DataFrame, scores: DataFrame, features: DataFrame, threshold: float, now: float) -> DataFrame:
    """One row per session: state, score, paths and times; ``waiting`` before the second request."""
    last = F.col("seq") == F.col("n_events")
    recent = F.col("seq") > F.col("n_events") - RECENT_PATHS
    sessions = events.groupBy("session_id").agg(
        F.count("*").alias("event_count"),
        F.max(F.when(F.col("seq") == 1, F.col("path"))).alias("first_path"),
        F.max(F.when(last, F.col("path"))).alias("last_path"),
        # eight paths at most
        F.array_sort(F.collect_list(F.when(recent, F.struct("seq", "path")))).alias("recent"),
        F.max(F.when(F.col("seq") == 1, F.col("timestamp"))).alias("first_time"),
        F.max(F.when(last, F.col("timestamp"))).alias("last_time"),
        F.max(F.when(last, F.col("user_agent"))).alias("user_agent"),
        F.max(F.when(F.col("seq") == 1, F.col("client_key"))).alias("client_key"),
    )
    joined = sessions.join(scores.select("session_id", "bot_probability"), "session_id", "left").join(
        features.select("session_id", *_SHOWN), "session_id", "left"
    )
    probability, ready = F.col("bot_probability"), F.col("event_count") >= 2
    seconds = lambda value: F.round(F.greatest(F.lit(0.0), value), 1)
    return joined.select(
        "session_id", ready.alias("ready"), "event_count", "bot_probability",
        F.round(probability * 100, 1).alias("bot_probability_pct"),
        F.when(~ready, "waiting").when(probability >= threshold, BOT).otherwise(HUMAN).alias("predicted_label"),
        "first_path", "last_path", F.transform("recent", lambda v: v["path"]).alias("recent_paths"),
        seconds(F.col("last_time") - F.col("first_time")).alias("duration_seconds"),
        seconds(F.lit(float(now)) - F.col("last_time")).alias("last_seen_seconds_ago"),
        F.coalesce("user_agent", F.lit("")).alias("user_agent"), "client_key",
        *[F.round(c, 4).alias(c) for c in _SHOWN],
    )


def rank_sessions(rows: DataFrame) -> DataFrame:
    """Scored sessions first, likely bots and long sessions on top."""
    return rows.orderBy(
        F.desc(F.col("bot_probability").isNotNull()), F.desc_nulls_last("bot_probability"), F.desc("event_count")
    )


def session_totals(rows: DataFrame, threshold: float) -> DataFrame:
    """Totals of the live view in one row."""
    ready = F.col("ready")
    highest = F.coalesce(F.max(F.when(ready, F.coalesce("bot_probability", F.lit(0.0)))), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("total_sessions"),
        F.count_if(ready).alias("ready_sessions"),
        F.count_if(ready & (F.col("bot_probability") >= threshold)).alias("flagged_sessions"),
        F.round(highest, 4).alias("highest_probability"),
        F.round(highest * 100, 1).alias("highest_probability_pct"),
        F.lit(float(threshold)).alias("threshold"),
    )
