"""Spark counterparts of the shared building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickwarden.operators import features as feats
from clickwarden.operators.graph import graph_edges, graph_nodes, hop_distances, transitions
from clickwarden.operators.labels import apply_session_labels, manual_labels
from clickwarden.operators.ranking import with_global_row_number
from clickwarden.operators.sessionize import sessionize
from clickwarden.session import materialized

from .requests_view import PREFIXES, TIMEOUT, requests_view, table


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six decimals without a negative zero, as in the SQL."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in names})


def stored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests as a written table, as after ingest."""
    return materialized(requests_view(spark, sf_dir))


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events, lazily."""
    return sessionize(stored_requests(spark, sf_dir), timeout=TIMEOUT, tie_breaker="event_id")


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(
        stored_requests(spark, sf_dir), timeout=TIMEOUT, tie_breaker="event_id", drop_assets=False, min_length=1
    )


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id") % 6
    rows = table(spark, sf_dir, "events").select("user_id").distinct().where(user != 5).select(
        F.concat(F.lit("client_id:"), F.col("user_id").cast("string")).alias("client_key"),
        F.when(user.isin(0, 3, 4), "bot").otherwise("human").alias("label"),
        F.when(user.isin(1, 2), F.lit("panel")).alias("collection_method"),
    )
    return manual_labels(rows)


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events written once, for queries that use them several times."""
    return materialized(page_events(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled events and summary."""
    return apply_session_labels(stored_events(spark, sf_dir), label_table(spark, sf_dir))


def site_nodes(events: DataFrame) -> DataFrame:
    return graph_nodes(graph_edges(events))


def prefix_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = materialized(labelled(spark, sf_dir)[0])
    return feats.prefix_features(events, site_nodes(events), PREFIXES)


def full_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = materialized(labelled(spark, sf_dir)[0])
    return feats.full_session_features(events, site_nodes(events))


def early_and_all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of the first 60 % of sessions by start time, and of all."""
    events = stored_events(spark, sf_dir)
    starts = events.where(F.col("seq") == 1).select("session_id", F.col("timestamp").alias("start_timestamp"))
    ranked = with_global_row_number(starts, [F.col("start_timestamp"), F.col("session_id")], "rank")
    total = ranked.agg(F.count("*")).scalar()
    early = ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(total * 0.6))).select("session_id")
    return events.join(early, "session_id", "left_semi"), events
