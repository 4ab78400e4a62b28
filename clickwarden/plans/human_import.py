"""Import of logs that hold real human browsing only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import LABEL_COLUMNS, SESSION_TIMEOUT_SECONDS
from ..functions.agents import is_preview_agent
from ..operators.labels import number_participants, upsert_labels
from ..operators.sessionize import sessionize
from ..operators.summary import session_manifest
from ..session import materialized


def without_preview_agents(requests: DataFrame) -> DataFrame:
    """Requests without link previews and crawlers."""
    return requests.where(~is_preview_agent(F.col("user_agent")))


def preview_agent_counts(requests: DataFrame) -> DataFrame:
    """How many requests are kept and how many filtered."""
    preview = is_preview_agent(F.col("user_agent"))
    return requests.agg(F.count_if(~preview).alias("num_requests"), F.count_if(preview).alias("num_filtered"))


def import_human_requests(
    requests: DataFrame, existing_labels: DataFrame | None = None, *, timeout: float = SESSION_TIMEOUT_SECONDS,
    min_length: int = 2, participant_prefix: str = "human_manual", traffic_family: str = "human_navigation",
    collection_method: str = "manual_browser", automation_stack: str = "browser",
    notes: str = "imported real human browsing log", exclude_preview_agents: bool = True,
    tie_breaker: str | None = None,
) -> dict[str, DataFrame]:
    """Identified events, session manifest, label rows and request counts.

    ``existing_labels`` are merged with the new label rows; imported rows win.
    """
    kept = without_preview_agents(requests) if exclude_preview_agents else requests
    events = materialized(sessionize(kept, timeout=timeout, min_length=min_length, tie_breaker=tie_breaker))
    numbers = number_participants(events, participant_prefix).select(
        "session_id", F.col("participant_id").alias("_participant")
    )
    identified = materialized(
        events.drop("participant_id").join(numbers, "session_id")
        .withColumns({
            "label": F.lit("human"), "participant_id": F.col("_participant"),
            "traffic_family": F.lit(traffic_family), "collection_method": F.lit(collection_method),
            "automation_stack": F.lit(automation_stack), "notes": F.lit(notes),
        })
        .drop("_participant")
    )
    rows = identified.where(F.col("seq") == 1).withColumn("client_key", F.lit("")).select(*LABEL_COLUMNS)
    labels = rows
    if existing_labels is not None:
        # one row per key on either side, so any constant orders them
        labels = upsert_labels(existing_labels.withColumn("_order", F.lit(0)), rows.withColumn("_order", F.lit(0)), "_order")
    return {
        "events": identified, "manifest": session_manifest(identified), "labels": labels,
        "counts": preview_agent_counts(requests),
    }
