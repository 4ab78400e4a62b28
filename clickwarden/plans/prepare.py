"""Raw log to prepared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import SESSION_TIMEOUT_SECONDS
from ..operators.graph import graph_edges, node_degrees
from ..operators.labels import apply_session_labels, proposed_label_counts
from ..operators.sessionize import sessionize
from ..operators.summary import enrich_with_all_requests, session_summary
from ..functions.paths import path_category
from ..sources.tables import read_table, write_table
from pyspark.sql import functions as F


def prepare_dataset(
    spark: SparkSession, requests: DataFrame, folder: str, *, labels: DataFrame | None = None,
    timeout: float = SESSION_TIMEOUT_SECONDS, min_length: int = 2, keep_assets: bool = False,
    tie_breaker: str | None = None, file_format: str = "parquet",
) -> DataFrame:
    """Write normalized_requests, requests, session_summary, graph_edges and graph_categories.

    Each table is written once and the next step reads it, so the log is parsed a single time.
    Returns the counts of proposed labels.
    """
    write_table(requests, folder, "normalized_requests")
    stored = read_table(spark, folder, "normalized_requests")
    options = {"timeout": timeout, "tie_breaker": tie_breaker}
    write_table(sessionize(stored, drop_assets=not keep_assets, min_length=min_length, **options), folder, "_events")
    events = read_table(spark, folder, "_events")
    everything = sessionize(stored, drop_assets=False, min_length=1, **options)
    labelled, summary = apply_session_labels(events, labels)
    write_table(enrich_with_all_requests(summary, session_summary(everything)), folder, "session_summary", file_format)
    write_table(labelled, folder, "requests", file_format)
    write_table(graph_edges(events), folder, "graph_edges", file_format)
    edges = read_table(spark, folder, "graph_edges", file_format)
    categories = node_degrees(edges).select("path", path_category(F.col("path")).alias("category"))
    write_table(categories, folder, "graph_categories", file_format)
    return proposed_label_counts(read_table(spark, folder, "session_summary", file_format))
