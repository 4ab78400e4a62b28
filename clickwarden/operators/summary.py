"""One row per session: summary, metadata, signatures and manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import LABEL_METADATA
from ..functions.agents import agent_family, bot_family, is_browser_like, is_suspect_agent
from ..functions.paths import is_page_path, path_depth
from ..functions.times import utc_text
from ..functions.values import blank_to_null, double_or_zero, ratio

ENRICHMENT_COLUMNS = [
    "start_timestamp", "end_timestamp", "first_path", "referrer_present_ratio",
    "num_page_requests", "num_asset_requests", "asset_request_ratio", "has_asset_requests",
]


def _first(column: str | Column) -> Column:
    """Value at the first event of the session."""
    value = F.col(column) if isinstance(column, str) else column
    return F.max(F.when(F.col("seq") == 1, value))


def _share(condition: Column) -> Column:
    return ratio(F.count_if(condition), F.count("*"))


def _summary_columns(events: DataFrame) -> dict[str, Column]:
    optional = lambda name: (
        _first(blank_to_null(F.col(name))) if name in events.columns
        else F.max(F.lit(None).cast("string"))
    )
    later_delta = F.when(F.col("seq") > 1, F.col("delta_t"))
    assets = F.count_if(~is_page_path(F.col("path")))
    return {
        "label": F.max("label"),
        "client_key": optional("client_key"),
        "ip": optional("ip"),
        "num_events": F.count("*"),
        "start_timestamp": F.min("timestamp"),
        "end_timestamp": F.max("timestamp"),
        "duration_seconds": F.max("timestamp") - F.min("timestamp"),
        "unique_paths": F.count_distinct("path"),
        "unique_path_ratio": ratio(F.count_distinct("path"), F.count("*")),
        "mean_delta_t": ratio(F.sum(later_delta), F.count(later_delta)),
        "page_categories": F.count_distinct("page_category"),
        "first_path": _first("path"),
        "referrer_present_ratio": _share(F.col("referrer").isNotNull()),
        "raw_referrer_ratio": _share(F.col("raw_referrer").isNotNull()),
        "num_page_requests": F.count("*") - assets,
        "num_asset_requests": assets,
        "asset_request_ratio": ratio(assets, F.count("*")),
        "has_asset_requests": (assets > 0).cast("double"),
        "user_agent": _first("user_agent"),
        **{name: optional(name) for name in LABEL_METADATA},
    }


def session_summary(events: DataFrame) -> DataFrame:
    """Counts, times, variety and first-request facts per session."""
    return _grouped(events, {})


def _grouped(events: DataFrame, extra: dict[str, Column]) -> DataFrame:
    columns = {**_summary_columns(events), **extra}
    return events.groupBy("session_id").agg(*[c.alias(name) for name, c in columns.items()])


def label_votes(events: DataFrame) -> DataFrame:
    """The voted label of each session with its number of events."""
    return events.groupBy("session_id").agg(F.max("label").alias("label"), F.count("*").alias("num_events"))


def enrich_with_all_requests(summary: DataFrame, all_requests: DataFrame) -> DataFrame:
    """Page-only summary joined to the all-request summary by session id.

    Both are numbered on their own, so one id can name two different visits;
    ``same_start`` tells whether the two sessions begin at the same time.
    """
    extra = all_requests.select(
        "session_id", *[F.col(c).alias(f"{c}_all_requests") for c in ENRICHMENT_COLUMNS]
    )
    return summary.join(extra, "session_id", "left").withColumn(
        "same_start", F.col("start_timestamp") == F.col("start_timestamp_all_requests")
    )


def _sequence_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash the paths of each session of sorted rows as they pass; nothing is gathered."""
    session, whole, short, seen, rows = None, None, {}, 0, []

    def digests():
        own = [whole.copy() if n > seen else short[n] for n in (3, 5)]
        return (session, *[h.hexdigest()[:12] for h in (whole, *own)])

    def batch_of(rows):
        return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], names=list(_SIGNATURES))

    for batch in batches:
        for own, path in zip(batch.column("session_id").to_pylist(), batch.column("path").to_pylist()):
            if whole is None or own != session:
                if whole is not None:
                    rows.append(digests())
                session, whole, short, seen = own, hashlib.sha1(), {}, 0
            whole.update(f" > {path}".encode() if seen else path.encode())
            seen += 1
            if seen in (3, 5):
                short[seen] = whole.copy()
        if rows:
            yield batch_of(rows)
            rows = []
    if whole is not None:
        yield batch_of([digests()])


_SIGNATURES = ("session_id", "path_signature", "prefix3_signature", "prefix5_signature")


def path_signatures(events: DataFrame) -> DataFrame:
    """First 12 hex digits of the SHA-1 of the whole path sequence and of its first 3 and 5 paths.

    One definition at every length: the rows of a session pass sorted through one task, which keeps
    three hash states.
    """
    ordered = (events.select("session_id", "seq", F.coalesce("path", F.lit("")).alias("path"))
               .repartition("session_id").sortWithinPartitions("session_id", "seq"))
    return ordered.select("session_id", "path").mapInArrow(_sequence_hashes, ", ".join(f"{name} string" for name in _SIGNATURES))


def session_metadata(events: DataFrame) -> DataFrame:
    """Summary plus agent cues, first-request cues and path signatures."""
    has = events.columns
    optional = lambda name, default: F.col(name) if name in has else F.lit(default)
    explicit_family = blank_to_null(optional("bot_family", None).cast("string"))
    base = _grouped(events, {
        "_family": _first(explicit_family),
        "_method": _first(blank_to_null(optional("method", None).cast("string"))),
        "_status": _first("status_code"),
        "_bytes": _first(double_or_zero(optional("body_bytes_sent", 0.0).cast("string"))),
        "first_category": _first("page_category"),
    })
    agent = F.coalesce("user_agent", F.lit(""))
    family = F.coalesce("_family", bot_family(agent, F.col("label")))
    described = base.withColumns({
        "ua_family": agent_family(agent),
        "bot_family": family,
        "has_suspect_user_agent": is_suspect_agent(agent).cast("double"),
        "ua_length": F.length(agent).cast("double"),
        "ua_slash_count": (F.length(agent) - F.length(F.replace(agent, F.lit("/"), F.lit("")))).cast("double"),
        "ua_browser_like": is_browser_like(agent).cast("double"),
        "first_path_depth": path_depth(F.col("first_path")).cast("double"),
        "first_method": F.upper(F.coalesce("_method", F.lit("GET"))),
        "first_status_code": F.coalesce("_status", F.lit(0)).cast("double"),
        "first_body_bytes_sent": F.coalesce("_bytes", F.lit(0.0)),
        "traffic_family": F.coalesce("traffic_family", family),
    }).drop("_family", "_method", "_status", "_bytes")
    return described.join(path_signatures(events), "session_id")


def add_missing_summary_columns(metadata: DataFrame, summary: DataFrame) -> DataFrame:
    """Metadata plus the summary columns it lacks; with none lacking, its NULLs are filled."""
    missing = [c for c in summary.columns if c not in metadata.columns]
    if missing:
        return metadata.join(summary.select("session_id", *missing), "session_id", "left")
    shared = [c for c in summary.columns if c != "session_id"]
    renamed = summary.select("session_id", *[F.col(c).alias(f"_summary_{c}") for c in shared])
    filled = {c: F.coalesce(c, f"_summary_{c}") for c in shared}
    return metadata.join(renamed, "session_id", "left").withColumns(filled).select(*metadata.columns)


def default_metadata(features: DataFrame) -> DataFrame:
    """Metadata when a caller has only feature rows: fixed values, the id as every signature."""
    last = last_prefix_rows(features).select("session_id", "label", F.col("prefix_len").alias("num_events"))
    texts = {"ua_family": "unknown", "bot_family": "generic_bot", "first_category": "unknown", "first_method": "GET"}
    empty = ["client_key", "ip", "user_agent", "first_path", *LABEL_METADATA]
    zeros = [
        "has_suspect_user_agent", "ua_length", "ua_slash_count", "ua_browser_like", "first_path_depth",
        "first_status_code", "first_body_bytes_sent", "start_timestamp", "end_timestamp",
        "duration_seconds", "referrer_present_ratio", "num_asset_requests", "asset_request_ratio",
    ]
    return last.withColumns({
        **{name: F.lit(value) for name, value in texts.items()},
        **{name: F.lit("") for name in empty},
        **{name: F.lit(0.0) for name in zeros},
        **{f"{name}_signature": F.col("session_id") for name in ("path", "prefix3", "prefix5")},
    })


def last_prefix_rows(features: DataFrame) -> DataFrame:
    """The row with the longest prefix of each session."""
    row = F.struct(*features.columns)
    return features.groupBy("session_id").agg(F.max_by(row, "prefix_len").alias("row")).select("row.*")


def session_paths(events: DataFrame) -> DataFrame:
    """Joined paths of each session: one row, as long as the session's own paths."""
    visits = F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda v: v["path"])
    return events.groupBy("session_id").agg(visits.alias("visits")).select(
        "session_id", F.array_join("visits", " > ").alias("path_signature"), F.array_join("visits", " | ").alias("paths"))


def session_manifest(events: DataFrame) -> DataFrame:
    """Human-readable list of imported sessions, one row each: summary, UTC times and paths."""
    return session_summary(events).join(session_paths(events), "session_id").select(
        "session_id", F.lit("human").alias("label"), *LABEL_METADATA, "client_key", "ip", "num_events",
        "duration_seconds", "unique_paths", "first_path",
        utc_text(F.col("start_timestamp")).alias("start_time_utc"),
        utc_text(F.col("end_timestamp")).alias("end_time_utc"),
        "path_signature", "paths", "user_agent",
    )
