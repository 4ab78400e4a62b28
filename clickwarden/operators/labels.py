"""Manual labels, weak rules and label files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    BOT, HUMAN, LABEL_COLUMNS, LABEL_METADATA, TEMPLATE_COLUMNS, UNKNOWN, WEAK_BOT_ALONE,
    WEAK_BOT_WITH_AGENT, WEAK_HUMAN, WEAK_SCORE_STEPS,
)
from ..functions.agents import is_suspect_agent
from ..functions.values import blank_to_null
from .ranking import with_global_row_number
from .summary import session_summary


def manual_labels(df: DataFrame) -> DataFrame:
    """Label rows in canonical form: lower-case labels, missing columns and blanks as NULL."""
    if "label" not in df.columns or not {"client_key", "session_id"} & set(df.columns):
        raise ValueError("labels need a label column and a client_key or session_id column")
    optional = lambda name: blank_to_null(F.col(name)) if name in df.columns else F.lit(None).cast("string")
    return df.select(
        optional("client_key").alias("client_key"),
        optional("session_id").alias("session_id"),
        F.lower(blank_to_null(F.col("label"))).alias("label"),
        *[optional(name).alias(name) for name in LABEL_METADATA],
    )


def _labels_by(labels: DataFrame, key: str) -> DataFrame:
    """One row per key; a key that occurs twice fails the job."""
    values = {"label": "_label", **{c: f"_{c}" for c in LABEL_METADATA}}
    message = F.concat(F.lit(f"duplicate label rows for {key} "), F.col(key))
    checked = F.when(F.col("_n") > 1, F.raise_error(message).cast("string")).otherwise(F.col("_label"))
    return (
        labels.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_n"), *[F.max(c).alias(name) for c, name in values.items()])
        .withColumn("_label", checked)
        .drop("_n")
    )


def join_manual_labels(summary: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``manual_label`` and fill missing metadata; the client's label outranks the session's."""
    result = summary.withColumn("manual_label", F.lit(None).cast("string"))
    for key in ("client_key", "session_id"):
        result = result.join(_labels_by(labels, key), key, "left").withColumns({
            "manual_label": F.coalesce("manual_label", "_label"),
            **{c: F.coalesce(c, f"_{c}") for c in LABEL_METADATA},
        }).drop("_label", *[f"_{c}" for c in LABEL_METADATA])
    return result.select(*summary.columns, "manual_label")


def weak_bot_score(suspect: Column) -> Column:
    """Rule score in [0, 1] of a session summary row."""
    step = lambda name, condition: F.when(condition, F.lit(WEAK_SCORE_STEPS[name])).otherwise(F.lit(0.0))
    events = F.col("num_events")
    score = (
        step("suspect_agent", suspect)
        + step("fast", F.col("mean_delta_t") <= 1.0)
        + step("long", events >= 20)
        + step("mostly_new", F.col("unique_path_ratio") >= 0.90)
        + step("few_categories", (F.col("page_categories") <= 2) & (events >= 10))
    )
    return F.least(score, F.lit(1.0))


def proposed_label() -> Column:
    """Manual label, else the rules on agent and weak score, else unknown."""
    score = F.col("weak_bot_score")
    return (
        F.when(blank_to_null(F.col("manual_label")).isNotNull(), F.lower(blank_to_null(F.col("manual_label"))))
        .when(F.col("suspicious_user_agent") & (score >= WEAK_BOT_WITH_AGENT), BOT)
        .when(score >= WEAK_BOT_ALONE, BOT)
        .when((score <= WEAK_HUMAN) & (F.col("num_events") >= 3), HUMAN)
        .otherwise(UNKNOWN)
    )


def label_summary(summary: DataFrame, labels: DataFrame | None = None, agent_patterns: Sequence[str] | None = None) -> DataFrame:
    """Summary with manual label, agent flag, weak score and proposed label."""
    if labels is None:
        merged = summary.withColumn("manual_label", F.lit(None).cast("string"))
    else:
        merged = join_manual_labels(summary, labels)
    patterns = list(agent_patterns) if agent_patterns else None
    return (
        merged.withColumn("suspicious_user_agent", is_suspect_agent(F.col("user_agent"), patterns))
        .withColumn("weak_bot_score", weak_bot_score(F.col("suspicious_user_agent")))
        .withColumn("proposed_label", proposed_label())
    )


def apply_session_labels(
    events: DataFrame, labels: DataFrame | None = None, agent_patterns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Labelled events and the labelled summary."""
    summary = label_summary(session_summary(events), labels, agent_patterns)
    return label_events(events, summary), summary


def label_events(events: DataFrame, summary: DataFrame) -> DataFrame:
    """Events with the proposed label and the metadata of their session."""
    chosen = summary.select(
        "session_id", F.col("proposed_label").alias("_label"),
        *[F.col(c).alias(f"_{c}") for c in LABEL_METADATA],
    )
    own = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    return (
        events.join(chosen, "session_id")
        .withColumns({"label": F.col("_label"), **{c: F.coalesce(f"_{c}", own(c)) for c in LABEL_METADATA}})
        .drop("_label", *[f"_{c}" for c in LABEL_METADATA])
    )


def proposed_label_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("proposed_label").agg(F.count("*").alias("num_sessions"))


def _label_key() -> Column:
    return F.coalesce(blank_to_null(F.col("client_key")), blank_to_null(F.col("session_id")))


def upsert_labels(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Label rows by key: non-blank new values overwrite, later rows win, keyless rows are dropped.

    ``order`` names the column that orders the rows inside each input.
    """
    def keyed(df: DataFrame) -> DataFrame:
        missing = {c: F.lit("") for c in LABEL_COLUMNS if c not in df.columns}
        return df.withColumns(missing).withColumn("_key", _label_key()).where(F.col("_key").isNotNull())

    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    old = keyed(existing).groupBy("_key").agg(
        F.max_by(F.struct(*[filled(c).alias(c) for c in LABEL_COLUMNS]), order).alias("old")
    )
    latest = lambda c: F.max_by(c, F.when(filled(c) != "", F.col(order)))
    fresh = keyed(new).groupBy("_key").agg(*[latest(c).alias(f"new_{c}") for c in LABEL_COLUMNS])
    return old.join(fresh, "_key", "full_outer").select(
        *[F.coalesce(f"new_{c}", f"old.{c}", F.lit("")).alias(c) for c in LABEL_COLUMNS]
    )


def annotation_template(summary: DataFrame, only_unknown: bool = False, keep_labels: bool = False) -> DataFrame:
    """Sheet for hand labelling: fixed columns, labels blank unless kept."""
    df = summary
    if only_unknown and "proposed_label" in df.columns:
        df = df.where(F.lower(F.coalesce("proposed_label", F.lit(""))) == UNKNOWN)
    if not keep_labels or "label" not in df.columns:
        df = df.withColumn("label", F.lit(""))
    missing = {c: F.lit("") for c in TEMPLATE_COLUMNS if c not in df.columns}
    return df.withColumns(missing).select(*TEMPLATE_COLUMNS).orderBy("participant_id", "session_id")


def number_participants(events: DataFrame, prefix: str = "human_manual") -> DataFrame:
    """One participant id per session, in order of start time and session id."""
    starts = events.where(F.col("seq") == 1).select("session_id", F.col("timestamp").alias("start_timestamp"))
    numbered = with_global_row_number(starts, [F.col("start_timestamp"), F.col("session_id")], "number")
    return numbered.select(
        "session_id", "start_timestamp",
        F.concat(F.lit(f"{prefix}_"), F.format_string("%03d", "number")).alias("participant_id"),
    )
