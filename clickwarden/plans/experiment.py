"""Experiments: models and baselines over splits, with their metrics and audits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    ABLATIONS, ENTROPY_VARIANTS, FULL_SESSION_PREFIX, HARD_PREFIXES, HOLDOUT_ABLATIONS, PREFIXES, PROTOCOLS,
)
from ..operators import audits, splits as cuts
from ..operators.evaluation import (
    bootstrap_intervals, detection_delay, known_labels, leaderboard, metrics_by_group, tune_threshold, tune_thresholds,
)
from ..operators.features import ablation_columns
from ..operators.models import FittedModel, ModelBundle, fit_static_baseline, select_models, static_feature_rows
from ..operators.scoring import PREDICTION_COLUMNS, decide, decide_by_prefix, rule_scores, spread_session_scores
from ..operators.summary import default_metadata, last_prefix_rows
from ..session import materialized

RUN = ["protocol", "model_name", "ablation_name", "notes"]


@dataclass
class SplitData:
    """Feature and metadata rows of one split table."""

    prefix: DataFrame
    full: DataFrame
    metadata: DataFrame

    @classmethod
    def of(cls, prefix: DataFrame, full: DataFrame, metadata: DataFrame, table: DataFrame) -> "SplitData":
        return cls(*(materialized(cuts.with_split(df, table)) for df in (prefix, full, metadata)))

    def part(self, rows: DataFrame, split: str) -> DataFrame:
        return rows.where(F.col("split") == split).drop("split")

    def can_train(self, rows: DataFrame) -> bool:
        """Both classes in train and validation, and something to test."""
        seen = {r["split"]: r["labels"] for r in rows.groupBy("split").agg(F.count_distinct("label").alias("labels")).collect()}
        return seen.get("train", 0) > 1 and seen.get("val", 0) > 1 and seen.get("test", 0) > 0


def _tagged(predictions: DataFrame, protocol: str, model: str, ablation: str, notes: str, report_prefix: Column | None = None) -> DataFrame:
    report = F.col("prefix_len") if report_prefix is None else report_prefix
    return predictions.select(
        F.lit(protocol).alias("protocol"), F.lit(model).alias("model_name"), F.lit(ablation).alias("ablation_name"),
        F.lit(notes).alias("notes"), *PREDICTION_COLUMNS, report.cast("int").alias("report_prefix"),
    )


def _joined_notes(notes: str, own: str) -> str:
    return f"{notes}; {own}" if notes else own


def prefix_model_run(
    data: SplitData, name: str, fit, columns: Sequence[str], prefixes: Iterable[int], protocol: str, ablation: str, notes: str = "", **options
) -> tuple[DataFrame, FittedModel, float]:
    """Fit on whole training sessions, tune on validation, decide on test prefixes.

    Returns the predictions, the model and the threshold of the longest tuned prefix.
    """
    lengths = list(prefixes)
    fitted = fit(data.part(data.full, "train"), columns, **options)
    default = tune_threshold(fitted.score(data.part(data.full, "val")))
    at_prefix = data.prefix.where(F.col("prefix_len").isin(lengths))
    thresholds = materialized(tune_thresholds(fitted.score(data.part(at_prefix, "val")), default=default))
    predictions = decide_by_prefix(fitted.score(data.part(at_prefix, "test")), thresholds, default)
    longest = thresholds.agg(F.max_by("threshold", "prefix_len")).head()[0]
    return _tagged(predictions, protocol, name, ablation, notes), fitted, 0.5 if longest is None else float(longest)


def full_session_run(data: SplitData, name: str, fitted: FittedModel, threshold: float, protocol: str, notes: str = "") -> DataFrame:
    """The same model allowed to decide only when a test session is complete."""
    decided = decide(fitted.score(data.part(data.full, "test")), F.lit(threshold))
    own = _joined_notes(notes, "decision allowed only after session completion")
    return _tagged(decided, f"{protocol}_full_session_only", name, "full_session_baseline", own, F.lit(FULL_SESSION_PREFIX))


def rule_run(data: SplitData, protocol: str, notes: str = "") -> DataFrame:
    """Rule score with thresholds tuned on validation."""
    val = materialized(rule_scores(data.part(data.prefix, "val"), data.metadata))
    default = tune_threshold(last_prefix_rows(val))
    scored = rule_scores(data.part(data.prefix, "test"), data.metadata)
    predictions = decide_by_prefix(scored, tune_thresholds(val, default=default), default)
    return _tagged(predictions, protocol, "heuristic_rules", "heuristic_baseline", _joined_notes(notes, "entropy+timing+ua heuristics"))


def static_run(data: SplitData, protocol: str, notes: str = "") -> DataFrame:
    """First-request cues only: one score per session, one threshold, all prefixes."""
    fitted = fit_static_baseline(data.part(data.metadata, "train"))
    score = lambda split: fitted.score(static_feature_rows(data.part(data.metadata, split)), ["session_id", "label"])
    threshold = tune_threshold(score("val"))
    spread = spread_session_scores(data.part(data.prefix, "test"), score("test"))
    predictions = decide(spread, threshold)
    own = _joined_notes(notes, "first-request and header-like features only")
    return _tagged(predictions, protocol, "static_logistic_regression", "static_request_baseline", own)


def split_suite(
    data: SplitData, protocol: str, prefixes: Iterable[int], models: Iterable[str] | None = None,
    ablations: Iterable[str] = tuple(ABLATIONS), notes: str = "", model_folder: str | None = None, **options,
) -> list[DataFrame]:
    """All models and ablations and the three baselines on one split."""
    lengths, runs = list(prefixes), []
    if data.can_train(data.full):
        for ablation in ablations:
            columns = ablation_columns(ablation, data.full.columns)
            for name, fit in select_models(models).items():
                run, fitted, threshold = prefix_model_run(data, name, fit, columns, lengths, protocol, ablation, notes, **options)
                runs.append(run)
                if model_folder:
                    bundle = ModelBundle(f"{name}_{ablation}", columns, fitted, threshold)
                    bundle.save(f"{model_folder}/{protocol}__{name}__{ablation}")
                if ablation == "all_features":
                    runs.append(full_session_run(data, name, fitted, threshold, protocol, notes))
    test_prefix = SplitData(data.prefix.where(F.col("prefix_len").isin(lengths)), data.full, data.metadata)
    runs.append(rule_run(test_prefix, protocol, notes))
    if data.can_train(data.metadata):
        runs.append(static_run(test_prefix, protocol, notes))
    return runs


def run_experiments(
    prefix_features: DataFrame, *, metadata: DataFrame | None = None, full_features: DataFrame | None = None,
    prefixes: Iterable[int] = PREFIXES, protocols: Iterable[str] = PROTOCOLS, models: Iterable[str] | None = None,
    ablations: Iterable[str] = tuple(ABLATIONS), hard_prefixes: Iterable[int] = HARD_PREFIXES,
    entropy_variants: Sequence[str] = ENTROPY_VARIANTS, group_key: str = "path_signature", n_bootstrap: int = 300,
    holdout_folds: int = 10, model_folder: str | None = None, **options,
) -> dict[str, DataFrame]:
    """Result tables of the whole grid.

    A hold-out protocol holds out one family or participant at a time while there are at most
    ``holdout_folds``; more are dealt to that many folds of like size, each held out once.
    """
    lengths, protocols = sorted(set(prefixes)), list(protocols)
    prefix = materialized(known_labels(prefix_features))
    meta = materialized(known_labels(metadata if metadata is not None else default_metadata(prefix)))
    full = materialized(known_labels(full_features if full_features is not None else last_prefix_rows(prefix)))
    hard = [p for p in sorted(set(hard_prefixes)) if p in lengths]
    runs: list[DataFrame] = []
    summaries: list[DataFrame] = []
    leakages: list[DataFrame] = []

    def use(table: DataFrame, protocol: str, note: str = "") -> SplitData:
        table = materialized(table)
        tag = [F.lit(protocol).alias("protocol"), F.lit(note).alias("note")]
        summaries.append(cuts.split_summary(meta, table).select(*tag, "*"))
        leakages.append(audits.leakage_audit(meta, table, group_key).select(*tag, "*"))
        return SplitData.of(prefix, full, meta, table)

    if {"session_split", "hard_prefix_session_split"} & set(protocols):
        has_group = group_key in meta.columns
        table = cuts.grouped_split(meta, group_key) if has_group else cuts.stratified_split(meta)
        data = use(table, "session_split")
        if "session_split" in protocols:
            runs += split_suite(data, "session_split", lengths, models, ablations, model_folder=model_folder, **options)
        if "hard_prefix_session_split" in protocols and hard:
            runs += split_suite(data, "hard_prefix_session_split", hard, models, ablations, **options)
    fewer = [a for a in ablations if a in HOLDOUT_ABLATIONS]
    if "time_split" in protocols and "start_timestamp" in meta.columns:
        table = materialized(cuts.time_split(meta))
        if not table.isEmpty():
            runs += split_suite(use(table, "time_split"), "time_split", lengths, models, fewer, **options)
    for protocol, key, eligible, note in (
        ("leave_one_bot_family_out", "bot_family", cuts.family_holdouts, "held_out_family"),
        ("leave_one_human_user_out", "participant_id", cuts.participant_holdouts, "held_out_participant"),
    ):
        if protocol in protocols:
            dealt = cuts.in_folds(meta, key, holdout_folds)
            base = materialized(cuts.holdout_base(dealt, key))
            # at most as many rows as folds
            for row in eligible(dealt).select("held_out").orderBy("held_out").collect():
                data = use(cuts.holdout_split(base, row["held_out"]), protocol, row["held_out"])
                runs += split_suite(data, protocol, lengths, models, fewer, f"{note}={row['held_out']}", **options)

    predictions = materialized(_union(runs))
    reported = predictions.withColumn("prefix_len", F.col("report_prefix"))
    board_keys = [*RUN, "prefix_len"]
    flags = audits.shortcut_red_flags(audits.with_navigation_scores(meta, full))
    return {
        "predictions": predictions,
        "metrics": metrics_by_group(reported, board_keys),
        "confidence_intervals": bootstrap_intervals(reported, board_keys, n_bootstrap),
        "detection_delay": detection_delay(predictions, RUN),
        "leaderboard": leaderboard(predictions, RUN),
        "split_summary": _union(summaries),
        "leakage_audit": _union(leakages),
        "shortcut_audit": audits.shortcut_audit(meta, full),
        "shortcut_red_flags": flags,
        "entropy_variant_comparison": audits.entropy_variant_comparison(prefix, hard or lengths[:3], entropy_variants),
    }


def train_by_prefix(
    features: DataFrame, prefixes: Iterable[int] = PREFIXES, models: Iterable[str] | None = None, threshold: float = 0.5, **options
) -> tuple[DataFrame, dict[str, ModelBundle]]:
    """Baseline training: last prefix rows of 70 % of sessions, decisions on the other 30 %."""
    rows = materialized(known_labels(features))
    table = cuts.train_test_split(rows.select("session_id").distinct())
    joined = materialized(cuts.with_split(rows, table))
    train = last_prefix_rows(joined.where(F.col("split") == "train").drop("split"))
    test = joined.where((F.col("split") == "test") & F.col("prefix_len").isin(list(prefixes))).drop("split")
    columns = ablation_columns("all_features", rows.columns)
    runs, bundles = [], {}
    for name, fit in select_models(models).items():
        fitted = fit(train, columns, **options)
        bundles[name] = ModelBundle(name, columns, fitted, threshold)
        decided = decide(fitted.score(test), F.lit(threshold))
        runs.append(_tagged(decided, "train_test", name, "all_features", ""))
    return materialized(_union(runs)), bundles


def _union(frames: list[DataFrame]) -> DataFrame:
    """All frames in one, joined pairwise so the plan stays shallow."""
    while len(frames) > 1:
        paired = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])]
        frames = paired + (frames[-1:] if len(frames) % 2 else [])
    return frames[0]
