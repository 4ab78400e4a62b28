"""Audits of splits and cues: leakage, shortcuts and entropy variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import (
    BOT, CATEGORICAL_CUES, CLASS_SUMMARY_METRICS, ENTROPY_VARIANTS, FLAG_HIGH, FLAG_MEDIUM,
    HARD_PREFIXES, HUMAN, LEAKAGE_KEYS, MIN_CUE_SUPPORT, NUMERIC_CUES, TOP_VALUE_COLUMNS,
)
from ..functions.values import double_or_zero, stripped
from .evaluation import curve_metrics, known_labels, score_counts
from .splits import with_split

SPLIT_PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]
EXAMPLES = 5


def leakage_audit(metadata: DataFrame, splits: DataFrame, group_key: str = "path_signature", keys: Sequence[str] = LEAKAGE_KEYS) -> DataFrame:
    """Values of session, client, signature and group keys that two splits share."""
    joined = with_split(metadata, splits)
    audited = {key: key for key in keys if key in joined.columns}
    if group_key in joined.columns:
        audited[f"group_key:{group_key}"] = group_key
    values = joined.select("split", F.explode(F.array(*[
        F.struct(F.lit(name).alias("key"), stripped(F.col(column)).alias("value")) for name, column in audited.items()
    ])).alias("kv")).select("split", "kv.*")
    present = values.where((F.col("value") != "") & (F.lower("value") != "nan")).groupBy("key", "value").agg(
        *[F.max(F.col("split") == name).alias(name) for name in ("train", "val", "test")]
    )
    pairs = F.array_compact(F.array(*[
        F.when(F.col(a) & F.col(b), F.lit(f"{a}_vs_{b}")) for a, b in SPLIT_PAIRS
    ]))
    shared = present.select("key", "value", F.explode(pairs).alias("split_pair"))
    counts = shared.groupBy("split_pair", "key").agg(F.count("*").alias("shared_count"))
    first = Window.partitionBy("split_pair", "key").orderBy("value")
    examples = (
        shared.withColumn("place", F.row_number().over(first)).where(F.col("place") <= EXAMPLES)
        .groupBy("split_pair", "key")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), "; ").alias("examples"))
    )
    # every pair and key is reported, also without overlap
    spark = metadata.sparkSession
    report = spark.createDataFrame(
        [(f"{a}_vs_{b}", key) for a, b in SPLIT_PAIRS for key in audited], "split_pair string, key string"
    )
    return (
        report.join(counts, ["split_pair", "key"], "left").join(examples, ["split_pair", "key"], "left")
        .select("split_pair", "key", F.coalesce("shared_count", F.lit(0)).alias("shared_count"),
                F.coalesce("examples", F.lit("")).alias("examples"))
    )


def with_navigation_scores(metadata: DataFrame, full_features: DataFrame) -> DataFrame:
    scores = [c for c in ("navigation_entropy_score", "navigation_entropy_score_v2") if c in full_features.columns]
    return metadata.join(full_features.select("session_id", *scores), "session_id", "left")


def shortcut_audit(metadata: DataFrame, full_features: DataFrame) -> DataFrame:
    """Per label: class means and the most frequent values of three cues, in long form."""
    enriched = with_navigation_scores(metadata, full_features)
    metrics = {m: c for m, c in CLASS_SUMMARY_METRICS.items() if c in enriched.columns}
    means = enriched.groupBy("label").agg(
        F.count("*").cast("double").alias("num_sessions"),
        *[F.avg(F.col(c).cast("double")).alias(m) for m, c in metrics.items()],
    )
    summary = means.unpivot(["label"], ["num_sessions", *metrics], "metric", "value").select(
        F.lit("class_summary").alias("section"), "label", "metric", "value"
    )
    columns = [c for c in TOP_VALUE_COLUMNS if c in enriched.columns]
    values = enriched.select("label", F.explode(F.array(*[
        F.struct(F.lit(f"top_{c}").alias("section"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("metric"))
        for c in columns
    ])).alias("v")).select("label", "v.*")
    counts = values.groupBy("section", "label", "metric").agg(F.count("*").cast("double").alias("value"))
    frequent = Window.partitionBy("section", "label").orderBy(F.desc("value"), "metric")
    top = counts.withColumn("place", F.row_number().over(frequent)).where(F.col("place") <= 5).drop("place")
    return summary.unionByName(top)


def flag_level(strength: Column) -> Column:
    return F.when(strength >= FLAG_HIGH, "high").when(strength >= FLAG_MEDIUM, "medium").otherwise("low")


def numeric_red_flags(metadata: DataFrame, cues: Sequence[str] = NUMERIC_CUES) -> DataFrame:
    """How well each numeric cue alone separates the classes."""
    cues = [c for c in cues if c in metadata.columns]
    long = metadata.select("label", *[double_or_zero(F.col(c)).alias(c) for c in cues]).unpivot(
        ["label"], cues, "cue_name", "value"
    )
    is_bot = F.col("label") == BOT
    means = long.groupBy("cue_name").agg(
        F.count("*").alias("support"),
        F.avg(F.when(~is_bot, F.col("value"))).alias("human_mean"),
        F.avg(F.when(is_bot, F.col("value"))).alias("bot_mean"),
        (F.min("value") < F.max("value")).alias("varies"),
    )
    auc = curve_metrics(score_counts(long, ["cue_name"], "value"), ["cue_name"])
    strength = F.greatest(F.col("roc_auc"), 1.0 - F.col("roc_auc"))
    return means.join(auc, "cue_name").where(F.col("varies") & F.col("roc_auc").isNotNull()).select(
        F.lit("numeric").alias("cue_type"), "cue_name", "support", strength.alias("signal_strength"),
        "human_mean", "bot_mean", flag_level(strength).alias("flag_level"),
        F.lit("single-feature separability").alias("details"),
    )


def categorical_red_flags(metadata: DataFrame, cues: Sequence[str] = CATEGORICAL_CUES) -> DataFrame:
    """How pure each value of a categorical cue is in one class; NULL is a value."""
    cues = [c for c in cues if c in metadata.columns]
    long = metadata.select("label", F.explode(F.array(*[
        F.struct(F.lit(c).alias("cue"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for c in cues
    ])).alias("v")).select("label", "v.*")
    rate = F.col("bots") / F.col("support")
    purity = F.greatest(rate, 1.0 - rate)
    return (
        long.groupBy("cue", "value")
        .agg(F.count("*").alias("support"), F.count_if(F.col("label") == BOT).alias("bots"))
        .where(F.col("support") >= MIN_CUE_SUPPORT)
        .select(
            F.lit("categorical").alias("cue_type"), F.concat("cue", F.lit("="), "value").alias("cue_name"), "support",
            purity.alias("signal_strength"), F.lit(None).cast("double").alias("human_mean"),
            F.lit(None).cast("double").alias("bot_mean"), flag_level(purity).alias("flag_level"),
            F.format_string("class_purity=%.3f; bot_rate=%.3f", purity, rate).alias("details"),
        )
    )


def shortcut_red_flags(metadata: DataFrame) -> DataFrame:
    """All cues, ordered by flag text, then strength and support."""
    flags = numeric_red_flags(metadata).unionByName(categorical_red_flags(metadata))
    rank = F.when(F.col("flag_level") == "high", 1).when(F.col("flag_level") == "medium", 2).otherwise(3)
    return flags.withColumn("flag_rank", rank).orderBy(
        "flag_level", F.desc("signal_strength"), F.desc("support"), "cue_name"
    )


def entropy_variant_comparison(features: DataFrame, prefixes: Sequence[int] = HARD_PREFIXES, variants: Sequence[str] = ENTROPY_VARIANTS) -> DataFrame:
    """Per feature and prefix: AUC, class means and their gap; then the mean AUC over prefixes."""
    variants = [c for c in variants if c in features.columns]
    rows = known_labels(features).where(F.col("prefix_len").isin(list(prefixes)))
    long = rows.select("prefix_len", "label", *[double_or_zero(F.col(c)).alias(c) for c in variants]).unpivot(
        ["prefix_len", "label"], variants, "feature", "value"
    )
    keys = ["feature", "prefix_len"]
    means = long.groupBy(*keys).agg(
        F.avg(F.when(F.col("label") != BOT, F.col("value"))).alias("human_mean"),
        F.avg(F.when(F.col("label") == BOT, F.col("value"))).alias("bot_mean"),
    )
    auc = curve_metrics(score_counts(long, keys, "value"), keys)
    compared = means.join(auc, keys).select(
        "feature", "prefix_len", "roc_auc", "human_mean", "bot_mean",
        F.abs(F.col("bot_mean") - F.col("human_mean")).alias("absolute_gap"),
    )
    nothing = lambda name: F.lit(None).cast("double").alias(name)
    mean_rows = compared.where(F.col("roc_auc").isNotNull()).groupBy("feature").agg(F.avg("roc_auc").alias("roc_auc")).select(
        "feature", F.lit("mean").alias("prefix_len"), "roc_auc", nothing("human_mean"), nothing("bot_mean"), nothing("absolute_gap")
    )
    per_prefix = compared.withColumn("prefix_len", F.col("prefix_len").cast("string"))
    order = F.when(F.col("prefix_len") == "mean", 999).otherwise(F.col("prefix_len").try_cast("int"))
    return per_prefix.unionByName(mean_rows).orderBy(order, F.desc_nulls_last("roc_auc"), F.desc_nulls_last("absolute_gap"))
