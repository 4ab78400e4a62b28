"""Models, experiments and stored tables. Fitted models have no SQL counterpart, the conditions of their optimum have."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickwarden.operators import certificates, evaluation as ev, features as feats, splits, summary as summaries
from clickwarden.operators.models import MODELS, ModelBundle
from clickwarden.operators.scoring import rule_scores
from clickwarden.plans import experiment
from clickwarden.plans.prepare import prepare_dataset
from clickwarden.session import materialized
from clickwarden.sources.tables import load_or_build, prefix_table_name, read_table, write_results

from .common import label_table, labelled, rounded, site_nodes, stored_events
from .evaluation import _curves, _metric_select, baseline, curve_sql, dataset, heuristic_predictions, metrics_sql, share_sql
from .ingest import scratch
from .requests_view import PREFIXES, TIMEOUT, requests_view
from .sessions import feature_select
from .sql import CTES, query, r6

QUERIES, SQL = {}, {}
# sizes for the registered runs; the library defaults are 300 trees and 300 rounds
TREES, ROUNDS = 20, 10


def register(name, sql=None):
    def wrap(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function
    return wrap


def inputs(spark, sf):
    events = materialized(labelled(spark, sf)[0])
    nodes = materialized(site_nodes(events))
    known = lambda df: materialized(ev.known_labels(df))
    return (
        known(feats.prefix_features(events, nodes, PREFIXES)), known(feats.full_session_features(events, nodes)),
        known(summaries.session_metadata(events)),
    )


def split_data(spark, sf, with_metadata=False):
    """Feature rows by split, written once. Models need no more of the metadata than the key of the split, so the
    whole is made only for queries that read it."""
    if with_metadata:
        prefix, full, metadata = inputs(spark, sf)
        return experiment.SplitData.of(prefix, full, metadata, splits.bucket_split(metadata))
    events = materialized(labelled(spark, sf)[0])
    nodes = materialized(site_nodes(events))
    metadata = ev.known_labels(summaries.session_metadata(events))
    table = materialized(splits.bucket_split(metadata))
    by_split = lambda df: splits.with_split(ev.known_labels(df), table)
    return experiment.SplitData(
        materialized(by_split(feats.prefix_features(events, nodes, PREFIXES))),
        materialized(by_split(feats.full_session_features(events, nodes))), by_split(metadata),
    )


def model_query(name, model, **options):
    @register(name)
    def run(spark, sf):
        data = split_data(spark, sf)
        columns = feats.ablation_columns("all_features")
        predictions, _, _ = experiment.prefix_model_run(
            data, model, MODELS[model], columns, PREFIXES, "session_split", "all_features", **options)
        return rounded(ev.metrics_by_group(materialized(predictions)))


model_query("lr_experiment", "logistic_regression")
model_query("rf_experiment", "random_forest", trees=TREES)
model_query("gbt_experiment", "hist_gradient_boosting", rounds=ROUNDS)
model_query("svm_experiment", "calibrated_svm")


CTES["ltrain"] = "SELECT ff.*, CASE WHEN ff.label = 'bot' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side FROM ff JOIN bsplit USING (session_id) WHERE split = 'train'"
_COLUMNS = feats.ablation_columns("all_features")
# weights give bots half of the total, so a weighted mean over bots is half their mean
_moment = lambda c: (
    f"CASE WHEN stddev_samp({c}) > 1e-12::DOUBLE THEN 0.5::DOUBLE * (avg({c}) FILTER (label = 'bot') - avg({c})) / stddev_samp({c}) "
    "ELSE 0.0::DOUBLE END")


def training_rows(spark, sf):
    data = split_data(spark, sf)
    return data.part(data.full, "train")


@register("lr_certificate", query(
    f"SELECT feature, round(moment, 4) + 0.0 AS moment FROM (SELECT unnest({[certificates.INTERCEPT, *_COLUMNS]}) AS feature, "
    f"unnest(moments) AS moment FROM (SELECT [0.5::DOUBLE, {', '.join(map(_moment, _COLUMNS))}] AS moments FROM ltrain))"))
def lr_certificate(spark, sf):
    """The model's side of the optimality condition, from a stored and reloaded bundle; SQL has the rows' side."""
    training, path = training_rows(spark, sf), scratch(spark, "certified")
    ModelBundle("logistic_regression", _COLUMNS, MODELS["logistic_regression"](training, _COLUMNS)).save(path)
    bundle = ModelBundle.load(spark, path)
    moments = certificates.logistic_moments(bundle.model, training, bundle.feature_columns)
    return moments.select("feature", (F.round("model_moment", 4) + F.lit(0.0)).alias("moment"))


@register("svm_certificate", query(
    "SELECT fold, count(*) AS num_rows, round(count(*) FILTER (label = 'bot'), 3)::DOUBLE AS expected_bots "
    f"FROM (SELECT *, CAST(floor({share_sql('session_id', 'fold')} * 3) AS BIGINT) AS fold FROM ltrain) GROUP BY fold"))
def svm_certificate(spark, sf):
    """Bots that each fold's sigmoid expects in it; SQL counts them."""
    training = training_rows(spark, sf)
    moments = certificates.sigmoid_moments(MODELS["calibrated_svm"](training, _COLUMNS), training)
    return moments.select("fold", "num_rows", (F.round("expected_bots", 3) + F.lit(0.0)).alias("expected_bots"))


@register("gbt_certificate", query(
    f"SELECT count(*) AS num_rows, {r6('sum(side)')} AS answer_sum, "
    f"{r6('count(*) - sum(side) * sum(side) / count(*)')} AS squares FROM ltrain"))
def gbt_certificate(spark, sf):
    """Leaf answers of the first boosted tree over the rows in its leaves; SQL has the classes' sums."""
    training = training_rows(spark, sf)
    # the first tree is the same however many follow
    fitted = MODELS["hist_gradient_boosting"](training, _COLUMNS, rounds=1)
    return rounded(certificates.tree_balance(certificates.first_tree_leaves(fitted, training)))


@register("static_baseline")
def static_baseline(spark, sf):
    run = experiment.static_run(split_data(spark, sf, with_metadata=True), "session_split")
    return rounded(ev.metrics_by_group(materialized(run)))


@register("full_session_baseline")
def full_session_baseline(spark, sf):
    data = split_data(spark, sf)
    columns = feats.ablation_columns("all_features")
    _, fitted, threshold = experiment.prefix_model_run(
        data, "logistic_regression", MODELS["logistic_regression"], columns, PREFIXES, "session_split", "all_features")
    run = materialized(experiment.full_session_run(data, "logistic_regression", fitted, threshold, "session_split"))
    return rounded(ev.leaderboard(run))


@register("experiment_grid")
def experiment_grid(spark, sf):
    prefix, full, metadata = inputs(spark, sf)
    tables = experiment.run_experiments(
        prefix, metadata=metadata, full_features=full, prefixes=PREFIXES, protocols=["session_split", "time_split"],
        models=["logistic_regression"], ablations=["all_features", "entropy_only"], n_bootstrap=20)
    return rounded(tables["leaderboard"])


@register("train_by_prefix")
def train_by_prefix(spark, sf):
    prefix, _, _ = inputs(spark, sf)
    predictions, _ = experiment.train_by_prefix(prefix, PREFIXES, ["logistic_regression"])
    return rounded(ev.metrics_by_group(predictions, ["model_name", "prefix_len"]))


@register("model_roundtrip")
def model_roundtrip(spark, sf):
    prefix, _, _ = inputs(spark, sf)
    _, bundles = experiment.train_by_prefix(prefix, PREFIXES, ["logistic_regression"])
    path = scratch(spark, "bundle")
    bundles["logistic_regression"].save(path)
    return rounded(ModelBundle.load(spark, path).predict(prefix))


@register("prepared_dataset", query(
    "SELECT proposed_label, count(*) AS num_sessions FROM labelled_summary GROUP BY proposed_label"))
def prepared_dataset(spark, sf):
    return prepare_dataset(
        spark, requests_view(spark, sf), scratch(spark, "prepared"), labels=label_table(spark, sf), timeout=TIMEOUT,
        tie_breaker="event_id")


@register("feature_tables", query(feature_select("pf")))
def feature_tables(spark, sf):
    events = materialized(labelled(spark, sf)[0])
    folder, name = scratch(spark, "features"), prefix_table_name(PREFIXES)
    build = lambda: feats.prefix_features(events, site_nodes(events), PREFIXES)
    load_or_build(spark, folder, name, build)
    return rounded(load_or_build(spark, folder, name, build))


_RULE_RUN = {
    "protocol": "session_split", "model_name": "heuristic_rules", "ablation_name": "heuristic_baseline",
    "notes": "entropy+timing+ua heuristics"}


@register("experiment_tables", query(
    f"SELECT {', '.join(f"'{value}' AS {name}" for name, value in _RULE_RUN.items())}, prefix_len, {_metric_select}, {_curves} "
    f"FROM ({metrics_sql('hb_pred', 'prefix_len')}) JOIN ({curve_sql('hb_pred', 'prefix_len')}) USING (prefix_len)",
    baseline("bsplit", "hb")))
def experiment_tables(spark, sf):
    _, metadata, prefix = dataset(spark, sf)
    scored = materialized(rule_scores(prefix, metadata).withColumn("bot_probability", F.round("bot_probability", 10)))
    decided = heuristic_predictions(scored, materialized(splits.bucket_split(metadata)))
    predictions = materialized(decided.select(*[F.lit(v).alias(k) for k, v in _RULE_RUN.items()], "*"))
    folder = scratch(spark, "results")
    write_results({
        "predictions": predictions, "metrics": ev.metrics_by_group(predictions, [*experiment.RUN, "prefix_len"]),
        "detection_delay": ev.detection_delay(predictions, experiment.RUN), "leaderboard": ev.leaderboard(predictions),
    }, folder)
    return rounded(read_table(spark, folder, "metrics"))
