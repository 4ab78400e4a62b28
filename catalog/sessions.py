"""Sessions, labels, graph and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from clickwarden.constants import ABLATIONS, FEATURE_COLUMNS
from clickwarden.operators import features as feats, graph as graphs, labels as labelling, summary as summaries

from clickwarden.operators.scoring import spread_session_scores
from clickwarden.session import materialized

from .common import (
    all_events, early_and_all, full_feature_rows, label_table, labelled, page_events,
    prefix_feature_rows, rounded, site_nodes,
)
from .ingest import scratch
from .requests_view import PREFIXES
from .sql import METADATA, query, r6

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def wrap(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function
    return wrap


SUMMARY_DOUBLES = [
    "start_timestamp", "end_timestamp", "duration_seconds", "unique_path_ratio", "mean_delta_t",
    "referrer_present_ratio", "raw_referrer_ratio", "asset_request_ratio", "has_asset_requests",
]
_summary_select = "* REPLACE (" + ", ".join(f"{r6(c)} AS {c}" for c in SUMMARY_DOUBLES) + ")"


@register("session_summary", query(f"SELECT {_summary_select} FROM summary"))
def session_summary(spark, sf):
    return rounded(summaries.session_summary(page_events(spark, sf)))


_EVENT_COLUMNS = [
    "event_id", "session_id", "session_index", "seq", "n_events", "timestamp", "path", "delta_t",
    "page_category", "referrer", "raw_referrer", "user_agent", "status_code", "prev_path", "prev2_path",
    "prev_category", "prev_user_agent",
]


@register("sessionize", query(
    f"SELECT {', '.join(c for c in _EVENT_COLUMNS if c not in ('timestamp', 'delta_t'))}, "
    f"{r6('timestamp')} AS timestamp, {r6('delta_t')} AS delta_t FROM ev"))
def sessionize(spark, sf):
    return rounded(page_events(spark, sf).select(*_EVENT_COLUMNS))


_ENRICH = ", ".join(
    f"{r6('a.' + c) if c not in ('first_path', 'num_page_requests', 'num_asset_requests') else 'a.' + c} AS {c}_all_requests"
    for c in summaries.ENRICHMENT_COLUMNS
)


@register("all_request_enrichment", query(
    f"SELECT s.session_id, s.num_events, {_ENRICH}, s.start_timestamp = a.start_timestamp AS same_start "
    "FROM summary s LEFT JOIN all_summary a USING (session_id)"))
def all_request_enrichment(spark, sf):
    joined = summaries.enrich_with_all_requests(
        summaries.session_summary(page_events(spark, sf)), summaries.session_summary(all_events(spark, sf)))
    extra = [f"{c}_all_requests" for c in summaries.ENRICHMENT_COLUMNS]
    return rounded(joined.select("session_id", "num_events", *extra, "same_start"))


_LABEL_SELECT = f"session_id, client_key, num_events, manual_label, suspicious_user_agent, " \
    f"{r6('weak_bot_score')} AS weak_bot_score, proposed_label, {', '.join(METADATA)}"


@register("manual_labels", query(
    f"SELECT session_id, client_key, manual_label, {', '.join(METADATA)} FROM weak"))
def manual_labels(spark, sf):
    merged = labelling.join_manual_labels(summaries.session_summary(page_events(spark, sf)), label_table(spark, sf))
    return merged.select("session_id", "client_key", "manual_label", *METADATA)


@register("session_level_labels", query(
    "SELECT s.session_id, s.client_key, coalesce(m.label, p.label) AS manual_label, s.participant_id, s.traffic_family, "
    "coalesce(s.collection_method, m.collection_method, p.collection_method) AS collection_method, s.automation_stack, "
    "coalesce(s.notes, p.notes) AS notes "
    "FROM summary s LEFT JOIN manual m USING (client_key) LEFT JOIN reviewed p USING (session_id)",
    {"reviewed": """
      SELECT session_id, CASE WHEN num_events % 2 = 1 THEN 'human' ELSE 'bot' END AS label,
        'review' AS collection_method, 'seen ' || num_events AS notes FROM summary WHERE num_events % 3 <> 0"""}))
def session_level_labels(spark, sf):
    summary = materialized(summaries.session_summary(page_events(spark, sf)))
    events = F.col("num_events")
    reviewed = labelling.manual_labels(summary.where(events % 3 != 0).select(
        "session_id", F.when(events % 2 == 1, " Human ").otherwise("BOT").alias("label"),
        F.lit("review").alias("collection_method"), F.concat(F.lit("seen "), events.cast("string")).alias("notes")))
    merged = labelling.join_manual_labels(summary, label_table(spark, sf).unionByName(reviewed))
    return merged.select("session_id", "client_key", "manual_label", *METADATA)


@register("weak_labels", query(f"SELECT {_LABEL_SELECT} FROM labelled_summary"))
def weak_labels(spark, sf):
    _, summary = labelled(spark, sf)
    return rounded(summary.select(
        "session_id", "client_key", "num_events", "manual_label", "suspicious_user_agent", "weak_bot_score",
        "proposed_label", *METADATA))


@register("proposed_label_counts", query(
    "SELECT proposed_label, count(*) AS num_sessions FROM labelled_summary GROUP BY proposed_label"))
def proposed_label_counts(spark, sf):
    return labelling.proposed_label_counts(labelled(spark, sf)[1])


@register("graph_edges", query("SELECT source, target, weight FROM edges"))
def graph_edges(spark, sf):
    return graphs.graph_edges(page_events(spark, sf))


@register("graph_nodes", query("SELECT path, category, depth, in_degree, out_degree, is_leaf FROM nodes"))
def graph_nodes(spark, sf):
    return site_nodes(page_events(spark, sf))


def _stored_edges(spark, sf):
    """An edge file of two states of the site, read back: the later weight of an edge is the larger one."""
    early, events = early_and_all(spark, sf)
    folder = scratch(spark, "edge_file")
    states = graphs.graph_edges(early).unionByName(graphs.graph_edges(events))
    states.write.csv(folder, header=True, quoteAll=True, escape='"')
    return graphs.read_edges(spark.read.csv(folder, header=True, escape='"', schema="source string, target string, weight string"))


@register("stored_edges", query("SELECT source, target, weight FROM edges"))
def stored_edges(spark, sf):
    return _stored_edges(spark, sf)


@register("stored_graph_nodes", query(
    "SELECT path, CASE WHEN length(path) % 2 = 0 THEN 'filed ' || length(path) ELSE category END AS category, "
    "depth, in_degree, out_degree, is_leaf FROM nodes"))
def stored_graph_nodes(spark, sf):
    edges = materialized(_stored_edges(spark, sf))
    pages = edges.select(F.explode(F.array("source", "target")).alias("path"))
    size = F.length("path")
    filed = pages.where(size % 2 == 0).select("path", F.concat(F.lit("filed "), size.cast("string")).alias("category"))
    return graphs.graph_nodes(edges, graphs.read_categories(filed))


@register("bfs_depth", query("SELECT path, min(d) AS depth FROM bfs GROUP BY path"))
def bfs_depth(spark, sf):
    return graphs.bfs_depths(graphs.graph_edges(page_events(spark, sf)))


@register("hop_distance", query("SELECT source, target, hops FROM step_hops"))
def hop_distance(spark, sf):
    early, events = early_and_all(spark, sf)
    return graphs.hop_distances(graphs.transitions(events), graphs.graph_edges(early))


def feature_select(source: str, columns=FEATURE_COLUMNS, label: bool = True) -> str:
    shown = ", ".join(f"{r6(c)} AS {c}" for c in columns)
    return f"SELECT session_id, prefix_len{', label' if label else ''}, {shown} FROM {source}"


def feature_query(name: str, columns: list[str], rows=prefix_feature_rows, source: str = "pf") -> None:
    def run(spark, sf):
        return rounded(rows(spark, sf).select("session_id", "prefix_len", "label", *columns))
    run.__name__ = name
    register(name, query(feature_select(source, columns)))(run)


@register("prefix_expansion", query(
    "SELECT session_id, prefix_len, seq, path FROM "
    f"(SELECT *, unnest(list_filter({PREFIXES}, lambda p: p >= seq AND p <= n_events)) AS prefix_len FROM ev)"))
def prefix_expansion(spark, sf):
    return feats.expand_prefixes(page_events(spark, sf), PREFIXES).select("session_id", "prefix_len", "seq", "path")


feature_query("entropies", [
    f"{norm}{kind}_entropy" for kind in ("node", "transition", "category", "category_transition")
    for norm in ("", "normalized_")
] + ["coverage_concentration", "transition_concentration", "category_concentration"])
feature_query("branching_entropy", ["local_branching_entropy", "branching_concentration"])
feature_query("path_repeats", [
    "session_length_so_far", "unique_nodes", "unique_node_ratio", "revisit_ratio", "repeated_path_ratio",
    "repeated_transition_ratio", "backtrack_count", "self_loop_ratio"])
feature_query("timing_features", [
    "mean_delta_t", "std_delta_t", "burstiness", "low_latency_ratio", "error_rate"])
feature_query("switch_rates", ["user_agent_switch_rate", "category_switch_rate"])
feature_query("entropy_deltas", ["revisit_growth", *[c for c in FEATURE_COLUMNS if c.endswith(("_delta", "_slope"))]])
feature_query("nav_entropy_scores", ["navigation_entropy_score", "navigation_entropy_score_v2"])
feature_query("prefix_features", FEATURE_COLUMNS)
feature_query("full_session_features", FEATURE_COLUMNS, full_feature_rows, "ff")


@register("graph_features", query(feature_select("gf", [
    "mean_depth", "leaf_visit_ratio", "out_degree_mean", "mean_hop_distance", "far_jump_ratio",
    "navigation_entropy_score"], label=False)))
def graph_features(spark, sf):
    early, events = early_and_all(spark, sf)
    edges = graphs.graph_edges(early)
    hops = graphs.hop_distances(graphs.transitions(events), edges)
    rows = feats.prefix_features(events, graphs.graph_nodes(edges), PREFIXES, hops)
    return rounded(rows.select(
        "session_id", "prefix_len", "mean_depth", "leaf_visit_ratio", "out_degree_mean", "mean_hop_distance",
        "far_jump_ratio", "navigation_entropy_score"))


_in_ablations = lambda column: ", ".join(f"'{a}'" for a in ABLATIONS if column in feats.ablation_columns(a))


@register("feature_groups", query(
    "SELECT session_id, prefix_len, label, ablation_name, "
    + ", ".join(f"CASE WHEN ablation_name IN ({_in_ablations(c)}) THEN {r6(c)} END AS {c}" for c in feats.ablation_columns("all_features"))
    + f" FROM ff, (SELECT unnest({list(ABLATIONS)}) AS ablation_name)"))
def feature_groups(spark, sf):
    full = materialized(full_feature_rows(spark, sf))
    tables = [feats.ablation_features(full, a).withColumn("ablation_name", F.lit(a)) for a in ABLATIONS]
    return rounded(reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), tables))


@register("static_scores", query(
    f"SELECT session_id, prefix_len, pf.label, {r6('weak_bot_score')} AS bot_probability "
    "FROM pf JOIN labelled_summary USING (session_id) WHERE num_events >= 5"))
def static_scores(spark, sf):
    events, summary = labelled(spark, sf)
    events = materialized(events)
    features = feats.prefix_features(events, site_nodes(events), PREFIXES)
    score = F.when(F.col("num_events") >= 5, F.col("weak_bot_score")).alias("bot_probability")
    return rounded(spread_session_scores(features, summary.select("session_id", score)))
