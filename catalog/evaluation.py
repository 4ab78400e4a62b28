"""Metadata, rule score, metrics, splits, audits and live ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickwarden.constants import (
    BOT_FAMILY_RULES, CATEGORICAL_CUES, ENTROPY_VARIANTS, LABEL_METADATA, LEAKAGE_KEYS, NUMERIC_CUES,
)
from clickwarden.operators import audits, evaluation as ev, features as feats, live, splits, summary as summaries
from clickwarden.operators.bootstrap import POISSON_CUMULATIVE
from clickwarden.operators.labels import apply_session_labels
from clickwarden.operators.ranking import with_global_row_number
from clickwarden.operators.scoring import decide, decide_by_prefix, rule_scores
from clickwarden.session import materialized

from .common import label_table, labelled, page_events, rounded, site_nodes, stored_events, stored_requests
from .requests_view import PREFIXES, TIMEOUT, requests_view
from .sql import CTES, SUSPECT, query, r6, summary_sql

QUERIES, SQL = {}, {}
THRESHOLD = 0.3
REPLICATES = 500
NOW = 1_735_700_000.0


def register(name, sql=None):
    def wrap(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function
    return wrap


# --- shared SQL -------------------------------------------------------------------------------

_family = " ".join(f"WHEN regexp_matches(ua, '{p}') THEN '{n}'" for n, p in BOT_FAMILY_RULES)
_browser = "regexp_matches(ua, 'mozilla/|chrome/|firefox/|safari/|edg/')"
CTES["lsum"] = summary_sql("lev", "max(label)", {"collection_method": "max(collection_method) FILTER (seq = 1)"})
CTES["firsts"] = """
  SELECT session_id, max(method) FILTER (seq = 1) AS method, max(status_code) FILTER (seq = 1) AS status,
    max(body_bytes_sent) FILTER (seq = 1) AS bytes, max(page_category) FILTER (seq = 1) AS first_category,
    substr(sha1(string_agg(path, ' > ' ORDER BY seq)), 1, 12) AS path_signature,
    substr(sha1(string_agg(path, ' > ' ORDER BY seq) FILTER (seq <= 3)), 1, 12) AS prefix3_signature,
    substr(sha1(string_agg(path, ' > ' ORDER BY seq) FILTER (seq <= 5)), 1, 12) AS prefix5_signature
  FROM lev GROUP BY session_id"""
CTES["meta"] = f"""
  SELECT s.* EXCLUDE (ua, traffic_family), coalesce(traffic_family, bot_family) AS traffic_family FROM (
    SELECT s.*, CASE WHEN ua LIKE '%python-requests%' THEN 'python_requests' WHEN ua LIKE '%playwright%' THEN 'playwright'
        WHEN regexp_matches(ua, 'selenium|webdriver') THEN 'selenium' WHEN ua LIKE '%researchscraper%' THEN 'research_scraper'
        WHEN regexp_matches(ua, 'researchstealth|stealth-browser|hybridcrawler|browsernoise') THEN 'stealth_browser'
        WHEN {_browser} THEN 'browser_like' WHEN ua = '' THEN 'missing' ELSE 'other' END AS ua_family,
      CASE WHEN label <> 'bot' THEN 'human' {_family} ELSE 'generic_bot' END AS bot_family,
      CASE WHEN regexp_matches(ua, '{SUSPECT}') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_suspect_user_agent,
      length(ua)::DOUBLE AS ua_length, (length(ua) - length(replace(ua, '/', '')))::DOUBLE AS ua_slash_count,
      CASE WHEN {_browser} THEN 1.0 ELSE 0.0 END::DOUBLE AS ua_browser_like,
      len(list_filter(string_split(first_path, '/'), lambda x: x <> ''))::DOUBLE AS first_path_depth,
      upper(coalesce(method, 'GET')) AS first_method, coalesce(status, 0)::DOUBLE AS first_status_code,
      coalesce(bytes, 0)::DOUBLE AS first_body_bytes_sent,
      first_category, path_signature, prefix3_signature, prefix5_signature
    FROM (SELECT *, lower(coalesce(user_agent, '')) AS ua FROM lsum) s JOIN firsts USING (session_id)) s"""
CTES["kmeta"] = "SELECT * FROM meta WHERE label <> 'unknown'"
CTES["kpf"] = "SELECT * FROM pf WHERE label <> 'unknown'"
_clip = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def rule_sql(features: str) -> str:
    return f"""
      SELECT f.session_id, f.prefix_len, f.label, {_clip(f'''(
          0.28::DOUBLE * {_clip('1.0::DOUBLE - navigation_entropy_score')} + 0.16::DOUBLE * repeated_transition_ratio
          + 0.17::DOUBLE * low_latency_ratio + 0.12::DOUBLE * leaf_visit_ratio + 0.08::DOUBLE * far_jump_ratio
          + 0.12::DOUBLE * has_suspect_user_agent + 0.07::DOUBLE * (1.0::DOUBLE - ua_browser_like))''')} AS bot_probability
      FROM {features} f JOIN meta m USING (session_id)"""


# scores meet thresholds and each other: both engines compare them at ten decimals
CTES["scored"] = f"SELECT * REPLACE (round(bot_probability, 10) AS bot_probability) FROM ({rule_sql('kpf')})"
CTES["pred"] = f"""
  SELECT *, {THRESHOLD}::DOUBLE AS threshold_used,
    CASE WHEN bot_probability >= {THRESHOLD}::DOUBLE THEN 1 ELSE 0 END AS predicted_bot FROM scored"""
CTES["candidates"] = "SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in ev.CANDIDATE_THRESHOLDS) + "]) AS t"


def share_sql(key: str, seed: str = splits.DEFAULT_SEED) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def three_way(key: str) -> str:
    share = share_sql(key)
    return f"CASE WHEN {share} < 0.6::DOUBLE THEN 'train' WHEN {share} < 0.8::DOUBLE THEN 'val' ELSE 'test' END"


CTES["bsplit"] = f"SELECT session_id, {three_way('path_signature')} AS split FROM kmeta"


def metrics_sql(source: str, keys: str) -> str:
    return f"""
      SELECT {keys}, (tp + tn) / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall,
        CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1
      FROM (SELECT {keys}, count(*)::DOUBLE AS n,
          count(*) FILTER (label = 'bot' AND predicted_bot = 1)::DOUBLE AS tp,
          count(*) FILTER (label <> 'bot' AND predicted_bot = 1)::DOUBLE AS fp,
          count(*) FILTER (label = 'bot' AND predicted_bot = 0)::DOUBLE AS fn,
          count(*) FILTER (label <> 'bot' AND predicted_bot = 0)::DOUBLE AS tn
        FROM {source} GROUP BY {keys})"""


def curve_sql(source: str, keys: str, score: str = "bot_probability", weight: str = "1") -> str:
    """AUC by comparing running counts, average precision by descending score."""
    return f"""
      SELECT {keys}, CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum(pos * (neg_below + 0.5::DOUBLE * neg)) / (max(p) * max(q)) END AS roc_auc,
        CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * pos_above / (pos_above + neg_above) ELSE 0.0::DOUBLE END) / max(p) END AS pr_auc
      FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
          sum(pos) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS pos_above,
          sum(neg) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS neg_above,
          sum(pos) OVER (PARTITION BY {keys}) AS p, sum(neg) OVER (PARTITION BY {keys}) AS q
        FROM (SELECT {keys}, {score} AS s, sum(CASE WHEN label = 'bot' THEN {weight} ELSE 0 END)::DOUBLE AS pos,
            sum(CASE WHEN label <> 'bot' THEN {weight} ELSE 0 END)::DOUBLE AS neg
          FROM {source} GROUP BY {keys}, {score}))
      GROUP BY {keys}"""


def tuned_sql(source: str, keys: str, min_rows: int, default: str) -> str:
    return f"""
      SELECT {keys}, CASE WHEN max(n) >= {min_rows} AND max(p) > 0 AND max(p) < max(n)
          THEN arg_max(t, (f1, -t)) ELSE {default} END AS threshold,
        CASE WHEN max(n) >= {min_rows} AND max(p) > 0 AND max(p) < max(n) THEN max(f1) END AS f1
      FROM (SELECT {keys}, t, count(*) AS n, count(*) FILTER (label = 'bot') AS p,
          coalesce(2 * count(*) FILTER (label = 'bot' AND bot_probability >= t)::DOUBLE
          / nullif(2 * count(*) FILTER (label = 'bot' AND bot_probability >= t) + count(*) FILTER (label <> 'bot' AND bot_probability >= t)
            + count(*) FILTER (label = 'bot' AND bot_probability < t), 0), 0.0::DOUBLE) AS f1
        FROM {source} CROSS JOIN candidates GROUP BY {keys}, t)
      GROUP BY {keys}"""


# --- shared Spark -----------------------------------------------------------------------------

def dataset(spark, sf):
    """Labelled events, known metadata and prefix features, events written once."""
    events = materialized(labelled(spark, sf)[0])
    metadata = ev.known_labels(summaries.session_metadata(events))
    prefix = ev.known_labels(feats.prefix_features(events, site_nodes(events), PREFIXES))
    return events, metadata, prefix


def known_metadata(spark, sf):
    return ev.known_labels(summaries.session_metadata(labelled(spark, sf)[0]))


def scores(spark, sf):
    _, metadata, prefix = dataset(spark, sf)
    return rule_scores(prefix, metadata).withColumn("bot_probability", F.round("bot_probability", 10))


def predictions(spark, sf):
    return decide(scores(spark, sf), F.lit(THRESHOLD))


# --- metadata ---------------------------------------------------------------------------------

_META = [
    "session_id", "label", "client_key", "num_events", "first_path", "ua_family", "bot_family", "has_suspect_user_agent",
    "ua_length", "ua_slash_count", "ua_browser_like", "first_path_depth", "first_category", "first_method",
    "first_status_code", "first_body_bytes_sent", "path_signature", "prefix3_signature", "prefix5_signature",
    *LABEL_METADATA,
]


@register("session_metadata", query(f"SELECT {', '.join(_META)} FROM meta"))
def session_metadata(spark, sf):
    return summaries.session_metadata(labelled(spark, sf)[0]).select(*_META)


@register("metadata_with_summary", query(f"SELECT {', '.join(_META)}, {r6('m.mean_delta_t')} AS mean_delta_t, "
                                         "w.proposed_label, w.manual_label FROM meta m JOIN "
                                         "(SELECT session_id, proposed_label, manual_label FROM labelled_summary) w USING (session_id)"))
def metadata_with_summary(spark, sf):
    events, summary = labelled(spark, sf)
    joined = summaries.add_missing_summary_columns(summaries.session_metadata(events), summary)
    return rounded(joined.select(*_META, "mean_delta_t", "proposed_label", "manual_label"), "mean_delta_t")


@register("default_metadata", query(
    "SELECT session_id, label, CAST(max(prefix_len) AS BIGINT) AS num_events, 'unknown' AS ua_family, 'generic_bot' AS bot_family, "
    "'GET' AS first_method, session_id AS path_signature FROM pf GROUP BY session_id, label"))
def default_metadata(spark, sf):
    events = materialized(labelled(spark, sf)[0])
    rows = feats.prefix_features(events, site_nodes(events), PREFIXES)
    return summaries.default_metadata(rows).select(
        "session_id", "label", F.col("num_events").cast("bigint").alias("num_events"), "ua_family", "bot_family",
        "first_method", "path_signature")


# --- metrics ----------------------------------------------------------------------------------

@register("heuristic_scores", query(f"SELECT session_id, prefix_len, label, {r6('bot_probability')} AS bot_probability FROM scored"))
def heuristic_scores(spark, sf):
    return rounded(scores(spark, sf))


@register("threshold_tuning", query(
    f"SELECT prefix_len, {r6('threshold')} AS threshold, {r6('f1')} AS f1 FROM ({tuned_sql('scored', 'prefix_len', 4, '0.5::DOUBLE')})"))
def threshold_tuning(spark, sf):
    return rounded(ev.tune_thresholds(scores(spark, sf)))


_metric_select = ", ".join(f"{r6(c)} AS {c}" for c in ("accuracy", "precision", "recall", "f1"))


@register("metrics_by_prefix", query(f"SELECT prefix_len, {_metric_select} FROM ({metrics_sql('pred', 'prefix_len')})"))
def metrics_by_prefix(spark, sf):
    return rounded(ev.binary_metrics(predictions(spark, sf)))


@register("roc_auc", query(f"SELECT prefix_len, {r6('roc_auc')} AS roc_auc FROM ({curve_sql('scored', 'prefix_len')})"))
def roc_auc(spark, sf):
    return rounded(ev.roc_auc(scores(spark, sf)))


@register("average_precision", query(f"SELECT prefix_len, {r6('pr_auc')} AS pr_auc FROM ({curve_sql('scored', 'prefix_len')})"))
def average_precision(spark, sf):
    return rounded(ev.average_precision(scores(spark, sf)))


def delay_sql(source: str, keys: str = "") -> str:
    return f"""
      SELECT {keys}label, count(*) AS num_sessions, count(p)::DOUBLE / count(*) AS detection_rate,
        sum(p) / count(p)::DOUBLE AS mean_first_detected_prefix
      FROM (SELECT {keys}session_id, label, min(prefix_len) FILTER (label = 'bot' AND predicted_bot = 1) AS p
        FROM {source} GROUP BY {keys}session_id, label) GROUP BY {keys}label"""


@register("detection_delay", query(
    f"SELECT label, num_sessions, {r6('detection_rate')} AS detection_rate, "
    f"{r6('mean_first_detected_prefix')} AS mean_first_detected_prefix FROM ({delay_sql('pred')})"))
def detection_delay(spark, sf):
    return rounded(ev.detection_delay(predictions(spark, sf)))


_poisson = "CASE " + " ".join(f"WHEN u < {b!r}::DOUBLE THEN {k}" for k, b in enumerate(POISSON_CUMULATIVE)) + f" ELSE {len(POISSON_CUMULATIVE)} END"
_draws = {
    "drawn": f"""
      SELECT *, {_poisson} AS w FROM (
        SELECT p.*, r.replicate, ('0x' || substr(md5(session_id || '|' || (r.replicate - 1) // 4), 1 + (r.replicate - 1) % 4 * 8, 8))::BIGINT / 4294967296.0::DOUBLE AS u
        FROM pred p CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate) r)""",
    "kept": "SELECT * FROM drawn WHERE w > 0",
    "rep": f"""
      SELECT c.*, f.f1 FROM ({curve_sql('kept', 'prefix_len, replicate', weight='w')}) c JOIN (
        SELECT prefix_len, replicate, coalesce(2 * sum(w) FILTER (label = 'bot' AND predicted_bot = 1)
          / nullif(2 * coalesce(sum(w) FILTER (label = 'bot' AND predicted_bot = 1), 0)
            + coalesce(sum(w) FILTER (label <> 'bot' AND predicted_bot = 1), 0)
            + coalesce(sum(w) FILTER (label = 'bot' AND predicted_bot = 0), 0), 0)::DOUBLE, 0.0::DOUBLE) AS f1
        FROM kept GROUP BY prefix_len, replicate) f USING (prefix_len, replicate)""",
    "bounds": """
      SELECT prefix_len, metric, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high,
        count(*) AS n_bootstrap
      FROM (UNPIVOT (SELECT prefix_len, replicate, f1, roc_auc, pr_auc FROM rep) ON f1, roc_auc, pr_auc INTO NAME metric VALUE value)
      WHERE value IS NOT NULL GROUP BY ALL""",
    "point_wide": f"""
      SELECT * FROM ({metrics_sql('pred', 'prefix_len')}) JOIN ({curve_sql('pred', 'prefix_len')}) USING (prefix_len)""",
    "point": " UNION ALL ".join(
        f"SELECT prefix_len, '{m}' AS metric, {m} AS point_estimate FROM point_wide" for m in ev.BOOTSTRAP_METRICS),
}


@register("bootstrap_ci", query(
    f"SELECT prefix_len, metric, {r6('point_estimate')} AS point_estimate, {r6('ci_low')} AS ci_low, {r6('ci_high')} AS ci_high, "
    f"coalesce(n_bootstrap, 0) AS n_bootstrap, {THRESHOLD}::DOUBLE AS threshold_used FROM point LEFT JOIN bounds USING (prefix_len, metric)", _draws))
def bootstrap_ci(spark, sf):
    stored = materialized(predictions(spark, sf))
    return rounded(ev.bootstrap_intervals(stored))


def baseline(split_table: str, tag: str) -> dict[str, str]:
    """Thresholds from validation, decisions on test."""
    return {
        f"{tag}_val": f"SELECT s.* FROM scored s JOIN {split_table} x USING (session_id) WHERE split = 'val'",
        f"{tag}_last": f"SELECT * FROM {tag}_val QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY prefix_len DESC) = 1",
        f"{tag}_default": f"SELECT coalesce(max(threshold), 0.5::DOUBLE) AS d FROM ({tuned_sql(f'(SELECT *, 1 AS one FROM {tag}_last)', 'one', 1, '0.5::DOUBLE')})",
        f"{tag}_t": tuned_sql(f"{tag}_val", "prefix_len", 4, f"(SELECT d FROM {tag}_default)"),
        f"{tag}_pred": f"""
          SELECT s.*, coalesce(t.threshold, (SELECT d FROM {tag}_default)) AS threshold_used,
            CASE WHEN bot_probability >= coalesce(t.threshold, (SELECT d FROM {tag}_default)) THEN 1 ELSE 0 END AS predicted_bot
          FROM scored s JOIN {split_table} x USING (session_id) LEFT JOIN {tag}_t t USING (prefix_len) WHERE split = 'test'""",
    }


def heuristic_predictions(scored, split_table):
    """Rule-score decisions on test with thresholds tuned on validation."""
    joined = splits.with_split(scored, split_table)
    val = joined.where(F.col("split") == "val").drop("split")
    default = ev.tune_threshold(summaries.last_prefix_rows(val))
    thresholds = ev.tune_thresholds(val, default=default)
    return decide_by_prefix(joined.where(F.col("split") == "test").drop("split"), thresholds, default)


_curves = f"{r6('roc_auc')} AS roc_auc, {r6('pr_auc')} AS pr_auc"


@register("heuristic_baseline", query(
    f"SELECT prefix_len, {_metric_select}, {_curves} FROM ({metrics_sql('hb_pred', 'prefix_len')}) "
    f"JOIN ({curve_sql('hb_pred', 'prefix_len')}) USING (prefix_len)", baseline("bsplit", "hb")))
def heuristic_baseline(spark, sf):
    _, metadata, prefix = dataset(spark, sf)
    scored = materialized(rule_scores(prefix, metadata).withColumn("bot_probability", F.round("bot_probability", 10)))
    return rounded(ev.metrics_by_group(heuristic_predictions(scored, splits.bucket_split(metadata))))


CTES["ksession_rank"] = "SELECT session_id, label, row_number() OVER (ORDER BY start_timestamp, session_id) AS rank, count(*) OVER () AS n FROM kmeta"
CTES["tsplit_all"] = """
  SELECT session_id, label, n, CASE WHEN rank <= greatest(1, floor(n * 0.6::DOUBLE)) THEN 'train'
    WHEN rank <= greatest(greatest(1, floor(n * 0.6::DOUBLE)) + 1, floor(n * 0.8::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ksession_rank"""
CTES["tsplit"] = """
  SELECT session_id, split FROM tsplit_all WHERE n >= 6 AND 3 = (
    SELECT count(*) FROM (SELECT split FROM tsplit_all GROUP BY split HAVING count(DISTINCT label) >= 2))"""

_board = {
    **baseline("bsplit", "hb"), **baseline("tsplit", "ht"),
    "runs": "SELECT 'session_split' AS protocol, * FROM hb_pred UNION ALL SELECT 'time_split', * FROM ht_pred",
    "board": f"""
      SELECT m.*, c.roc_auc, c.pr_auc FROM ({metrics_sql('runs', 'protocol, prefix_len')}) m
      JOIN ({curve_sql('runs', 'protocol, prefix_len')}) c USING (protocol, prefix_len)
      QUALIFY row_number() OVER (PARTITION BY protocol ORDER BY prefix_len DESC) = 1""",
}


@register("leaderboard", query(
    f"SELECT b.protocol, prefix_len AS final_prefix, {_metric_select}, {_curves}, {r6('d.detection_rate')} AS bot_detection_rate, "
    f"{r6('d.mean_first_detected_prefix')} AS mean_first_detected_prefix_bot, {r6('t.threshold')} AS threshold FROM board b "
    f"LEFT JOIN (SELECT * FROM ({delay_sql('runs', 'protocol, ')}) WHERE label = 'bot') d ON d.protocol = b.protocol "
    "LEFT JOIN (SELECT protocol, arg_max(threshold_used, prefix_len) AS threshold FROM runs GROUP BY protocol) t ON t.protocol = b.protocol "
    "ORDER BY f1 DESC, roc_auc DESC, pr_auc DESC", _board))
def leaderboard(spark, sf):
    _, metadata, prefix = dataset(spark, sf)
    metadata = materialized(metadata)
    scored = materialized(rule_scores(prefix, metadata).withColumn("bot_probability", F.round("bot_probability", 10)))
    runs = None
    for protocol, table in (("session_split", splits.bucket_split(metadata)), ("time_split", splits.time_split(metadata))):
        run = heuristic_predictions(scored, table).withColumn("protocol", F.lit(protocol))
        runs = run if runs is None else runs.unionByName(run)
    return rounded(ev.leaderboard(materialized(runs), ["protocol"]))


CTES["traj_mean"] = "SELECT session_id, label, round(avg(bot_probability), 12) AS m FROM scored GROUP BY session_id, label"
CTES["traj_rank"] = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY m, session_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM traj_mean"
CTES["traj"] = """
  SELECT 'human' AS series, session_id FROM traj_rank WHERE label = 'human' AND r = 1
  UNION ALL SELECT 'bot_high', session_id FROM traj_rank WHERE label = 'bot' AND r = n
  UNION ALL SELECT 'bot_mid', session_id FROM traj_rank WHERE label = 'bot' AND r = n // 2 + 1 AND n >= 2"""


@register("trajectory_sessions", query(
    f"SELECT series, session_id, prefix_len, {r6('bot_probability')} AS bot_probability FROM traj JOIN scored USING (session_id)"))
def trajectory_sessions(spark, sf):
    return rounded(ev.trajectory_sessions(materialized(scores(spark, sf))))


# --- splits -----------------------------------------------------------------------------------

@register("group_bucket_split", query("SELECT session_id, split FROM bsplit"))
def group_bucket_split(spark, sf):
    return splits.bucket_split(known_metadata(spark, sf))


# the greedy choice, one group at a time, then the number of groups of each size per split
_greedy = {
    "grp": "SELECT label, path_signature AS g, count(*) AS size FROM kmeta GROUP BY ALL",
    "grp_order": f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, {share_sql('g')}, g) AS i, "
                 "sum(size) OVER (PARTITION BY label) AS total FROM grp",
    "greedy": """
      SELECT label, i, size, total, CAST(NULL AS VARCHAR) AS pick, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c
      FROM (SELECT label, 0::BIGINT AS i, 0::BIGINT AS size, max(total) AS total FROM grp_order GROUP BY label)
      UNION ALL
      SELECT label, i, size, total, pick, a + CASE WHEN pick = 'train' THEN size ELSE 0 END,
        b + CASE WHEN pick = 'val' THEN size ELSE 0 END, c + CASE WHEN pick = 'test' THEN size ELSE 0 END
      FROM (SELECT o.label, o.i, o.size, o.total, q.a, q.b, q.c,
          CASE WHEN (o.total * 0.6::DOUBLE - q.a, -q.a) >= (o.total * 0.2::DOUBLE - q.b, -q.b)
              AND (o.total * 0.6::DOUBLE - q.a, -q.a) >= (o.total * 0.2::DOUBLE - q.c, -q.c) THEN 'train'
            WHEN (o.total * 0.2::DOUBLE - q.b, -q.b) >= (o.total * 0.2::DOUBLE - q.c, -q.c) THEN 'val' ELSE 'test' END AS pick
        FROM greedy q JOIN grp_order o ON o.label = q.label AND o.i = q.i + 1)""",
    "taken": """
      SELECT label, size, count(*) FILTER (pick = 'train') AS x, count(*) FILTER (pick = 'val') AS y
      FROM greedy WHERE i > 0 GROUP BY label, size""",
    "grp_split": f"""
      SELECT label, g, CASE WHEN r <= x THEN 'train' WHEN r <= x + y THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY label, size ORDER BY {share_sql('g')}, g) AS r FROM grp) JOIN taken USING (label, size)""",
    "gsplit": "SELECT session_id, split FROM kmeta m JOIN grp_split s ON s.label = m.label AND s.g = m.path_signature",
}


@register("grouped_split", query("SELECT session_id, split FROM gsplit", _greedy))
def grouped_split(spark, sf):
    return splits.grouped_split(materialized(known_metadata(spark, sf).select("session_id", "label", "path_signature")))


@register("stratified_split", query(f"""
  SELECT session_id, CASE WHEN r <= n - ceil(n * 0.4::DOUBLE) THEN 'train'
    WHEN r <= n - ceil(ceil(n * 0.4::DOUBLE) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT session_id, row_number() OVER (PARTITION BY label ORDER BY {share_sql('session_id')}, session_id) AS r,
    count(*) OVER (PARTITION BY label) AS n FROM kmeta)"""))
def stratified_split(spark, sf):
    return splits.stratified_split(known_metadata(spark, sf))


@register("train_test_split", query(
    f"SELECT session_id, CASE WHEN {share_sql('session_id')} < 0.7::DOUBLE THEN 'train' ELSE 'test' END AS split FROM kmeta"))
def train_test_split(spark, sf):
    return splits.train_test_split(known_metadata(spark, sf))


@register("time_split", query("SELECT session_id, split FROM tsplit"))
def time_split(spark, sf):
    return splits.time_split(known_metadata(spark, sf))


_three, _two = three_way("session_id"), f"CASE WHEN {share_sql('session_id')} < 0.75::DOUBLE THEN 'train' ELSE 'val' END"


def holdout_sql(key: str, held_label: str, eligible: str) -> dict[str, str]:
    human, bot = (_three, _two) if held_label == "bot" else (_two, _three)
    return {
        "hbase": f"""
          SELECT session_id, label, CASE WHEN label = '{held_label}' THEN {key} END AS held_out,
            CASE WHEN label = 'human' THEN {human} ELSE {bot} END AS base_split FROM kmeta""",
        "hout": eligible,
        "hsize": """
          SELECT o.held_out, CASE WHEN b.held_out = o.held_out THEN 'test' ELSE base_split END AS split,
            count(*) AS num_sessions, count(*) FILTER (label = 'human') AS num_humans, count(*) FILTER (label = 'bot') AS num_bots
          FROM hout o CROSS JOIN hbase b GROUP BY ALL""",
    }


_family_out = holdout_sql("bot_family", "bot", """
  SELECT * FROM (SELECT *, count(*) OVER () AS families FROM (
      SELECT bot_family AS held_out, count(*) AS held_out_sessions FROM kmeta WHERE label = 'bot' GROUP BY 1 HAVING count(*) >= 3))
  WHERE families >= 2 AND (SELECT count(*) FROM kmeta WHERE label = 'human') >= 6
    AND (SELECT count(*) FROM kmeta WHERE label = 'bot') - held_out_sessions >= 4""")
_person_out = holdout_sql("participant_id", "human", """
  SELECT * FROM (SELECT *, count(*) OVER () AS people FROM (
      SELECT participant_id AS held_out, count(*) AS held_out_sessions FROM kmeta
      WHERE label = 'human' AND participant_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2))
  WHERE people >= 2 AND (SELECT count(*) FROM kmeta WHERE label = 'bot') >= 6
    AND (SELECT count(*) FROM kmeta WHERE label = 'human') - held_out_sessions >= 4""")
_base_select = "SELECT session_id, label, held_out, base_split FROM hbase"
_size_select = "SELECT held_out, split, num_sessions, num_humans, num_bots FROM hsize WHERE num_sessions > 0"


@register("family_holdout", query(_base_select, _family_out))
def family_holdout(spark, sf):
    return splits.holdout_base(known_metadata(spark, sf), "bot_family")


@register("participant_holdout", query(_base_select, _person_out))
def participant_holdout(spark, sf):
    return splits.holdout_base(known_metadata(spark, sf), "participant_id")


def _folds_sql(key, folds):
    """Values by size, dealt there and back over the folds, or each alone."""
    return query(f"""
  SELECT value, sessions, CASE WHEN total <= {folds} THEN value
    ELSE 'fold_' || printf('%02d', CASE WHEN (r // {folds}) % 2 = 1 THEN {folds - 1} - r % {folds} ELSE r % {folds} END) END AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY sessions DESC, value) - 1 AS r, count(*) OVER () AS total FROM (
    SELECT {key} AS value, count(*) AS sessions FROM kmeta
    WHERE trim({key}) <> '' AND {key} <> 'human' GROUP BY {key}))""")


@register("family_folds", _folds_sql("bot_family", 2))
def family_folds(spark, sf):
    return splits.balanced_folds(known_metadata(spark, sf), "bot_family", 2)


@register("family_folds_alone", _folds_sql("bot_family", 50))
def family_folds_alone(spark, sf):
    return splits.balanced_folds(known_metadata(spark, sf), "bot_family", 50)


@register("participant_folds", _folds_sql("participant_id", 4))
def participant_folds(spark, sf):
    return splits.balanced_folds(known_metadata(spark, sf), "participant_id", 4)


def _sizes(spark, sf, key, eligible):
    metadata = materialized(known_metadata(spark, sf).select("session_id", "label", "bot_family", "participant_id"))
    sizes = splits.holdout_sizes(splits.holdout_base(metadata, key), eligible(metadata))
    return sizes.where(F.col("num_sessions") > 0)


@register("family_holdout_sizes", query(_size_select, _family_out))
def family_holdout_sizes(spark, sf):
    return _sizes(spark, sf, "bot_family", splits.family_holdouts)


@register("participant_holdout_sizes", query(_size_select, _person_out))
def participant_holdout_sizes(spark, sf):
    return _sizes(spark, sf, "participant_id", splits.participant_holdouts)


@register("split_summary", query("""
  SELECT split, count(*) AS num_sessions, count(*) FILTER (label = 'human') AS num_humans,
    count(*) FILTER (label = 'bot') AS num_bots, count(DISTINCT participant_id) AS num_participants,
    coalesce(max(fams), '') AS bot_family_counts
  FROM kmeta JOIN bsplit USING (session_id) LEFT JOIN (
    SELECT split, string_agg(bot_family || ':' || n, '; ' ORDER BY n DESC, bot_family) AS fams FROM (
      SELECT split, bot_family, count(*) AS n FROM kmeta JOIN bsplit USING (session_id) WHERE label = 'bot' GROUP BY ALL)
    GROUP BY split) USING (split) GROUP BY split"""))
def split_summary(spark, sf):
    metadata = materialized(known_metadata(spark, sf))
    return splits.split_summary(metadata, splits.bucket_split(metadata))


# --- audits -----------------------------------------------------------------------------------

_leak_values = " UNION ALL ".join(
    f"SELECT split, '{name}' AS key, trim({column}) AS value FROM kmeta JOIN bsplit USING (session_id)"
    for name, column in [*[(k, k) for k in LEAKAGE_KEYS], ("group_key:path_signature", "path_signature")]
)
_leak = {
    "leak_values": f"SELECT DISTINCT * FROM ({_leak_values}) WHERE value <> '' AND lower(value) <> 'nan'",
    "leak_pairs": "SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) t(l, r)",
    "leak_shared": """
      SELECT p.l || '_vs_' || p.r AS split_pair, a.key, a.value FROM leak_pairs p JOIN leak_values a ON a.split = p.l
      JOIN leak_values b ON b.split = p.r AND b.key = a.key AND b.value = a.value""",
}


@register("leakage_audit", query("""
  SELECT p.l || '_vs_' || p.r AS split_pair, k.key, coalesce(s.n, 0) AS shared_count, coalesce(s.ex, '') AS examples
  FROM leak_pairs p CROSS JOIN (SELECT DISTINCT key FROM leak_values) k LEFT JOIN (
    SELECT split_pair, key, count(*) AS n, array_to_string(list_slice(list(value ORDER BY value), 1, 5), '; ') AS ex
    FROM leak_shared GROUP BY ALL) s ON s.split_pair = p.l || '_vs_' || p.r AND s.key = k.key""", _leak))
def leakage_audit(spark, sf):
    metadata = materialized(known_metadata(spark, sf))
    return audits.leakage_audit(metadata, splits.bucket_split(metadata))


CTES["enriched"] = "SELECT m.*, f.navigation_entropy_score_v2 FROM kmeta m LEFT JOIN ff f USING (session_id)"
_class = " UNION ALL ".join(
    f"SELECT 'class_summary' AS section, label, '{m}' AS metric, {e}::DOUBLE AS value FROM enriched GROUP BY label"
    for m, e in [("num_sessions", "count(*)"), ("mean_num_events", "avg(num_events)"), ("mean_unique_paths", "avg(unique_paths)"),
                 ("mean_referrer_present_ratio", "avg(referrer_present_ratio)"), ("mean_asset_request_ratio", "avg(asset_request_ratio)"),
                 ("share_suspect_user_agent", "avg(has_suspect_user_agent)"),
                 ("mean_navigation_entropy_score_v2", "avg(navigation_entropy_score_v2)")])
_top = " UNION ALL ".join(
    f"SELECT * FROM (SELECT * FROM (SELECT 'top_{c}' AS section, label, coalesce({c}, 'missing') AS metric, count(*)::DOUBLE AS value FROM enriched GROUP BY ALL) "
    "QUALIFY row_number() OVER (PARTITION BY label ORDER BY value DESC, metric) <= 5)" for c in ("ua_family", "traffic_family", "first_path"))


def audit_inputs(spark, sf):
    events = materialized(labelled(spark, sf)[0])
    metadata = ev.known_labels(summaries.session_metadata(events))
    return metadata, feats.full_session_features(events, site_nodes(events))


@register("shortcut_audit", query(f"SELECT section, label, metric, {r6('value')} AS value FROM ({_class} UNION ALL {_top})"))
def shortcut_audit(spark, sf):
    return rounded(audits.shortcut_audit(*audit_inputs(spark, sf)))


_level = "CASE WHEN signal_strength >= 0.95::DOUBLE THEN 'high' WHEN signal_strength >= 0.85::DOUBLE THEN 'medium' ELSE 'low' END"
_cues = {
    "cues": " UNION ALL ".join(f"SELECT label, '{c}' AS cue_name, coalesce({c}, 0)::DOUBLE AS value FROM kmeta" for c in NUMERIC_CUES),
    "cue_stats": """
      SELECT cue_name, count(*) AS support, avg(value) FILTER (label <> 'bot') AS human_mean, avg(value) FILTER (label = 'bot') AS bot_mean,
        min(value) < max(value) AS varies FROM cues GROUP BY cue_name""",
    "cue_auc": f"SELECT cue_name, greatest(roc_auc, 1.0::DOUBLE - roc_auc) AS signal_strength FROM ({curve_sql('cues', 'cue_name', 'value')}) WHERE roc_auc IS NOT NULL",
}


@register("red_flags_numeric", query(
    f"SELECT cue_name, support, {r6('signal_strength')} AS signal_strength, {r6('human_mean')} AS human_mean, {r6('bot_mean')} AS bot_mean, "
    f"{_level} AS flag_level FROM cue_stats JOIN cue_auc USING (cue_name) WHERE varies", _cues))
def red_flags_numeric(spark, sf):
    flags = audits.numeric_red_flags(materialized(known_metadata(spark, sf)))
    return rounded(flags.drop("cue_type", "details"))


_cat = " UNION ALL ".join(
    f"SELECT label, '{c}=' || coalesce({c}, 'nan') AS cue_name FROM kmeta" for c in CATEGORICAL_CUES)


@register("red_flags_categorical", query(
    f"SELECT cue_name, support, {r6('signal_strength')} AS signal_strength, {_level} AS flag_level FROM ("
    "SELECT cue_name, count(*) AS support, greatest(avg(CASE WHEN label = 'bot' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), "
    "1.0::DOUBLE - avg(CASE WHEN label = 'bot' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS signal_strength "
    f"FROM ({_cat}) GROUP BY cue_name HAVING count(*) >= 3) ORDER BY flag_level, signal_strength DESC, support DESC"))
def red_flags_categorical(spark, sf):
    flags = audits.shortcut_red_flags(materialized(known_metadata(spark, sf)))
    return rounded(flags.where(F.col("cue_type") == "categorical").select("cue_name", "support", "signal_strength", "flag_level"))


_variants = {
    "ev_long": " UNION ALL ".join(f"SELECT '{c}' AS feature, prefix_len, label, round({c}, 10) + 0.0::DOUBLE AS value FROM kpf" for c in ENTROPY_VARIANTS),
    "ev_stats": f"""
      SELECT m.*, c.roc_auc FROM (SELECT feature, prefix_len, avg(value) FILTER (label <> 'bot') AS human_mean,
        avg(value) FILTER (label = 'bot') AS bot_mean FROM ev_long GROUP BY feature, prefix_len) m
      JOIN ({curve_sql('ev_long', 'feature, prefix_len', 'value')}) c USING (feature, prefix_len)""",
}


@register("entropy_variants", query(
    f"SELECT feature, CAST(prefix_len AS VARCHAR) AS prefix_len, {r6('roc_auc')} AS roc_auc, {r6('human_mean')} AS human_mean, "
    f"{r6('bot_mean')} AS bot_mean, {r6('abs(bot_mean - human_mean)')} AS absolute_gap FROM ev_stats UNION ALL "
    f"SELECT feature, 'mean', {r6('avg(roc_auc)')}, NULL, NULL, NULL FROM ev_stats WHERE roc_auc IS NOT NULL GROUP BY feature", _variants))
def entropy_variants(spark, sf):
    _, _, prefix = dataset(spark, sf)
    prefix = prefix.withColumns({c: F.round(c, 10) + F.lit(0.0) for c in ENTROPY_VARIANTS})
    return rounded(audits.entropy_variant_comparison(materialized(prefix), PREFIXES))


# --- live view --------------------------------------------------------------------------------

CTES["lall"] = """
  SELECT e.*, 'unknown' AS label FROM pg e"""
from .sql import ASSETS, feature_ctes, session_ctes  # noqa: E402

CTES.update(session_ctes("pg", f"NOT regexp_matches(lower(path), '{ASSETS}')", 1))
CTES["pg2"] = "SELECT *, 'unknown' AS label FROM pg WHERE n_events >= 2"
CTES.update(feature_ctes("vf", "pg2", "[n_events]", "nodes", None))
CTES["vscore"] = f"""
  SELECT session_id, round({_clip(f'''(0.28::DOUBLE * {_clip('1.0::DOUBLE - navigation_entropy_score')} + 0.16::DOUBLE * repeated_transition_ratio
    + 0.17::DOUBLE * low_latency_ratio + 0.12::DOUBLE * leaf_visit_ratio + 0.08::DOUBLE * far_jump_ratio
    + 0.12::DOUBLE * CASE WHEN regexp_matches(lower(coalesce(ua, '')), '{SUSPECT}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + 0.07::DOUBLE * (1.0::DOUBLE - CASE WHEN {_browser.replace('(ua', "(lower(coalesce(ua, ''))")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))''')}, 10) AS bot_probability,
    mean_delta_t, low_latency_ratio
  FROM vf JOIN (SELECT session_id, max(user_agent) FILTER (seq = 1) AS ua FROM pg GROUP BY session_id) USING (session_id)"""
CTES["ranking"] = f"""
  SELECT p.*, bot_probability, CASE WHEN event_count < 2 THEN 'waiting' WHEN bot_probability >= {THRESHOLD}::DOUBLE THEN 'bot' ELSE 'human' END AS predicted_label,
    round(mean_delta_t, 4) AS mean_delta_t, round(low_latency_ratio, 4) AS low_latency_ratio
  FROM (SELECT session_id, count(*) >= 2 AS ready, count(*) AS event_count, max(path) FILTER (seq = 1) AS first_path,
      max(path) FILTER (seq = n_events) AS last_path,
      array_to_string(list(path ORDER BY seq) FILTER (seq > n_events - 8), ' ') AS recent_paths,
      round(max(timestamp) - min(timestamp), 1) AS duration_seconds,
      round(greatest(0.0::DOUBLE, {NOW}::DOUBLE - max(timestamp)), 1) AS last_seen_seconds_ago,
      coalesce(max(user_agent) FILTER (seq = n_events), '') AS user_agent, max(client_key) AS client_key
    FROM pg GROUP BY session_id) p LEFT JOIN vscore USING (session_id)"""


def live_rows(spark, sf):
    from clickwarden.operators.sessionize import sessionize

    events = materialized(sessionize(stored_requests(spark, sf), timeout=TIMEOUT, tie_breaker="event_id", min_length=1))
    kept = events.where(F.col("n_events") >= 2)
    features = materialized(feats.full_session_features(events, site_nodes(kept)))
    metadata = summaries.session_metadata(events)
    scored = rule_scores(features, metadata).withColumn("bot_probability", F.round("bot_probability", 10))
    return live.scored_sessions(events, scored, features, THRESHOLD, NOW)


_live = ["session_id", "ready", "event_count", "predicted_label", "first_path", "last_path", "recent_paths", "duration_seconds",
         "last_seen_seconds_ago", "user_agent", "client_key", "mean_delta_t", "low_latency_ratio"]


@register("live_session_ranking", query(
    f"SELECT {', '.join(_live)}, {r6('bot_probability')} AS bot_probability FROM ranking "
    "ORDER BY bot_probability IS NOT NULL DESC, bot_probability DESC, event_count DESC"))
def live_session_ranking(spark, sf):
    rows = live.rank_sessions(live_rows(spark, sf))
    return rounded(rows.withColumn("recent_paths", F.array_join("recent_paths", " ")).select(*_live, "bot_probability"), "bot_probability")


@register("live_session_totals", query(f"""
  SELECT count(*) AS total_sessions, count(*) FILTER (ready) AS ready_sessions,
    count(*) FILTER (ready AND bot_probability >= {THRESHOLD}::DOUBLE) AS flagged_sessions,
    round(max(bot_probability), 4) AS highest_probability, round(max(bot_probability) * 100, 1) AS highest_probability_pct,
    {THRESHOLD}::DOUBLE AS threshold FROM ranking"""))
def live_session_totals(spark, sf):
    return live.session_totals(live_rows(spark, sf), THRESHOLD)
