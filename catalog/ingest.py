"""Readers, scalar functions, label files, human import and page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickwarden.constants import LABEL_COLUMNS, LABEL_METADATA, TEMPLATE_COLUMNS
from clickwarden.functions.paths import is_page_path
from clickwarden.operators import labels as labelling, pagelinks
from clickwarden.operators.ranking import with_global_row_number
from clickwarden.operators.sessionize import check_session_requests, client_key, load_session_requests, sessionize
from clickwarden.operators.summary import label_votes
from clickwarden.plans.human_import import import_human_requests, preview_agent_counts
from clickwarden.session import ensure_checkpoint_dir, materialized
from clickwarden.sources.logs import (
    dedupe_lines, line_format, normalize_requests, parse_combined_log, read_requests, requests_since,
)
from clickwarden.sources.tables import write_table

from .common import all_events, labelled, page_events, rounded, stored_events
from .requests_view import TIMEOUT, requests_view, table
from .sql import ASSETS, CTES, query, r6, session_ctes

import uuid

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def wrap(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function
    return wrap


def scratch(spark, name):
    """A new folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


# --- log lines --------------------------------------------------------------------------------

def log_lines(spark, sf):
    """Combined-format lines of all requests, some with queries, fragments and full referrers."""
    requests = requests_view(spark, sf)
    time = F.date_format(F.timestamp_seconds(F.floor("timestamp")), "dd/MMM/yyyy:HH:mm:ss")
    target = F.concat("path", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("?k="), "event_id", F.lit("#top"))).otherwise(F.lit("")))
    referrer = F.when(F.col("event_id") % 8 == 0, F.concat(F.lit("https://site.example"), "path", F.lit("?r=1")))
    line = F.concat(
        F.col("ip"), F.lit(" - - ["), time, F.lit(' +0000] "'), "method", F.lit(" "), target, F.lit(' HTTP/1.1" '),
        F.col("status_code").cast("string"), F.lit(" "),
        F.when(F.col("event_id") % 5 == 0, F.lit("-")).otherwise(F.col("body_bytes_sent").cast("string")),
        F.lit(' "'), F.coalesce(referrer, "referrer", F.lit("-")), F.lit('" "'), F.coalesce("user_agent", F.lit("-")), F.lit('"'),
    )
    return requests.select("event_id", line.alias("value"))


_parsed = """
  SELECT event_id, ip, floor(timestamp) AS timestamp, method, path, status_code,
    CASE WHEN event_id % 5 <> 0 THEN body_bytes_sent END AS body_bytes_sent,
    CASE WHEN event_id % 8 = 0 THEN path ELSE referrer END AS referrer, user_agent FROM requests"""


@register("combined_log_parse", query(_parsed))
def combined_log_parse(spark, sf):
    return parse_combined_log(materialized(log_lines(spark, sf)), keep=["event_id"]).drop("label")


@register("combined_log_file", query(
    "SELECT ip, timestamp, method, path, status_code, body_bytes_sent, referrer, user_agent, count(*) AS copies FROM "
    f"({_parsed}) GROUP BY ALL"))
def combined_log_file(spark, sf):
    path = scratch(spark, "access_log")
    log_lines(spark, sf).select("value").write.text(path)
    parsed = read_requests(spark, path, "auto").drop("label")
    return parsed.groupBy(*parsed.columns).agg(F.count("*").alias("copies"))


@register("corrupt_log_lines", query("""
  SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'broken ' || event_id END AS corrupt_line,
    CASE WHEN event_id % 9 <> 0 THEN path END AS path FROM requests"""))
def corrupt_log_lines(spark, sf):
    lines = log_lines(spark, sf).withColumn(
        "value", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("broken "), "event_id")).otherwise(F.col("value")))
    return parse_combined_log(lines, on_error="keep", keep=["event_id"]).select("event_id", "corrupt_line", "path")


def raw_columns(spark, sf):
    """Requests under other column names, with untidy values."""
    requests = requests_view(spark, sf)
    event = F.col("event_id")
    return requests.select(
        "event_id",
        F.when(event % 3 == 0, F.date_format(F.timestamp_micros(F.round(F.col("timestamp") * 1000000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(event % 11 == 0, F.lit("no time")).otherwise(F.round("timestamp", 3).cast("decimal(20,3)").cast("string")).alias("Time"),
        F.when(event % 4 == 0, F.concat(F.lit("https://site.example"), "path", F.lit(";v=1?x=2")))
        .when(event % 4 == 1, F.concat(F.lit("  "), F.substring("path", 2, 100), F.lit("#part ")))
        .when(event % 13 == 0, F.lit(" ")).otherwise(F.col("path")).alias("URI"),
        F.when(event % 6 == 0, F.lit("oops")).otherwise(F.col("status_code").cast("string")).alias("status"),
        F.col("user_agent").alias("http_user_agent"),
        F.when(event % 5 == 0, F.lit("-")).when(event % 5 == 1, F.lit("https://other.example")).otherwise(F.col("referrer")).alias("Referer"),
        F.col("ip").alias("remote_addr"),
        F.when(event % 10 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("session_cookie"),
        F.lit("ignored").alias("extra"),
    )


_normalized = f"""
  SELECT event_id, {r6('CASE WHEN event_id % 3 = 0 THEN timestamp ELSE round(timestamp, 3) END')} AS timestamp,
    path, 'GET' AS method, CASE WHEN event_id % 6 <> 0 THEN status_code END AS status_code, user_agent,
    CASE WHEN event_id % 5 > 1 THEN referrer END AS referrer, ip,
    CASE WHEN event_id % 10 = 0 THEN 'c' || user_id END AS cookie_id
  FROM requests WHERE (event_id % 3 = 0 OR event_id % 11 <> 0) AND (event_id % 4 < 2 OR event_id % 13 <> 0)"""
_request_columns = ["timestamp", "path", "method", "status_code", "user_agent", "referrer", "ip", "cookie_id"]


@register("normalize_requests", query(_normalized))
def normalize(spark, sf):
    return rounded(normalize_requests(raw_columns(spark, sf), keep=["event_id"]).select("event_id", *_request_columns))


_counted = f"SELECT {', '.join(_request_columns)}, count(*) AS copies FROM ({_normalized}) GROUP BY ALL"


def _file_requests(spark, sf, file_format):
    path = scratch(spark, file_format)
    rows = raw_columns(spark, sf).drop("event_id")
    if file_format == "csv":
        rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        rows.write.json(path)
    read = rounded(read_requests(spark, path, "jsonl" if file_format == "json" else "csv").select(*_request_columns))
    return read.groupBy(*_request_columns).agg(F.count("*").alias("copies"))


@register("csv_requests", query(_counted))
def csv_requests(spark, sf):
    return _file_requests(spark, sf, "csv")


_note = '\n"beta", build'
_noted = f"SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN user_agent || '{_note}' ELSE user_agent END AS user_agent) FROM requests"


@register("csv_quoted_requests", query(
    f"SELECT event_id, user_agent, path, status_code FROM ({_noted})"))
def csv_quoted_requests(spark, sf):
    """Requests whose agents hold line feeds, quotes and commas, through CSV files."""
    path = scratch(spark, "csv_quoted")
    rows = requests_view(spark, sf).select("event_id", "timestamp", "path", "status_code", "ip", F.when(
        F.col("event_id") % 7 == 0, F.concat("user_agent", F.lit(_note))).otherwise(F.col("user_agent")).alias("user_agent"))
    rows.write.csv(path, header=True, escape='"')
    read = read_requests(spark, path, "csv", keep=["event_id"])
    return read.select(F.col("event_id").cast("bigint").alias("event_id"), "user_agent", "path", "status_code")


@register("jsonl_requests", query(_counted))
def jsonl_requests(spark, sf):
    return _file_requests(spark, sf, "json")


@register("request_line_paths", query(
    "SELECT event_id, path FROM requests WHERE event_id % 7 <> 0"))
def request_line_paths(spark, sf):
    line = F.when(F.col("event_id") % 7 == 0, F.lit("GET")).otherwise(F.concat(F.lit("GET  "), "path", F.lit("?a=b HTTP/1.1")))
    raw = requests_view(spark, sf).select("event_id", "timestamp", line.alias("request_line"))
    return normalize_requests(raw, keep=["event_id"]).select("event_id", "path")


@register("format_inference", query("""
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'jsonl' WHEN 1 THEN 'combined' ELSE 'csv' END AS format FROM requests"""))
def format_inference(spark, sf):
    lines = log_lines(spark, sf).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_id")))
                                            .when(F.col("event_id") % 3 == 2, F.lit("time,path,status")).otherwise(F.col("value")))
    return lines.select("event_id", line_format(F.col("value")).alias("format"))


@register("log_union_dedupe", query("""
  SELECT DISTINCT ip || ' ' || path AS line FROM requests"""))
def log_union_dedupe(spark, sf):
    lines = requests_view(spark, sf).select(F.concat("ip", F.lit(" "), "path").alias("value"))
    return dedupe_lines(lines.unionByName(lines)).select(F.col("value").alias("line"))


@register("start_cutoff", query("SELECT event_id, path FROM requests WHERE timestamp >= 1705000000::DOUBLE"))
def start_cutoff(spark, sf):
    return requests_since(requests_view(spark, sf), 1_705_000_000).select("event_id", "path")


@register("asset_filter", query(f"SELECT event_id, path, NOT regexp_matches(lower(path), '{ASSETS}') AS is_page FROM requests"))
def asset_filter(spark, sf):
    return requests_view(spark, sf).select("event_id", "path", is_page_path(F.col("path")).alias("is_page"))


@register("client_keys", query("""
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'cookie_id:c' || user_id WHEN event_id % 3 = 1 THEN 'client_id:v' || user_id
    ELSE 'ip_ua:' || ip || '|' || coalesce(user_agent, 'None') END AS client_key FROM requests"""))
def client_keys(spark, sf):
    user = F.col("user_id").cast("string")
    requests = requests_view(spark, sf).drop("client_key").withColumns({
        "cookie_id": F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" c"), user)).otherwise(F.lit(" ")),
        "client_id": F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("v"), user)),
    })
    return requests.select("event_id", client_key(requests).alias("client_key"))


@register("session_ids", query(
    "SELECT session_id, client_key, session_index, count(*) AS num_events FROM allev GROUP BY ALL"))
def session_ids(spark, sf):
    return all_events(spark, sf).groupBy("session_id", "client_key", "session_index").agg(F.count("*").alias("num_events"))


def _labelled_requests(spark, sf):
    user, event = F.col("user_id") % 4, F.col("event_id")
    label = F.when(user == 0, F.lit(" BOT ")).when(user == 1, F.lit("human")).when((user == 2) & (event % 2 == 0), F.lit("bot")).when(
        user == 2, F.lit("human"))
    return requests_view(spark, sf).withColumn("label", label)


_voted = """SELECT session_id, CASE WHEN count(DISTINCT l) = 1 THEN max(l) ELSE 'unknown' END AS label, count(*) AS num_events FROM (
  SELECT session_id, CASE user_id % 4 WHEN 0 THEN 'bot' WHEN 1 THEN 'human'
    WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'bot' ELSE 'human' END END AS l FROM ev) GROUP BY session_id"""


@register("session_label_vote", query(_voted))
def session_label_vote(spark, sf):
    return label_votes(sessionize(materialized(_labelled_requests(spark, sf)), timeout=TIMEOUT, tie_breaker="event_id"))


@register("request_reload_check", query("""
  SELECT session_id, count(*) AS num_requests, count(DISTINCT l) AS num_labels,
    count(*) FILTER (l NOT IN ('bot', 'human', 'unknown')) AS num_unsupported,
    count(DISTINCT l) = 1 AND count(*) FILTER (l NOT IN ('bot', 'human', 'unknown')) = 0 AS is_valid
  FROM (SELECT session_id, CASE WHEN event_id % 50 = 0 THEN 'other' WHEN user_id % 4 = 0 THEN 'bot' ELSE 'human' END AS l FROM ev)
  GROUP BY session_id"""))
def request_reload_check(spark, sf):
    label = F.when(F.col("event_id") % 50 == 0, F.lit("other")).when(F.col("user_id") % 4 == 0, F.lit("Bot ")).otherwise(F.lit("human"))
    return check_session_requests(page_events(spark, sf).withColumn("label", label))


@register("session_reload", query(f"""
  SELECT session_id, event_id, seq, n_events, path, prev_path, prev2_path, label, referrer, {r6('delta_t')} AS delta_t FROM lev"""))
def session_reload(spark, sf):
    folder = scratch(spark, "reload")
    columns = ["session_id", "timestamp", "path", "delta_t", "label", "page_category", "referrer", "user_agent", "status_code", "event_id"]
    write_table(labelled(spark, sf)[0].select(*columns), folder, "requests", "csv")
    stored = spark.read.csv(f"{folder}/requests", header=True, escape='"')
    events = load_session_requests(stored)
    return rounded(events.select(
        "session_id", F.col("event_id").cast("bigint").alias("event_id"), "seq", "n_events", "path", "prev_path",
        "prev2_path", "label", "referrer", "delta_t"))


# --- human import -----------------------------------------------------------------------------

def human_requests(spark, sf):
    agent = F.when(F.col("event_id") % 7 == 0, F.concat(F.col("user_agent"), F.lit(" WhatsApp/2.1"))).when(
        F.col("event_id") % 11 == 0, F.lit("Googlebot/2.1")).otherwise(F.col("user_agent"))
    return requests_view(spark, sf).withColumn("user_agent", agent)


_is_preview = "((event_id % 7 = 0 AND user_agent IS NOT NULL) OR (event_id % 7 <> 0 AND event_id % 11 = 0))"
CTES.update(session_ctes("hev", f"NOT {_is_preview} AND NOT regexp_matches(lower(path), '{ASSETS}')", 2))
CTES["human_number"] = """
  SELECT session_id, 'human_manual_' || printf('%03d', row_number() OVER (ORDER BY timestamp, session_id)) AS participant_id,
    timestamp AS start_timestamp FROM hev WHERE seq = 1"""


@register("preview_agent_filter", query(
    f"SELECT count(*) FILTER (NOT {_is_preview}) AS num_requests, count(*) FILTER ({_is_preview}) AS num_filtered FROM requests"))
def preview_agent_filter(spark, sf):
    return preview_agent_counts(human_requests(spark, sf))


@register("participant_numbering", query(
    "SELECT session_id, 'human_manual_' || printf('%03d', row_number() OVER (ORDER BY start_timestamp, session_id)) AS participant_id FROM summary"))
def participant_numbering(spark, sf):
    return labelling.number_participants(page_events(spark, sf)).select("session_id", "participant_id")


def _iso(column):
    return (f"strftime(make_timestamp(CAST(round({column} * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || "
            f"CASE WHEN CAST(round({column} * 1000000) AS BIGINT) % 1000000 <> 0 THEN strftime(make_timestamp(CAST(round({column} * 1000000) AS BIGINT)), '.%f') ELSE '' END || '+00:00'")


@register("human_manifest", query(f"""
  SELECT session_id, 'human' AS label, participant_id, 'human_navigation' AS traffic_family, num_events, {r6('t1 - t0')} AS duration_seconds,
    first_path, {_iso('t0')} AS start_time_utc, {_iso('t1')} AS end_time_utc, path_signature, paths
  FROM (SELECT session_id, count(*) AS num_events, min(timestamp) AS t0, max(timestamp) AS t1, max(path) FILTER (seq = 1) AS first_path,
      string_agg(path, ' > ' ORDER BY seq) AS path_signature, string_agg(path, ' | ' ORDER BY seq) AS paths FROM hev GROUP BY session_id)
  JOIN human_number USING (session_id)"""))
def human_manifest(spark, sf):
    result = import_human_requests(materialized(human_requests(spark, sf)), timeout=TIMEOUT, tie_breaker="event_id")
    return rounded(result["manifest"].select(
        "session_id", "label", "participant_id", "traffic_family", "num_events", "duration_seconds", "first_path",
        "start_time_utc", "end_time_utc", "path_signature", "paths"))


_key_cases = "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'client_id:' || user_id END"


@register("label_upsert", query(f"""
  SELECT coalesce(f.client_key, o.client_key, '') AS client_key, coalesce(f.session_id, o.session_id, '') AS session_id,
    coalesce(f.label, o.label, '') AS label, coalesce(f.notes, o.notes, '') AS notes
  FROM (SELECT 'client_id:' || user_id AS k, 'client_id:' || user_id AS client_key, '' AS session_id, 'unknown' AS label,
      'old ' || max(event_id) AS notes FROM events WHERE user_id % 2 = 0 GROUP BY user_id) o
  FULL JOIN (SELECT k, arg_max(client_key, event_id) FILTER (client_key <> '') AS client_key,
      arg_max(session_id, event_id) FILTER (session_id <> '') AS session_id,
      arg_max(label, event_id) FILTER (label <> '') AS label, arg_max(notes, event_id) FILTER (notes <> '') AS notes
    FROM (SELECT event_id, {_key_cases} AS client_key, CASE WHEN event_id % 3 = 0 THEN 's' || user_id ELSE ' ' END AS session_id,
        CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'bot' ELSE 'human' END AS label,
        CASE WHEN event_id % 4 = 0 THEN 'note ' || event_id ELSE '' END AS notes,
        CASE WHEN event_id % 3 = 0 THEN 's' || user_id ELSE 'client_id:' || user_id END AS k
      FROM events WHERE event_id % 3 < 2) GROUP BY k) f USING (k)"""))
def label_upsert(spark, sf):
    events = table(spark, sf, "events")
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    existing = events.where(F.col("user_id") % 2 == 0).select(
        F.concat(F.lit("client_id:"), user).alias("client_key"), F.lit("unknown").alias("label"),
        F.concat(F.lit("old "), event.cast("string")).alias("notes"), "event_id")
    # rows without any key are dropped by the merge
    new = events.select(
        F.when(event % 3 == 1, F.concat(F.lit("client_id:"), user)).otherwise(F.lit("")).alias("client_key"),
        F.when(event % 3 == 0, F.concat(F.lit("s"), user)).otherwise(F.lit(" ")).alias("session_id"),
        F.when(event % 5 == 0, F.lit("")).when(event % 2 == 0, F.lit("bot")).otherwise(F.lit("human")).alias("label"),
        F.when(event % 4 == 0, F.concat(F.lit("note "), event.cast("string"))).alias("notes"), "event_id")
    return labelling.upsert_labels(existing, new, "event_id").select("client_key", "session_id", "label", "notes")


@register("annotation_template", query(f"""
  SELECT session_id, client_key, '' AS label, {', '.join(LABEL_METADATA)}, num_events, {r6('duration_seconds')} AS duration_seconds,
    first_path, {r6('start_timestamp')} AS start_timestamp, user_agent, proposed_label
  FROM labelled_summary WHERE proposed_label = 'unknown' ORDER BY participant_id, session_id"""))
def annotation_template(spark, sf):
    return rounded(labelling.annotation_template(labelled(spark, sf)[1], only_unknown=True), "duration_seconds", "start_timestamp")


# --- page links -------------------------------------------------------------------------------

_attr = lambda name: (
    "regexp_extract(tag, '(?i)\\s" + name + "\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', 1) || "
    "regexp_extract(tag, '(?i)\\s" + name + "\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', 2) || "
    "regexp_extract(tag, '(?i)\\s" + name + "\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', 3)")
_unescape = lambda x: f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
CTES["tags"] = r"""
  SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)(<script\b[^>]*>).*?</script\s*>', '\1', 'g'), '(?is)(<style\b[^>]*>).*?</style\s*>', '\1', 'g'),
    '(?i)<(?:a|img|script|link)\b[^>]*>', 0)) AS tag FROM pages"""
CTES["refs"] = f"""
  SELECT page_id, url, host, base_path, kind, {_unescape('ref')} AS ref FROM (
    SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
      coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS base_path,
      CASE WHEN regexp_matches(tag, '(?i)^<a\\b') THEN 'link' ELSE 'asset' END AS kind,
      CASE WHEN regexp_matches(tag, '(?i)^<(a|link)\\b') THEN {_attr('href')} ELSE {_attr('src')} END AS ref
    FROM tags) WHERE ref <> ''"""
_ignored = "(ref LIKE 'mailto:%' OR ref LIKE 'tel:%' OR ref LIKE 'javascript:%' OR ref LIKE '#%')"
_scheme = "regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.\\-]*:')"
CTES["resolved"] = f"""
  SELECT *, CASE WHEN regexp_extract(ref, '^[^?#]*') LIKE '/%' THEN regexp_extract(ref, '^[^?#]*')
      WHEN regexp_extract(ref, '^[^?#]*') = '' THEN NULL
      ELSE regexp_replace(base_path, '[^/]*$', '') || regexp_extract(ref, '^[^?#]*') END AS joined,
    {_ignored} AS ignored, {_scheme} AS has_scheme FROM refs"""
CTES["page_refs"] = """
  SELECT page_id, url, host, kind, ref,
    CASE WHEN NOT ignored AND NOT has_scheme AND NOT regexp_matches(ref, '^//[^/?#]') THEN regexp_replace(joined, ';[^/]*$', '') END AS local_target,
    CASE WHEN ignored THEN NULL
      WHEN has_scheme THEN CASE WHEN regexp_extract(ref, '^https?://([^/?#]*)', 1) = host THEN regexp_extract(ref, '^[^#]*') END
      WHEN ref LIKE '//%' THEN CASE WHEN regexp_extract(ref, '^//([^/?#]*)', 1) = host THEN regexp_extract(url, '^https?:') || regexp_extract(ref, '^[^#]*') END
      ELSE regexp_extract(url, '^https?://[^/?#]*') || coalesce(joined, base_path) || regexp_extract(regexp_extract(ref, '^[^#]*'), '(\\?.*)$', 1) END AS internal
  FROM resolved"""


@register("page_links", query("SELECT page_id, kind, ref, local_target, internal, count(*) AS copies FROM page_refs GROUP BY ALL"))
def page_links(spark, sf):
    links = pagelinks.page_links(table(spark, sf, "pages"))
    return links.groupBy("page_id", "kind", "ref", "local_target", "internal").agg(F.count("*").alias("copies"))


_page_key = "host || regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"
_known = "SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS k FROM pages"


@register("broken_links", query(
    f"SELECT page_id, kind, ref, host || local_target AS target_page, count(*) AS copies FROM page_refs WHERE local_target IS NOT NULL "
    f"AND host || local_target NOT IN (SELECT k FROM ({_known})) GROUP BY ALL"))
def broken_links(spark, sf):
    broken = pagelinks.broken_links(table(spark, sf, "pages"))
    return broken.groupBy(*broken.columns).agg(F.count("*").alias("copies"))


@register("page_edges", query(r"""
  SELECT DISTINCT host || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS source,
    host || coalesce(nullif(regexp_extract(internal, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS target
  FROM page_refs WHERE kind = 'link' AND internal IS NOT NULL AND NOT regexp_matches(lower(regexp_extract(internal, '^https?://[^/?#]*([^?#]*)', 1)),
    '\.(xml|txt|json|csv|css|js|svg|png|jpg|jpeg|webp|ico)$')"""))
def page_edges(spark, sf):
    return pagelinks.page_edges(table(spark, sf, "pages"))
