"""Streaming queries, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickwarden.functions.paths import is_page_path
from clickwarden.session import materialized
from clickwarden.streaming.late import start_late_split
from clickwarden.streaming.scorer import active_sessions, start_scoring
from clickwarden.streaming.sessions import closed_sessions
from clickwarden.streaming.sources import stream_log_folder, with_event_time

from .common import page_events, rounded, site_nodes, stored_events, stored_requests
from .evaluation import THRESHOLD, _browser, _clip
from .ingest import _parsed, log_lines, scratch
from .requests_view import TIMEOUT, requests_view
from .sql import CTES, SUSPECT, feature_ctes, query, r6

QUERIES, SQL = {}, {}
PARTS = 3
# files of each part, so that a part is one micro-batch
FILES = 4
LATENESS = 3600
EXPIRE = 21_600
EXPIRY_PARTS = 8
ARRIVALS, LATE_AFTER = 4, 864_000
RESET_EVERY = 4


def register(name, sql=None):
    def wrap(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function
    return wrap


def time_part(df, parts):
    """Number of the equal stretch of time that a row lies in."""
    low, high = df.agg(F.min("timestamp"), F.max("timestamp")).head()
    width = ((high or 0.0) - (low or 0.0)) / parts
    return F.least(F.floor((F.col("timestamp") - low) / width), F.lit(parts - 1)) if width else F.lit(0)


def in_parts(df, folder, part, parts, *keys):
    """Write all rows part by part, so that a stream reads one part after the other."""
    for index in range(parts):
        df.where(part == index).repartition(FILES, *keys).write.mode("append").parquet(folder)
    return folder


def in_time_order(df, folder, *keys):
    return in_parts(df, folder, time_part(df, PARTS), PARTS, *keys)


def read_parts(spark, folder, schema=None):
    schema = schema or spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def run_scorer(spark, sf, requests=None, **options):
    events = stored_events(spark, sf)
    columns = ["session_id", "timestamp", "path", "raw_referrer", "user_agent", "status_code"]
    rows = events.select(*columns).withColumnRenamed("raw_referrer", "referrer") if requests is None else requests(events)
    # a session's requests of one part lie in one file
    stream = read_parts(spark, in_time_order(rows, scratch(spark, "stream_in"), "session_id"))
    output, checkpoint = scratch(spark, "stream_out"), scratch(spark, "stream_state")
    nodes = materialized(site_nodes(events))
    start_scoring(stream, nodes, output, checkpoint, threshold=THRESHOLD, availableNow=True, **options).awaitTermination()
    return output, checkpoint


def rule_score_sql(features, events):
    return f"""
  SELECT session_id, prefix_len, {_clip(f'''(0.28::DOUBLE * {_clip('1.0::DOUBLE - navigation_entropy_score')} + 0.16::DOUBLE * repeated_transition_ratio
    + 0.17::DOUBLE * low_latency_ratio + 0.12::DOUBLE * leaf_visit_ratio + 0.08::DOUBLE * far_jump_ratio
    + 0.12::DOUBLE * CASE WHEN regexp_matches(lower(coalesce(agent, '')), '{SUSPECT}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    + 0.07::DOUBLE * (1.0::DOUBLE - CASE WHEN {_browser.replace('(ua', "(lower(coalesce(agent, ''))")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))''')} AS bot_probability
  FROM {features} JOIN (SELECT session_id, max(user_agent) FILTER (seq = 1) AS agent FROM {events} GROUP BY session_id) USING (session_id)"""


CTES["oscore"] = rule_score_sql("of", "ev")
# every session forgotten after each fourth request
CTES["rev"] = f"""
  SELECT * REPLACE (session_id || '#' || ((seq - 1) // {RESET_EVERY}) AS session_id, (seq - 1) % {RESET_EVERY} + 1 AS seq,
    least({RESET_EVERY}, n_events - (seq - 1) // {RESET_EVERY} * {RESET_EVERY}) AS n_events,
    CASE WHEN (seq - 1) % {RESET_EVERY} > 0 THEN prev_path END AS prev_path,
    CASE WHEN (seq - 1) % {RESET_EVERY} > 1 THEN prev2_path END AS prev2_path,
    CASE WHEN (seq - 1) % {RESET_EVERY} > 0 THEN prev_category END AS prev_category,
    CASE WHEN (seq - 1) % {RESET_EVERY} > 0 THEN prev_user_agent END AS prev_user_agent)
  FROM lev"""
CTES.update(feature_ctes("rf", "rev", "range(greatest(seq, 2), n_events + 1)", "nodes", None))
CTES["rscore"] = rule_score_sql("rf", "rev")


@register("online_scorer", query(f"""
  SELECT session_id, CAST(seq AS INT) AS prefix_len, seq >= 2 AS ready, {r6('bot_probability')} AS bot_probability
  FROM ev LEFT JOIN oscore o ON o.session_id = ev.session_id AND o.prefix_len = ev.seq""".replace("SELECT session_id", "SELECT ev.session_id")))
def online_scorer(spark, sf):
    output, _ = run_scorer(spark, sf)
    return rounded(spark.read.parquet(output).select("session_id", "prefix_len", "ready", "bot_probability"))


@register("active_sessions", query("SELECT DISTINCT session_id FROM ev"))
def active(spark, sf):
    return active_sessions(spark, run_scorer(spark, sf)[1])


def with_resets(events):
    """Requests in the order of ``place``, with a reset after each fourth one of a session."""
    request = events.select(
        "session_id", "timestamp", "path", "user_agent", "status_code", F.lit("event").alias("op"), (F.col("seq") * 2).alias("place"))
    reset = events.where(F.col("seq") % RESET_EVERY == 0).select(
        "session_id", "timestamp", F.lit("").alias("path"), F.lit(None).cast("string").alias("user_agent"),
        F.lit(None).cast("int").alias("status_code"), F.lit("reset").alias("op"), (F.col("seq") * 2 + 1).alias("place"))
    return request.unionByName(reset)


@register("session_reset", query(f"""
  SELECT split_part(rev.session_id, '#', 1) AS session_id, CAST(split_part(rev.session_id, '#', 2) AS INT) AS visit,
    CAST(seq AS INT) AS prefix_len, seq >= 2 AS ready, {r6('bot_probability')} AS bot_probability
  FROM rev LEFT JOIN rscore o ON o.session_id = rev.session_id AND o.prefix_len = rev.seq"""))
def session_reset(spark, sf):
    output, _ = run_scorer(spark, sf, with_resets, sequence="place")
    return rounded(spark.read.parquet(output).select("session_id", "visit", "prefix_len", "ready", "bot_probability"))


_expiry = {
    "time_range": f"SELECT min(timestamp) AS low, (max(timestamp) - min(timestamp)) / {EXPIRY_PARTS} AS width FROM requests",
    "part_rows": f"""
      SELECT client_key, timestamp, least(floor((timestamp - low) / width), {EXPIRY_PARTS - 1}) AS part FROM requests, time_range""",
    "part_tops": "SELECT part, max(max(timestamp)) OVER (ORDER BY part) AS top FROM part_rows GROUP BY part",
    "client_parts": """
      SELECT client_key, part, lag(part) OVER c AS before, lag(max(timestamp)) OVER c AS last
      FROM part_rows GROUP BY client_key, part WINDOW c AS (PARTITION BY client_key ORDER BY part)""",
    # a timer fires at the end of a batch in between whose watermark has passed it
    "fresh_parts": f"""
      SELECT client_key, part, coalesce(part - before >= 2 AND top - {LATENESS} >= last + {EXPIRE}, false) AS fresh
      FROM client_parts LEFT JOIN (SELECT part + 2 AS part, top FROM part_tops) USING (part)""",
    "client_visits": """
      SELECT client_key, part, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY client_key ORDER BY part) AS visit
      FROM fresh_parts""",
}


@register("session_expiry", query(f"""
  SELECT client_key, {r6('timestamp')} AS timestamp, {r6('min(timestamp) OVER (PARTITION BY client_key, visit)')} AS started,
    CAST(row_number() OVER (PARTITION BY client_key, visit ORDER BY timestamp) AS INT) AS prefix_len
  FROM part_rows JOIN client_visits USING (client_key, part)""", _expiry))
def session_expiry(spark, sf):
    requests = stored_requests(spark, sf).select("client_key", "timestamp", "path", "user_agent", "status_code")
    folder = in_parts(requests, scratch(spark, "expiry_in"), time_part(requests, EXPIRY_PARTS), EXPIRY_PARTS)
    output = scratch(spark, "expiry_out")
    start_scoring(
        read_parts(spark, folder), materialized(site_nodes(page_events(spark, sf))), output, scratch(spark, "expiry_state"),
        expire_seconds=EXPIRE, lateness=f"{LATENESS} seconds", session_column="client_key", availableNow=True).awaitTermination()
    rows = spark.read.parquet(output).withColumnRenamed("session_id", "client_key")
    return rounded(rows.select("client_key", "timestamp", "started", "prefix_len"))


_late = {
    "arrival_tops": f"SELECT event_id % {ARRIVALS} AS part, max(timestamp) AS top FROM requests GROUP BY ALL",
    "arrival_marks": f"""
      SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATE_AFTER} AS mark
      FROM arrival_tops""",
}


@register("late_requests", query(f"""
  SELECT event_id, client_key, {r6('timestamp')} AS timestamp, coalesce(timestamp < mark, false) AS late,
    CASE WHEN timestamp < mark THEN {r6('mark')} END AS watermark
  FROM requests JOIN arrival_marks ON part = event_id % {ARRIVALS}""", _late))
def late_requests(spark, sf):
    requests = stored_requests(spark, sf).select("event_id", "client_key", "timestamp")
    folder = in_parts(requests, scratch(spark, "late_in"), F.col("event_id") % ARRIVALS, ARRIVALS)
    on_time, late = scratch(spark, "on_time"), scratch(spark, "late")
    start_late_split(read_parts(spark, folder), on_time, late, scratch(spark, "late_state"), LATE_AFTER, availableNow=True).awaitTermination()
    schema = "event_id bigint, client_key string, timestamp double, watermark double"
    rows = spark.read.schema(schema).parquet(on_time).withColumn("late", F.lit(False)).unionByName(
        spark.read.schema(schema).parquet(late).withColumn("late", F.lit(True)))
    return rounded(rows.select("event_id", "client_key", "timestamp", "late", "watermark"))


@register("stream_sessions", query(f"""
  SELECT client_key, {r6('min(timestamp)')} AS first_time, {r6('max(timestamp)')} AS last_time, count(*) AS num_events
  FROM (SELECT *, max(timestamp) OVER () AS newest FROM pg) GROUP BY client_key, session_index, newest
  HAVING max(timestamp) + {TIMEOUT}::DOUBLE <= newest - {LATENESS}"""))
def stream_sessions(spark, sf):
    pages = requests_view(spark, sf).where(is_page_path(F.col("path"))).select("client_key", "timestamp")
    folder = in_time_order(pages, scratch(spark, "windows_in"))
    stream = with_event_time(read_parts(spark, folder, "client_key string, timestamp double"))
    output = scratch(spark, "windows_out")
    closed = closed_sessions(stream, int(TIMEOUT), f"{LATENESS} seconds")
    closed.writeStream.outputMode("append").format("parquet").option("path", output).option(
        "checkpointLocation", scratch(spark, "windows_state")).trigger(availableNow=True).start().awaitTermination()
    seconds = lambda c: (F.unix_micros(c) / F.lit(1_000_000.0)).alias(c)
    return rounded(spark.read.parquet(output).select("client_key", seconds("first_time"), seconds("last_time"), "num_events"))


@register("live_log_stream", query(
    f"SELECT path, status_code, count(*) AS num_requests FROM ({_parsed}) GROUP BY path, status_code"))
def live_log_stream(spark, sf):
    folder, output = scratch(spark, "live_log"), scratch(spark, "live_out")
    log_lines(spark, sf).select("value").write.text(folder)
    stream = stream_log_folder(spark, folder)
    stream.writeStream.format("parquet").option("path", output).option(
        "checkpointLocation", scratch(spark, "live_state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(output).groupBy("path", "status_code").agg(F.count("*").alias("num_requests"))
