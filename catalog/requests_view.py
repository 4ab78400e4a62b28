"""The ``requests`` view over ``events``: the same expressions for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TIMEOUT = 43_200.0
# added to some responses: more bytes than 32 bits hold
LARGE_BODY = 3_000_000_000
PREFIXES = [3, 5, 10, 15, 20]

CHROME = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36"
FIREFOX = "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0"
AGENTS = ["python-requests/2.31", CHROME, FIREFOX, "ResearchScraper-BFS/1.0", CHROME + " ResearchStealth/1.0"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests derived from all rows of ``events``."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id") % 6
    agent = F.when(user == 0, AGENTS[0])
    for index, text in enumerate(AGENTS[1:], start=1):
        agent = agent.when(user == index, text)
    page = F.concat(
        F.lit("/"), "event_type", F.lit("/"), (k % 40).cast("string"),
        F.when(k % 10 == 0, F.lit(".css")).otherwise(F.lit("")),
    )
    return events.select(
        "event_id",
        "user_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)).alias("timestamp"),
        F.concat(F.lit("client_id:"), F.col("user_id").cast("string")).alias("client_key"),
        F.concat(F.lit("203.0.113."), (F.col("user_id") % 200 + 1).cast("string")).alias("ip"),
        F.when(F.col("event_type") == "signup", F.lit("/")).otherwise(page).alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.when(F.col("event_id") % 4 == 0, F.lit("/")).alias("referrer"),
        F.lit("GET").alias("method"),
        (F.floor(F.col("value") * 100).cast("bigint") + F.when(F.col("event_id") % 97 == 0, LARGE_BODY).otherwise(0))
        .alias("body_bytes_sent"),
        agent.alias("user_agent"),
        F.when(user.isin(1, 2), F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("participant_id"),
    )


_AGENT_SQL = "CASE user_id % 6 " + " ".join(
    f"WHEN {i} THEN '{text}'" for i, text in enumerate(AGENTS)
) + " END"

REQUESTS_SQL = f"""
requests AS (
  SELECT event_id, user_id,
    epoch_us(ts) / 1000000.0::DOUBLE AS timestamp,
    'client_id:' || user_id AS client_key,
    '203.0.113.' || (user_id % 200 + 1) AS ip,
    CASE WHEN event_type = 'signup' THEN '/'
         ELSE '/' || event_type || '/' || (k % 40) || CASE WHEN k % 10 = 0 THEN '.css' ELSE '' END
    END AS path,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
    CASE WHEN event_id % 4 = 0 THEN '/' END AS referrer,
    'GET' AS method,
    CAST(floor(value * 100) AS BIGINT) + CASE WHEN event_id % 97 = 0 THEN {LARGE_BODY} ELSE 0 END AS body_bytes_sent,
    {_AGENT_SQL} AS user_agent,
    CASE WHEN user_id % 6 IN (1, 2) THEN 'p' || user_id END AS participant_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""
