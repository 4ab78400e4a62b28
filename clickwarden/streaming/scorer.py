"""Scoring of live sessions request by request.

A keyed state holds running sums of each session (``running``). Every new request emits one row of them,
and the expressions of the batch features turn these sums into features and scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.agents import is_browser_like, is_suspect_agent
from ..functions.paths import path_category
from ..functions.values import text_or_null
from ..operators.features import features_of_sums
from ..operators.models import ModelBundle
from ..operators.scoring import rule_score
from .running import PACKED_SCHEMA, REQUEST_COLUMNS, RunningSums, unpacked

_KEYS = ["session_id", "visit", "prefix_len"]
_STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Scores of feature rows that also hold ``first_agent``: their keys, ``bot_probability`` and ``model_version``.
Scorer = Callable[[DataFrame], DataFrame]


def running_sums(
    requests: DataFrame, nodes: DataFrame, expire_seconds: float | None = None, lateness: str = "10 minutes",
    sequence: str | None = None, session_column: str = "session_id",
) -> DataFrame:
    """Sums of a stream of requests with a session column, path, timestamp and optional columns, one row per request.

    Requests of one micro-batch are taken in the order of the column ``sequence``, else of time and path; a request
    earlier than the one before it has a gap of 0. ``op`` = ``reset`` forgets the session at its place. With
    ``expire_seconds`` a session is forgotten that long after its last request (event time) and requests later than
    ``lateness`` are dropped; without it state is kept until a reset. ``nodes`` may hold ``hubs_out`` and ``hubs_in``
    (``hub_labels``); without them the graph is taken to hold every step.
    """
    optional = lambda name: text_or_null(F.col(name)) if name in requests.columns else F.lit(None).cast("string")
    op = F.coalesce(optional("op"), F.lit("event"))
    stamp = F.col("timestamp").cast("double")
    now = F.when(op != "reset", F.unix_micros(F.current_timestamp()) / 1e6)
    status = F.col("status_code").cast("int") if "status_code" in requests.columns else F.lit(None).cast("int")
    as_json = lambda name: F.to_json(F.col(name)) if name in nodes.columns else F.lit(None).cast("string")
    attributes = nodes.select(
        "path", "depth", "out_degree", "is_leaf",
        (F.col("category") if "category" in nodes.columns else F.lit(None).cast("string")).alias("_category"),
        as_json("hubs_out").alias("hubs_out"), as_json("hubs_in").alias("hubs_in"))
    rows = requests.select(
        F.col(session_column).alias("session_id"), op.alias("op"), F.coalesce(stamp, now).alias("timestamp"), "path",
        optional("page_category").alias("_given"), optional("user_agent").alias("user_agent"), status.alias("status_code"),
        (F.col(sequence).cast("double") if sequence else F.coalesce(stamp, now)).alias("order_1"),
        (F.lit("") if sequence else F.col("path")).alias("order_2"),
    )
    mode = "None"
    if expire_seconds is not None:
        micros = F.round(F.col("timestamp") * F.lit(1_000_000.0)).cast("bigint")
        rows = rows.withColumn("event_time", F.timestamp_micros(micros)).withWatermark("event_time", lateness)
        mode = "EventTime"
    rows = rows.join(attributes, "path", "left").withColumns({
        "depth": F.coalesce("depth", F.lit(-1)), "out_degree": F.coalesce("out_degree", F.lit(0)),
        "is_leaf": F.coalesce("is_leaf", F.lit(False)),
        "page_category": F.coalesce("_given", "_category", path_category(F.col("path"))),
    })
    request = F.to_json(F.struct(*REQUEST_COLUMNS)).alias("request")
    rows = rows.select("session_id", request, *(["event_time"] if expire_seconds is not None else []))
    return unpacked(rows.groupBy("session_id").transformWithState(
        statefulProcessor=RunningSums(expire_seconds), outputStructType=PACKED_SCHEMA, outputMode="Append", timeMode=mode
    ))


def rule_scorer(features: DataFrame) -> DataFrame:
    """Rule score with the agent of the session's first request."""
    cued = features.withColumns({
        "has_suspect_user_agent": is_suspect_agent(F.col("first_agent")).cast("double"),
        "ua_browser_like": is_browser_like(F.col("first_agent")).cast("double"),
    })
    return cued.select(*_KEYS, rule_score(cued.columns).alias("bot_probability"), F.lit("rule").alias("model_version"))


class BundleScorer:
    """Scores of the newest saved bundle below a folder: the sub-folder with the greatest name.

    It is looked up for every micro-batch, so a bundle saved while the stream runs scores from the next batch on.
    """

    def __init__(self, folder: str):
        self.folder, self._version, self._bundle = folder.rstrip("/"), None, None

    def newest(self, spark: SparkSession) -> str:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        names = sorted(entry.getPath().getName() for entry in found if entry.isDirectory())
        if not names:
            raise ValueError(f"no bundle below {self.folder}")
        return names[-1]

    def __call__(self, features: DataFrame) -> DataFrame:
        version = self.newest(features.sparkSession)
        if version != self._version:
            self._bundle = ModelBundle.load(features.sparkSession, f"{self.folder}/{version}")
            self._version = version
        return self._bundle.model.score(features, _KEYS).withColumn("model_version", F.lit(version))


def score_sums(sums: DataFrame, scorer: Scorer = rule_scorer, threshold: float = 0.5) -> DataFrame:
    """One row per request: ready, probability and label; not ready before the second request."""
    scores = scorer(features_of_sums(sums.where(F.col("prefix_len") >= 2), [*_KEYS, "first_agent"]))
    probability: Column = F.col("bot_probability")
    return sums.select(*_KEYS, "started", "timestamp", "path").join(scores, _KEYS, "left").select(
        *_KEYS, "started", "timestamp", "path", (F.col("prefix_len") >= 2).alias("ready"), probability.alias("bot_probability"),
        F.when(probability >= threshold, "bot").when(probability.isNotNull(), "human").alias("predicted_label"), "model_version",
    )


def start_scoring(
    requests: DataFrame, nodes: DataFrame, output: str, checkpoint: str, *, scorer: Scorer = rule_scorer, threshold: float = 0.5,
    expire_seconds: float | None = None, lateness: str = "10 minutes", sequence: str | None = None,
    session_column: str = "session_id", **trigger,
) -> StreamingQuery:
    """Start the scoring query; a repeated micro-batch replaces its own output."""
    spark = requests.sparkSession

    def write_batch(sums: DataFrame, batch_id: int) -> None:
        sums = sums.persist()
        try:
            score_sums(sums, scorer, threshold).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch_id={batch_id}")
        finally:
            sums.unpersist()

    sums = running_sums(requests, nodes, expire_seconds, lateness, sequence, session_column)
    writer = sums.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    # map states need this store; a query keeps the settings it starts with, so the session's comes back
    before = spark.conf.get(_STATE_PROVIDER, None)
    spark.conf.set(_STATE_PROVIDER, _ROCKSDB)
    try:
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    finally:
        spark.conf.set(_STATE_PROVIDER, before) if before else spark.conf.unset(_STATE_PROVIDER)


def active_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Session ids that hold requests, from the checkpoint of a scoring query."""
    state = spark.read.format("statestore").option("stateVarName", "summary").load(checkpoint)
    held = state.where(F.get_json_object("value.content", "$.n").cast("int") > 0)
    return held.select(F.col("key.session_id").alias("session_id")).distinct().orderBy("session_id")
