"""Streaming sources of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.logs import parse_combined_log


def stream_log_folder(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Requests from combined-format files as they land in a folder.

    Unreadable lines come with ``corrupt_line`` set, so one bad line does not stop the stream.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_event_time(parse_combined_log(reader.text(folder), on_error="keep"))


def with_event_time(requests: DataFrame) -> DataFrame:
    """Add the request time as a timestamp, for watermarks."""
    micros = F.round(F.col("timestamp") * F.lit(1_000_000.0)).cast("bigint")
    return requests.withColumn("event_time", F.timestamp_micros(micros))
