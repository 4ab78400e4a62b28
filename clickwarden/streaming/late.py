"""Late requests as a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def start_late_split(
    requests: DataFrame, on_time: str, late: str, checkpoint: str, lateness_seconds: float, time_column: str = "timestamp", **trigger
) -> StreamingQuery:
    """Write each request to ``on_time``, or to ``late`` when it comes after the watermark of its micro-batch.

    The watermark is the greatest time of all earlier micro-batches less ``lateness_seconds``; a request before it is
    late and keeps the watermark it missed in ``watermark``. A request without time is never late. Both tables are
    partitioned by ``batch_id``, so a repeated micro-batch replaces its own rows. The high marks lie in ``checkpoint``.
    """
    spark = requests.sparkSession
    marks = f"{checkpoint.rstrip('/')}/marks"

    def write_batch(rows: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id:
            before = spark.read.schema("high double").parquet(f"{marks}/batch_id={batch_id - 1}").head()["high"]
        time = F.col(time_column).cast("double")
        mark = F.lit(None if before is None else before - lateness_seconds).cast("double")
        missed = F.coalesce(time < mark, F.lit(False))
        rows = rows.persist()
        try:
            rows.where(~missed).write.mode("overwrite").parquet(f"{on_time.rstrip('/')}/batch_id={batch_id}")
            rows.where(missed).withColumn("watermark", mark).write.mode("overwrite").parquet(f"{late.rstrip('/')}/batch_id={batch_id}")
            high = rows.agg(F.greatest(F.max(time), F.lit(before).cast("double")).alias("high"))
            high.write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        finally:
            rows.unpersist()

    writer = requests.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{checkpoint.rstrip('/')}/query")
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
