"""Sessions over a stream by inactivity windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener


def closed_sessions(requests: DataFrame, timeout_seconds: int = 1800, lateness: str = "10 minutes") -> DataFrame:
    """Sessions per client that no request within the lateness can extend any more.

    ``requests`` carries ``event_time`` and ``client_key``. A session ends when the watermark passes
    its last request by the timeout; later requests for it are dropped and counted by the query.
    """
    window = F.session_window("event_time", f"{timeout_seconds} seconds")
    return (
        requests.withWatermark("event_time", lateness)
        .groupBy("client_key", window)
        .agg(
            F.count("*").alias("num_events"),
            F.min("event_time").alias("first_time"),
            F.max("event_time").alias("last_time"),
        )
        .select("client_key", "first_time", "last_time", "num_events")
    )


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop because they came after the watermark, batch by batch.

    Register with ``spark.streams.addListener`` before the query starts; ``dropped`` has the total
    of each query id, complete however long the query runs.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        progress = event.progress
        late = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
