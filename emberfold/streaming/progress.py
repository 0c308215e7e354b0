"""What the batches of streams have done, as a table."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

SCHEMA = "query string, batch long, rows_in long, watermark string, state_rows long, dropped long"


class Progress(StreamingQueryListener):
    """Keeps a slim row for each batch of the queries that run while it listens; ``with`` adds it to a session and takes it away.

    ``dropped`` counts what the watermark turned away, after partial aggregation: late rows of one window and key that
    arrive together count once.
    """

    def __init__(self, spark: SparkSession) -> None:
        super().__init__()
        self.spark = spark
        self.rows: list[tuple] = []
        self.open = 0
        self.lock = threading.Lock()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        with self.lock:
            self.open += 1

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        state = p.stateOperators
        row = (str(p.id), p.batchId, p.numInputRows, (p.eventTime or {}).get("watermark"), sum(s.numRowsTotal for s in state), sum(s.numRowsDroppedByWatermark for s in state))
        with self.lock:
            self.rows.append(row)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self.lock:
            self.open -= 1

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error: object) -> None:
        # events come on a thread of their own, after the query has ended
        stop = time.time() + 30
        while self.open > 0 and time.time() < stop:
            time.sleep(0.05)
        self.spark.streams.removeListener(self)

    def table(self) -> DataFrame:
        """(query, batch, rows_in, watermark, state_rows, dropped): a row for each batch."""
        return self.spark.createDataFrame(sorted(self.rows), SCHEMA)
