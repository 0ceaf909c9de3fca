"""Streams of log records into newest-wins state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(records: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Appends a stream of (k, ts, op, v) to a store, one segment a micro-batch.

    A batch that is delivered again after a failure replaces the segment of its first delivery, so each counts once.
    """

    def append(batch: DataFrame, number: int) -> None:
        store.append(batch, segment=f"stream-{number:012d}")

    return records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
