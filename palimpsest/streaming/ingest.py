"""Streams into and out of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.store import VersionedStore


def ingest(stream: DataFrame, store: VersionedStore, source: str, checkpoint: str, every: str | None = None):
    """Write a stream of (key, value[, seq]) to the store, one tid for each micro-batch; returns the query.

    A micro-batch that runs again after a failure is recognised by its number in the manifest and left out. With
    `every` (for example '200 milliseconds') the query goes on; without, it takes what is there and ends.
    Level 0 is compacted as it falls due.
    """

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.write_frame(batch, source, number)
            store.maintain()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def latest(stream: DataFrame) -> DataFrame:
    """The running winner of each key of a streamed log (key, value, tid, seq); write it in complete or update mode."""
    best = F.max(F.struct("tid", "seq", "value")).alias("best")
    return stream.groupBy("key").agg(best).select("key", "best.value", "best.tid", "best.seq")
