"""Recovery from a write-ahead log: replay of the suffix, and which segments are done with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(wal: DataFrame, checkpoint: int) -> DataFrame:
    """wal(key, value, tid, segment, pos) rows later than the checkpoint, as a log; seq is the arrival order.

    Positions stay well below 2**40 a segment (a segment is cut at some MB).
    """
    order = F.col("segment") * F.lit(1 << 40) + F.col("pos")
    return wal.where(F.col("tid") > checkpoint).select("key", "value", "tid", order.alias("seq"))


def next_tid(log: DataFrame, checkpoint: int) -> DataFrame:
    """The first free tid after recovery."""
    return log.agg((F.greatest(F.coalesce(F.max("tid"), F.lit(0)), F.lit(checkpoint)) + 1).alias("next_tid"))


def cleanable_segments(wal: DataFrame, checkpoint: int) -> DataFrame:
    """(segment, n_entries, max_tid) of segments wholly at or below the checkpoint.

    The newest segment stays, as it may still be written to.
    """
    newest = wal.agg(F.max("segment").alias("newest"))
    rows = wal.groupBy("segment").agg(F.count("*").alias("n_entries"), F.max("tid").alias("max_tid"))
    return rows.where(F.col("max_tid") <= checkpoint).join(F.broadcast(newest), F.col("segment") < F.col("newest")).drop("newest")
