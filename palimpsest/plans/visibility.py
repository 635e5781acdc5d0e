"""What a reader sees of a mutation log: visible rows, winners, live rows.

The three steps have one valid order: snapshot filter, winner, tombstone filter. Dropping tombstones before the
winner is chosen would bring deleted keys back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Rows with tid <= as_of; None: all. Zero is a time like any other here."""
    return log if as_of is None else log.where(F.col("tid") <= as_of)


def winners(log: DataFrame) -> DataFrame:
    """One row per key: the greatest (tid, seq, value). Tombstones included.

    A maximum over a struct combines on the map side, so a key with any number of versions sends one
    row per task through the shuffle.
    """
    best = F.max(F.struct("tid", "seq", "value")).alias("best")
    return log.groupBy("key").agg(best).select("key", "best.value", "best.tid", "best.seq")


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """(key, value, tid) of the keys that exist at as_of."""
    return winners(visible(log, as_of)).where("value <> ''").select("key", "value", "tid")
