"""Reads over a mutation log: point, multi, as-of, prefix, range and full reads. All lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.keys import has_prefix
from palimpsest.plans.visibility import live, visible, winners

#: Parts of the time that an as-of join covers; the versions of one key spread over as many tasks.
SLICES = 64


def get(log: DataFrame, key: str, as_of: int | None = None) -> DataFrame:
    """(key, value, tid): no row if the key is missing or deleted. The key filter reaches the scan.

    For point reads a snapshot of 0 means the newest version, as None does.
    """
    return live(log.where(F.col("key") == key), as_of or None)


def requests(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(pos, key) of a list of keys."""
    listed = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    return log.sparkSession.range(1).select(F.posexplode(listed).alias("pos", "key"))


def get_many(log: DataFrame, wanted: DataFrame, as_of: int | None = None) -> DataFrame:
    """(pos, key, value, tid) for each row of wanted(pos, key): null value where missing or deleted.

    tid is the winner's, a tombstone's own included, and 0 where there is none. Repeated requests give repeated
    rows. The log is reduced to the wanted keys before versions are compared.
    """
    asked = wanted.select("key").distinct()
    found = winners(visible(log, as_of or None).join(asked, "key", "left_semi"))
    return wanted.join(found, "key", "left").select("pos", "key", F.nullif("value", F.lit("")).alias("value"), F.coalesce("tid", F.lit(0)).alias("tid"))


def get_in_order(log: DataFrame, wanted: DataFrame, as_of: int | None = None) -> DataFrame:
    """(pos, key, value) sorted by the requests' order."""
    return get_many(log, wanted, as_of).select("pos", "key", "value").orderBy("pos")


def as_of_join(log: DataFrame, wanted: DataFrame, slices: int = SLICES) -> DataFrame:
    """wanted(pos, key, as_of) with (value, tid) of the version visible at each row's own time.

    Versions of keys that nobody asks for, and those after a key's latest request, go first. Time is cut into `slices`
    of equal length; within a key and slice, versions and requests are merged in time order, and each request takes the
    last version before it. What a slice inherits is the newest version of the slices before, of which a key has at most
    one for each slice. So a key may have any number of versions, and no request meets a version that it doesn't take.
    Null value: missing or deleted; tid 0: missing. An as_of or key of null finds nothing.
    """
    asks = wanted.select("pos", "key", "as_of")
    latest = asks.groupBy("key").agg(F.max("as_of").alias("latest"))
    span = asks.agg(F.min("as_of").alias("t0"), F.max("as_of").alias("t1"))
    width = F.greatest(F.ceil((F.col("t1") - F.col("t0") + 1) / slices), F.lit(1))
    at_slice = lambda t: F.greatest(F.floor((t - F.col("t0")) / width), F.lit(0)).cast("int")
    span = F.broadcast(span)  # one row
    rows = log.join(latest, "key").where(F.col("tid") <= F.col("latest")).join(span).select("key", at_slice(F.col("tid")).alias("slice"), "tid", "seq", "value")
    asks = asks.join(span).select("pos", "key", "as_of", at_slice(F.col("as_of")).alias("slice"))
    # The newest version of each slice, then of all slices before each one that has requests.
    order = Window.partitionBy("key").orderBy("slice", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newest = rows.groupBy("key", "slice").agg(F.max(F.struct("tid", "seq", "value")).alias("best")).select("key", (F.col("slice") + 1).alias("slice"), F.lit(False).alias("asked"), "best")
    places = asks.select("key", "slice").distinct().select("key", "slice", F.lit(True).alias("asked"), F.lit(None).cast("struct<tid:bigint,seq:bigint,value:string>").alias("best"))
    carried = newest.unionByName(places).withColumn("best", F.last("best", ignorenulls=True).over(order)).where("asked and best is not null").select("key", "slice", F.lit(0).alias("kind"), "best.tid", "best.seq", "best.value", F.col("best.tid").alias("at"))
    versions = rows.select("key", "slice", F.lit(1).alias("kind"), "tid", "seq", "value", F.col("tid").alias("at"))
    merged = carried.unionByName(versions).select("key", "slice", "kind", "at", "seq", F.struct("value", "tid").alias("version"), F.lit(None).cast("long").alias("pos"))
    requests = asks.select("key", "slice", F.lit(2).alias("kind"), F.col("as_of").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("struct<value:string,tid:bigint>").alias("version"), F.col("pos").cast("long").alias("pos"))
    order = Window.partitionBy("key", "slice").orderBy("at", "kind", "seq", F.col("version.value")).rowsBetween(Window.unboundedPreceding, 0)
    met = merged.unionByName(requests).withColumn("seen", F.last("version", ignorenulls=True).over(order)).where("kind = 2")
    return met.select("pos", "key", F.col("at").alias("as_of"), F.nullif("seen.value", F.lit("")).alias("value"), F.coalesce("seen.tid", F.lit(0)).alias("tid"))


def prefix_scan(log: DataFrame, prefix: str, as_of: int | None = None) -> DataFrame:
    """Live (key, value, tid) under a prefix, ascending by key. An empty prefix scans everything."""
    return live(log.where(has_prefix(F.col("key"), prefix)), as_of).orderBy("key")


def prefix_versions(log: DataFrame, prefix: str, as_of: int | None = None) -> DataFrame:
    """Every visible version under a prefix, tombstones included; a snapshot of 0 is literal."""
    return visible(log.where(has_prefix(F.col("key"), prefix)), as_of).select("key", "value", "tid", "seq").orderBy("key", F.desc("tid"), F.desc("seq"))


def range_scan(log: DataFrame, start: str | None, end: str | None, as_of: int | None = None) -> DataFrame:
    """Live rows with start <= key < end, ascending; None leaves a side open."""
    if start is not None:
        log = log.where(F.col("key") >= start)
    if end is not None:
        log = log.where(F.col("key") < end)
    return live(log, as_of).orderBy("key")


def scan(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """All live rows, ascending by key (unsigned byte order, as Spark's binary collation has it)."""
    return live(log, as_of).orderBy("key")


def merge(*logs: DataFrame) -> DataFrame:
    """Logs of several shards, blocks or files as one; nothing is dropped."""
    out = logs[0].select("key", "value", "tid", "seq")
    for log in logs[1:]:
        out = out.unionByName(log.select("key", "value", "tid", "seq"))
    return out
