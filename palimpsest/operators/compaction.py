"""Compaction as functions of DataFrames: newest versions, tombstone collection, cutting into files."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.visibility import winners

BUCKETS = 256


def boundaries(files: DataFrame, column: str = "first_key", buckets: int = BUCKETS) -> list[str]:
    """At most `buckets` keys that split the column's values about evenly: where a range partitioning's parts begin."""
    keys = files.select(F.col(column).alias("k")).distinct()
    parts = keys.repartitionByRange(buckets, "k").groupBy(F.spark_partition_id().alias("part")).agg(F.min("k").alias("k"))
    return sorted((r.k for r in parts.select("k").collect()), key=str.encode)


def slot(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at or below the key, found in two steps of about sqrt(len(bounds)) comparisons."""
    step = max(1, math.isqrt(len(bounds)))
    upto = lambda b: b <= key
    rough = F.size(F.filter(F.array(*map(F.lit, bounds[::step])), upto))
    groups = F.array(*[F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)])
    fine = F.size(F.filter(F.get(groups, rough - 1), upto))
    return F.when(rough == 0, 0).otherwise((rough - 1) * step + fine)


def covered(keys: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of keys(key, ...) whose key lies in the range of some file (first_key, last_key).

    A sweep: dealt to the slots between at most BUCKETS boundaries, keys and ranges are merged in key order, and a key is
    covered if a range that began before it reaches as far. What slots before reach is known when the boundaries are. So
    no key meets a range, however many there are. Where slots are few, each is dealt to several tasks, with all its ranges;
    so are keys that nothing up to their slot's end reaches, with none. (To drop those here would put the test below the
    aggregate that keys come from, and callers would have it computed twice.)
    """
    reaches = files.groupBy("first_key").agg(F.max("last_key").alias("last_key"))
    parts = reaches.repartitionByRange(BUCKETS, "first_key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("first_key").alias("k"), F.max("last_key").alias("reach"))
    found = sorted(((r.k, r.reach) for r in parts.collect()), key=lambda r: r[0].encode())
    if not found:
        return keys.where(F.lit(False))
    bounds, deals = [k for k, _ in found], max(1, BUCKETS // len(found))
    upto = list(accumulate((r for _, r in found), lambda a, b: max(a, b, key=str.encode)))
    # Slot 0 lies before all ranges and slot 1 begins with the first one; what begins in a slot is met there.
    reached = lambda ends: F.get(F.array(*[F.lit(r).cast("string") for r in ends]), F.col("_slot"))
    earlier, near = reached((None, None, *upto[:-1])), F.coalesce(F.col("key") <= reached((None, *upto)), F.lit(False))
    begun = reaches.select(F.col("first_key").alias("key"), slot(F.col("first_key"), bounds).alias("_slot"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("_deal"), F.col("last_key").alias("_reach"))
    own = keys.withColumn("_slot", slot(F.col("key"), bounds)).withColumn("_near", near)
    own = own.withColumns({"_slot": F.when(F.col("_near"), F.col("_slot")).otherwise(-1), "_deal": F.pmod(F.xxhash64("key"), F.when(F.col("_near"), deals).otherwise(BUCKETS)).cast("int"), "_reach": F.lit(None).cast("string")}).drop("_near")
    order = Window.partitionBy("_slot", "_deal").orderBy("key", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = own.withColumn("_asked", F.lit(True)).unionByName(begun.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    reach = F.greatest(F.max("_reach").over(order), earlier)
    return merged.withColumn("_reach", reach).where(F.col("_asked") & (F.col("_reach") >= F.col("key"))).select(*keys.columns)


def collect_tombstones(rows: DataFrame, deeper: DataFrame) -> DataFrame:
    """rows without the tombstones that no deeper file may need: those outside all deeper key ranges."""
    dead = rows.where("value = ''")
    return rows.where("value <> ''").unionByName(covered(dead, deeper))


def compact(log: DataFrame, deeper: DataFrame, retain_since: int | None = None) -> DataFrame:
    """What merging the log's files leaves: the newest version of each key, less collectable tombstones.

    deeper: catalogue rows of all levels below the output. By default older versions go, so snapshots before the
    compaction are lost; with retain_since all versions visible to snapshots from that time on stay, and the tombstones
    that go are those that were the newest version then.
    """
    if retain_since is None:
        return collect_tombstones(winners(log), deeper)
    # Snapshots from retain_since on can see the newest version of that time and all later ones.
    base = collect_tombstones(winners(log.where(F.col("tid") <= retain_since)), deeper)
    return base.unionByName(log.where(F.col("tid") > retain_since).select("key", "value", "tid", "seq"))


def in_files(log: DataFrame, n: int, first: int = 0, whole_keys: bool = True) -> DataFrame:
    """The log dealt to n ranges of keys, or of versions, each with an sst_id from `first` on and sorted by key and newest
    version first; one file each when written by sst_id. The order begins with sst_id, so the writer need not sort again."""
    order = [F.col("key"), F.desc("tid"), F.desc("seq")]
    dealt = log.repartitionByRange(n, *(order[:1] if whole_keys else order))
    return dealt.withColumn("sst_id", F.spark_partition_id().cast("long") + first).sortWithinPartitions("sst_id", *order)
