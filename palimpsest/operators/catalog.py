"""The file catalogue: an event log of added and removed files, statistics, and which files a read may skip.

Catalogue tables have one row per file or block; a window over a whole catalogue stays small next to the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.checksums import exact_shard
from palimpsest.functions.keys import entry_bytes, prefix_end
from palimpsest.operators.compaction import boundaries, slot

META = ["level", "min_tid", "max_tid", "first_key", "last_key"]
BLOCK_BYTES = 4096
L0_FILES = 4
BASE_MB = 240


def live_files(manifest_log: DataFrame) -> DataFrame:
    """The files whose last action is ADD: (sst_id, level, min_tid, max_tid, first_key, last_key)."""
    last = F.max_by(F.struct("action", *META), F.col("version")).alias("last")
    return manifest_log.groupBy("sst_id").agg(last).where("last.action = 'ADD'").select("sst_id", *[f"last.{c}" for c in META])


def checkpoint(files: DataFrame) -> DataFrame:
    """The greatest tid in any live file, 0 without files."""
    return files.agg(F.coalesce(F.max("max_tid"), F.lit(0)).cast("long").alias("checkpoint"))


def file_stats(log: DataFrame) -> DataFrame:
    """Catalogue rows of a log with (level, sst_id) placement; min_tid is the true minimum."""
    return log.groupBy("sst_id", "level").agg(
        F.min("tid").alias("min_tid"), F.max("tid").alias("max_tid"), F.min("key").alias("first_key"), F.max("key").alias("last_key"),
        F.count("*").alias("n_rows"), F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("n_bytes"),
    )


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("n_rows").cast("long").alias("n_rows"), F.sum("n_bytes").cast("long").alias("n_bytes"))


def overlaps(first: Column, last: Column, low, high) -> Column:
    """Whether [first, last] and [low, high] share a key."""
    return (first <= high) & (last >= low)


def overlapping(files: DataFrame, level: int, low: str, high: str) -> DataFrame:
    """Files of a level that may hold keys in [low, high]."""
    return files.where((F.col("level") == level) & overlaps(F.col("first_key"), F.col("last_key"), F.lit(low), F.lit(high)))


def overlapping_pairs(files: DataFrame, upper: int, lower: int) -> DataFrame:
    """(upper_id, lower_id) of files of two levels whose key ranges overlap.

    Both levels' ranges are filed under the slots that they reach into and meet there. Two ranges that overlap first do
    so in the slot where the later one begins; only there the pair counts.
    """
    bounds = boundaries(files)
    if not bounds:
        return files.select(F.col("sst_id").alias("upper_id"), F.col("sst_id").alias("lower_id")).where(F.lit(False))

    def filed(level: int, names: tuple[str, str, str, str]) -> DataFrame:
        begin, end = slot(F.col("first_key"), bounds), slot(F.col("last_key"), bounds)
        own = files.where(F.col("level") == level).select("sst_id", "first_key", "last_key", begin.alias("begin"), end.alias("end"))
        return own.select(*(F.col(c).alias(n) for c, n in zip(("sst_id", "first_key", "last_key", "begin"), names)), F.explode(F.sequence("begin", "end")).alias("slot"))

    a, z = filed(upper, ("upper_id", "a", "b", "x")), filed(lower, ("lower_id", "c", "d", "y"))
    met = a.join(z, "slot").where(overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")) & (F.col("slot") == F.greatest("x", "y")))
    return met.select("upper_id", "lower_id")


def may_hold(ranges: DataFrame, key: str) -> DataFrame:
    """Files or blocks whose key range includes a key."""
    return ranges.where((F.col("first_key") <= key) & (F.col("last_key") >= key))


def may_hold_prefix(ranges: DataFrame, prefix: str) -> DataFrame:
    """Files or blocks that may hold keys under a prefix: those meeting [prefix, prefix_end)."""
    out = ranges.where(F.col("last_key") >= prefix)
    end = prefix_end(prefix)
    return out if end is None else out.where(F.col("first_key").cast("binary") < F.lit(end))


def key_range(files: DataFrame) -> DataFrame:
    """The key range that a set of files spans."""
    return files.agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


def next_file(files: DataFrame, level: int, pointer: str) -> DataFrame:
    """Round robin: the first file of a level that begins after the pointer, else the first of all."""
    own = files.where(F.col("level") == level)
    after = (F.col("first_key") > pointer).alias("after")
    return own.withColumn("after", after).orderBy(F.desc("after"), "first_key", "sst_id").limit(1).drop("after")


def due(files: DataFrame, l0_files: int = L0_FILES, base_mb: int = BASE_MB) -> DataFrame:
    """(level, n_files, mb, due): level 0 is due at l0_files files, level n at base_mb * 10**(n - 1) / 2 MB."""
    mb = F.floor(F.sum("n_bytes") / (1 << 20)).cast("long")
    rows = files.groupBy("level").agg(F.count("*").alias("n_files"), mb.alias("mb"))
    budget = F.lit(base_mb / 2.0) * F.pow(F.lit(10.0), F.col("level") - 1)
    return rows.withColumn("due", F.when(F.col("level") == 0, F.col("n_files") >= l0_files).otherwise(F.col("mb") >= budget))


def blocks(log: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The log with block_id: rows of a file in key order, newest first, cut every block_bytes."""
    order = Window.partitionBy("sst_id").orderBy("key", F.desc("tid"), F.desc("seq"), F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    size = entry_bytes(F.col("key"), F.col("value"))
    before = F.coalesce(F.sum(size).over(order), F.lit(0))
    return log.withColumn("block_id", F.floor(before / block_bytes).cast("int"))


def block_index(log: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(sst_id, block_id, first_key, last_key, n_rows) of every block."""
    return blocks(log, block_bytes).groupBy("sst_id", "block_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_rows"))


def size_stats(log: DataFrame) -> DataFrame:
    """(n_rows, n_keys, n_tombstones, n_bytes) of a log."""
    return log.agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("n_keys"), F.count_if(F.col("value") == "").alias("n_tombstones"), F.coalesce(F.sum(entry_bytes(F.col("key"), F.col("value"))), F.lit(0)).alias("n_bytes"))


def shard_counts(log: DataFrame) -> DataFrame:
    """(shard, n_rows, n_bytes) of each in-memory shard that the log's keys fall into."""
    return log.groupBy(exact_shard(F.col("key")).alias("shard")).agg(F.count("*").alias("n_rows"), F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("n_bytes"))
