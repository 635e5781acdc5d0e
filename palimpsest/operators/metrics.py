"""Throughput and latency analytics, id compression and cache simulation."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.95, 0.99, 0.999, 0.9999)
#: Parts that a group's values are cut into before they are sorted.
BINS = 64


def _at_ranks(df: DataFrame, by: Sequence[str], value: str, points: DataFrame, rank) -> DataFrame:
    """(by..., point, value): for each group and row of points(point), the sample at the 0-based rank(point, n).

    Equal values are counted before anything is sorted. A group's distinct values are cut at approximate quantiles into
    at most BINS bins; counts of bins tell in which one a rank lies, and only those bins are sorted, each by itself. So
    a group of any size spreads over tasks.
    """
    # One struct names a group, so that nulls in it meet like other values.
    counted = df.where(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = counted.groupBy("g").agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], 10 * BINS).alias("cuts"))
    binned = counted.join(cuts, "g").select("g", "v", "c", F.size(F.filter("cuts", lambda b: b < F.col("v"))).alias("bin"))
    group = Window.partitionBy("g")
    hi = F.sum("c").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = binned.groupBy("g", "bin").agg(F.sum("c").alias("c"))
    bins = bins.select("g", "bin", (hi - F.col("c")).alias("lo"), hi.alias("hi"), F.sum("c").over(group).alias("n"))
    wanted = bins.join(F.broadcast(points)).withColumn("at", rank(F.col("point"), F.col("n"))).where((F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi")))
    own = binned.join(wanted.select("g", "bin", "lo").distinct(), ["g", "bin"])
    upto = F.sum("c").over(Window.partitionBy("g", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("lo")
    ranked = own.select("g", "bin", "v", (upto - F.col("c")).alias("first"), upto.alias("end"))
    found = ranked.join(wanted.select("g", "bin", "point", "at"), ["g", "bin"]).where((F.col("first") <= F.col("at")) & (F.col("at") < F.col("end")))
    return found.select(*(F.col(f"g.{c}").alias(c) for c in by), "point", F.col("v").alias("value"))


def percentiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float] = PERCENTILES) -> DataFrame:
    """(by..., p, value): the sample at the 0-based rank floor(p * (n - 1)) of each group; nulls don't count."""
    asked = df.sparkSession.createDataFrame([(p,) for p in points], "point double")
    return _at_ranks(df, by, value, asked, lambda p, n: F.floor(p * (n - 1))).withColumnRenamed("point", "p")


def cdf(df: DataFrame, by: Sequence[str], value: str, step: int = 5) -> DataFrame:
    """(by..., pct, value) for pct = step, 2 step, ... 100: the sample at rank min(pct * n div 100, n - 1)."""
    asked = df.sparkSession.range(step, 101, step).select(F.col("id").cast("int").alias("point"))
    return _at_ranks(df, by, value, asked, lambda p, n: F.least(F.floor(p * n / 100), n - 1)).withColumnRenamed("point", "pct")


def throughput(df: DataFrame, by: Sequence[str], seconds: str, value_bytes: int = 512) -> DataFrame:
    """(by..., n, ops_per_sec, mb_per_sec), where an operation moves a 16-byte key and a value."""
    rows = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(seconds).alias("s")).where("s > 0")
    return rows.select(*by, "n", (F.col("n") / F.col("s")).alias("ops_per_sec"), (F.col("n") * (16 + value_bytes) / (1 << 20) / F.col("s")).alias("mb_per_sec"))


def sustained(windows: DataFrame, order: str = "window_id", rate: str = "ops_per_sec") -> DataFrame:
    """First, last, least, greatest and mean rate over numbered windows, and how far the last fell, in percent."""
    first, last = F.min_by(rate, order), F.max_by(rate, order)
    return windows.agg(first.alias("first_rate"), last.alias("last_rate"), F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"), F.avg(rate).alias("mean_rate"), ((1 - last / first) * 100).alias("degradation_pct"))


def hit_rate(df: DataFrame, by: Sequence[str], hit: str = "hit") -> DataFrame:
    """(by..., n, hit_rate in percent)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), (100 * F.count_if(F.col(hit)) / F.count("*")).alias("hit_rate"))


def peaks(results: DataFrame) -> DataFrame:
    """(benchmark, variant, ops_per_sec, mean_ops): the fastest variant of each benchmark, and the mean of all."""
    return results.groupBy("benchmark").agg(F.max_by("variant", F.struct("ops_per_sec", "variant")).alias("variant"), F.max("ops_per_sec").alias("ops_per_sec"), F.avg("ops_per_sec").alias("mean_ops"))


def compress_ids(ids: DataFrame, column: str = "id") -> DataFrame:
    """Distinct ids with the leading run of consecutive ones replaced by its last member.

    The run ends at the smallest id without a successor: an anti join and a minimum, no global sort.
    """
    own = ids.select(F.col(column).alias("id")).where("id is not null").distinct()
    ends = own.join(own.select((F.col("id") - 1).alias("id")), "id", "left_anti").agg(F.min("id").alias("run_end"))
    return own.join(F.broadcast(ends), F.col("id") >= F.col("run_end")).select(F.col("id").alias(column))


class Lru2:
    """A cache of `capacity` items that evicts those used less than k times first, then the least recent."""

    def __init__(self, capacity: int, k: int = 2):
        self.capacity, self.k = capacity, k
        self.young: OrderedDict[tuple, int] = OrderedDict()  # last: most recent
        self.old: OrderedDict[tuple, None] = OrderedDict()

    def access(self, item: tuple) -> bool:
        """Whether the item was there; it is afterwards."""
        if item in self.old:
            self.old.move_to_end(item)
            return True
        if item in self.young:
            uses = self.young.pop(item) + 1
            if uses >= self.k:
                self.old[item] = None
            else:
                self.young[item] = uses
            return True
        if len(self.young) + len(self.old) >= self.capacity:
            (self.young or self.old).popitem(last=False)
        self.young[item] = 1
        return False


def simulate_cache(trace: DataFrame, capacity: int, by: str = "trace_id", k: int = 2) -> DataFrame:
    """(by, step, hit) of an access trace (by, step, sst_id, block_id), each trace with a cache of its own.

    The state depends on order, so each trace is replayed in one task, batch by batch.
    """
    rows = trace.select(F.col(by).alias("trace_id"), "step", "sst_id", "block_id").repartition("trace_id").sortWithinPartitions("trace_id", "step")

    def run(batches):
        now, cache = None, None
        for pdf in batches:
            hits = []
            for t, s, b in zip(pdf["trace_id"], pdf["sst_id"], pdf["block_id"]):
                if cache is None or t != now:
                    now, cache = t, Lru2(capacity, k)
                hits.append(cache.access((s, b)))
            yield pdf[["trace_id", "step"]].assign(hit=hits)

    return rows.mapInPandas(run, "trace_id long, step long, hit boolean").withColumnRenamed("trace_id", by)
