"""Bloom filters of files as tables: one row for each word of 64 bits that has a bit set.

Adding keys and asking for them are joins and aggregates, so filters of any number of files are built and read at once.
A filter has `bits` bits; a key sets `hashes` of them, at (h1 + i * h2) mod bits for two hashes of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.checksums import bloom_size

#: The keys that a filter is made for, and how often it may be wrong.
EXPECTED, RATE = 65_536, 0.01


def placed(keys: DataFrame, by: list[str], bits: int, hashes: int) -> DataFrame:
    """(*by, place): a row for each bit that a key sets. The two hashes are 52-bit parts of its MD5, so sums stay in 64 bits.

    Digest and hashes are columns of their own, made once a key: inside the exploded array each place would make them anew.
    """
    part = lambda i: F.conv(F.substring("_digest", i, 13), 16, 10).cast("long")
    own = keys.select(*by, F.md5(F.col("key").cast("binary")).alias("_digest"))
    own = own.select(*by, part(1).alias("_h1"), part(14).bitwiseOR(F.lit(1).cast("long")).alias("_h2"))
    return own.select(*by, F.explode(F.array(*[(F.col("_h1") + F.lit(i).cast("long") * F.col("_h2")) % bits for i in range(hashes)])).alias("place"))


def words(spread: DataFrame, by: str, name: str) -> DataFrame:
    """(by, word, name): the places of each `by` as words of 64 bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    return spread.groupBy(by, F.expr("place div 64").alias("word")).agg(F.bit_or(bit).alias(name))


def build(keys: DataFrame, by: str = "sst_id", expected: int = EXPECTED, rate: float = RATE) -> DataFrame:
    """(by, word, mask): the filters of keys(by, key). Bits combine on the map side; a key's copies cost nothing more."""
    return words(placed(keys, [by], *bloom_size(expected, rate)), by, "mask")


def may_contain(filters: DataFrame, asked: DataFrame, by: str = "sst_id", expected: int = EXPECTED, rate: float = RATE) -> DataFrame:
    """(by, key) of the filters that may hold an asked key: all of its bits are set. A filter without it may be named, at
    about the rate; one with it always is.

    Words that nobody asks for go first. There are at most as many asked as a filter has, so they are broadcast, and Spark
    drops the others before it combines a filter's bits.
    """
    probes = words(placed(asked.select("key").distinct(), ["key"], *bloom_size(expected, rate)), "key", "need")
    needed = probes.groupBy("key").agg(F.count("*").alias("words"))
    wanted = filters.join(F.broadcast(probes.select("word").distinct()), "word", "left_semi")
    hit = probes.join(wanted, "word").where(F.col("mask").bitwiseAND(F.col("need")) == F.col("need"))
    return hit.groupBy(by, "key").agg(F.count("*").alias("n")).join(needed, "key").where("n = words").select(by, "key")


def filled(filters: DataFrame, by: str = "sst_id", expected: int = EXPECTED, rate: float = RATE) -> DataFrame:
    """(by, bits binary): each filter's bits as bytes, for `sources.binary.encode_bloom`; a filter's size is fixed."""
    import numpy as np

    n, _ = bloom_size(expected, rate)

    def run(pdf):
        words = np.zeros(-(-n // 64), np.int64)
        words[pdf["word"].to_numpy()] = pdf["mask"].to_numpy()
        return pdf[[by]].iloc[:1].assign(bits=[words.tobytes()[: -(-n // 8)]])

    return filters.groupBy(by).applyInPandas(run, f"{by} long, bits binary")
