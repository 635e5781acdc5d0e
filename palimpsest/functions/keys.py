"""Key and value expressions: byte-order prefixes, size accounting, shards, generated keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that an in-memory entry takes besides its key and value.
ENTRY_OVERHEAD = 56
SHARDS = 8
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def prefix_end(prefix: str | bytes) -> bytes | None:
    """The least byte string above every string with this prefix; None if there is none (all 0xFF)."""
    raw = prefix.encode() if isinstance(prefix, str) else bytes(prefix)
    kept = raw.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def has_prefix(key: Column, prefix: str) -> Column:
    """Pushed into the Parquet scan as StartsWith; the empty prefix holds for every key."""
    return key.startswith(prefix) if prefix else F.lit(True)


def entry_bytes(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(value) + ENTRY_OVERHEAD).cast("long")


def shard(key: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def make_key(prefix: str, index: Column) -> Column:
    """prefix and eight digits."""
    return F.concat(F.lit(prefix), F.lpad(index.cast("string"), 8, "0"))


def make_value(size: int, seed: Column) -> Column:
    """`size` letters of the alphabet, over and over, from the letter that the seed names."""
    return F.substring(F.lit(ALPHABET * (size // 26 + 2)), F.pmod(seed, F.lit(26)).cast("int") + 1, F.lit(size))


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """A whole number from low to high, both included, for each row; repeatable with a seed over the same partitions."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("int")
