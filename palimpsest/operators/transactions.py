"""Transactions as DataFrames: private write sets, snapshot reads, conflicts, commits and rollbacks.

A write set is (key, value, seq). Levels: a read-uncommitted transaction writes through; the others keep a write
set; read committed sees the newest version at each read; repeatable read and serializable see their own
snapshot, and abort at commit when a key they wrote has a later version in the store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.visibility import visible, winners


class Isolation(Enum):
    READ_UNCOMMITTED = "READ_UNCOMMITTED"
    READ_COMMITTED = "READ_COMMITTED"
    REPEATABLE_READ = "REPEATABLE_READ"
    SERIALIZABLE = "SERIALIZABLE"

    @property
    def checks_conflicts(self) -> bool:
        return self in (Isolation.REPEATABLE_READ, Isolation.SERIALIZABLE)


class Conflict(RuntimeError):
    """A key of the write set was written by someone else since the transaction began."""


def conflicts(store: DataFrame, write_set: DataFrame, tid: int) -> DataFrame:
    """(key, tid) of written keys whose newest stored version is later than the transaction."""
    later = store.where(F.col("tid") > tid).join(write_set.select("key").distinct(), "key", "left_semi")
    return later.groupBy("key").agg(F.max("tid").alias("tid"))


def overlay(store: DataFrame, write_set: DataFrame, tid: int | None) -> DataFrame:
    """(key, value) as the transaction sees it: its own writes first, then the snapshot; deletions hide."""
    own = winners(write_set.select("key", "value", F.lit(0).cast("long").alias("tid"), "seq")).select("key", F.col("value").alias("own"))
    base = winners(visible(store, tid)).select("key", "value")
    return base.join(own, "key", "full").select("key", F.coalesce("own", "value").alias("value")).where("value <> ''")


def committed(write_set: DataFrame, tid: int) -> DataFrame:
    """The log rows that a commit appends: the write set under the transaction's tid."""
    return write_set.select("key", "value", F.lit(tid).cast("long").alias("tid"), "seq")


def rollback(store: DataFrame, write_set: DataFrame, tid: int, new_tid: int) -> DataFrame:
    """Log rows that undo written-through keys: each takes its value before tid back, at a new tid.

    A key without a value before becomes a tombstone. The old tid would not outrank the undone write.
    """
    keys = write_set.select("key").distinct()
    before = winners(store.where(F.col("tid") < tid).join(keys, "key", "left_semi")).select("key", "value")
    return keys.join(before, "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"), F.lit(new_tid).cast("long").alias("tid"), F.lit(0).cast("long").alias("seq"))


#: The operations of a transaction record, by their number in its binary form.
OPERATIONS = ("CREATE", "COMMIT", "ROLLBACK", "PUT", "DELETE")
RECORD = "tid long, op string, key string, value string"


def journal(store: DataFrame, write_set: DataFrame, tid: int, ended: str) -> DataFrame:
    """The records (tid, op, key, value) of one transaction: its begin, its writes, and how it ended."""
    own = write_set.select(F.lit(tid).cast("long").alias("tid"), F.when(F.col("value") == "", "DELETE").otherwise("PUT").alias("op"), "key", F.nullif("value", F.lit("")).alias("value"))
    bare = F.lit(None).cast("string")
    marks = store.sparkSession.range(2).select(F.lit(tid).cast("long").alias("tid"), F.when(F.col("id") == 0, "CREATE").otherwise(ended).alias("op"), bare.alias("key"), bare.alias("value"))
    return marks.unionByName(own)


def record_identity() -> list[Column]:
    """What two records (tid, op, key, value) must agree on to be equal: keys count for PUT and DELETE, values for PUT."""
    op = F.col("op")
    return [F.col("tid"), op, F.when(op.isin("PUT", "DELETE"), F.col("key")).alias("key"), F.when(op == "PUT", F.col("value")).alias("value")]


def distinct_records(records: DataFrame) -> DataFrame:
    """(tid, op, key, value, n): equal records as one, with what plays no part in equality set to null."""
    return records.select(*record_identity()).groupBy("tid", "op", "key", "value").agg(F.count("*").alias("n"))


class TidBook:
    """The times that transactions took, ended with, and have in runs: `next_tid`, `ready` and `flushed`.

    A flush of a time also settles aborted transactions before it; a leading run of settled times is kept as its last.
    """

    def __init__(self, next_tid: int = 0, flushed: Iterable[int] = (0,)):
        self.next_tid, self.flushed, self.ready = next_tid, set(flushed), {}

    def take(self) -> int:
        self.next_tid += 1
        return self.next_tid - 1

    def end(self, tid: int, aborted: bool = False) -> None:
        self.ready[tid] = aborted

    def flush(self, tid: int) -> None:
        settled = [t for t, aborted in self.ready.items() if t == tid or (aborted and t < tid)]
        if tid in self.ready:
            self.flushed.update(settled)
        else:
            self.flushed.update(t for t in settled if t != tid)
        for t in settled:
            del self.ready[t]
        own = sorted(self.flushed)
        run = next((i for i in range(len(own)) if i + 1 == len(own) or own[i + 1] != own[i] + 1), 0)
        self.flushed = set(own[run:])

    @property
    def checkpoint(self) -> int:
        """Every time up to this one is settled."""
        return min(self.flushed)

    def encode(self) -> bytes:
        return struct.pack(f"<{2 + len(self.flushed)}Q", self.next_tid, len(self.flushed), *sorted(self.flushed))

    @classmethod
    def decode(cls, data: bytes) -> TidBook:
        next_tid, n = struct.unpack_from("<2Q", data)
        if len(data) < 16 + 8 * n:
            raise ValueError("a book of transaction times is cut short")
        return cls(next_tid, struct.unpack_from(f"<{n}Q", data, 16))


@dataclass
class Transaction:
    """A transaction on a store with `log`, `allocate()` and `append(rows)`; see palimpsest.sources.store."""

    store: object
    level: Isolation = Isolation.REPEATABLE_READ
    tid: int = 0
    writes: list[tuple[str, str, int]] = field(default_factory=list)
    reads: dict[str, str | None] = field(default_factory=dict)
    open: bool = True

    def __post_init__(self):
        self.tid = self.store.allocate()

    def put(self, key: str, value: str) -> None:
        self._active()
        self.writes.append((key, value, len(self.writes)))
        if self.level is Isolation.READ_UNCOMMITTED:
            self.store.write([(key, value)], self.tid)

    def remove(self, key: str) -> None:
        self.put(key, "")

    def get(self, key: str) -> str | None:
        """Own writes first (an own deletion reads as missing), then the store at this level's snapshot."""
        self._active()
        for k, value, _ in reversed(self.writes):
            if k == key:
                return value or None
        if self.level.checks_conflicts:
            if key not in self.reads:
                self.reads[key] = self.store.get(key, as_of=self.tid)
            return self.reads[key]
        return self.store.get(key)

    def commit(self) -> None:
        self._active()
        if self.level.checks_conflicts and self.writes:
            hit = conflicts(self.store.log(), self._write_set(), self.tid).limit(1).collect()
            if hit:
                self.abort()
                raise Conflict(f"{hit[0].key} was written at {hit[0].tid}, after {self.tid}")
        self.open = False
        if self.level is not Isolation.READ_UNCOMMITTED:
            self.store.write([(k, v) for k, v, _ in self.writes], self.tid)

    def abort(self) -> None:
        self._active()
        self.open = False
        if self.level is Isolation.READ_UNCOMMITTED and self.writes:
            undo = rollback(self.store.log(), self._write_set(), self.tid, new := self.store.allocate())
            self.store.write([(r.key, r.value) for r in undo.collect()], new)  # as many rows as the write set
        self.writes.clear()

    def _write_set(self) -> DataFrame:
        return self.store.spark.createDataFrame(self.writes, "key string, value string, seq long")

    def _active(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")
