"""A persistent versioned key-value store over Parquet.

Layout under the root: `data/<attempt>/level=<l>/sst_id=<n>/` (one run each, sorted by key and newest version first),
`manifest/version=<n>/` (the catalogue as an event log of added and removed runs), `manifest/snapshot=<n>/` (the live runs
as of version n, so that opening reads a bounded number of events) and `wal/wal.<n>` (writes not yet in runs).

Every attempt to write runs has a folder of its own, which the manifest names. A commit writes data first and then
one manifest version, which gets its name by a rename once it is whole; so what a failed attempt left is never
read, and a version that exists is never replaced. Every version carries the last log segment that is in runs; recovery
replays the later ones. Opening begins a segment above both, and never appends to one that was there.

Single writes are logged as they are made, gather on the driver, as they would in a memtable, and go to a run at
`flush`; `write_frame` takes a whole DataFrame straight to a run and is the way in for data of any size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.keys import ENTRY_OVERHEAD, entry_bytes
from palimpsest.operators import catalog, compaction, reads, recovery
from palimpsest.operators.transactions import Isolation, Transaction
from palimpsest.plans.log import LOG, checked
from palimpsest.plans.visibility import live
from palimpsest.sources import binary
from palimpsest.sources.files import Appender, Files

META = "sst_id, level, min_tid, max_tid, first_key, last_key, n_rows, n_bytes, path".split(", ")
MANIFEST = "version long, action string, sst_id long, level int, min_tid long, max_tid long, first_key string, last_key string, n_rows long, n_bytes long, path string, checkpoint long, source string, batch long, segment long, next_sst long"
RUN = "key string, value string, tid long, seq long, size long"
SNAPSHOT_EVERY = 64
SEGMENT_BYTES = 64 << 20


class VersionedStore:
    """put, get, scan, flush, compact, transactions and recovery on one root folder. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, file_bytes: int = 128 << 20, buffer_rows: int = 100_000, bloom: bool = True, segment_bytes: int = SEGMENT_BYTES, snapshot_every: int = SNAPSHOT_EVERY):
        self.spark, self.root, self.file_bytes, self.buffer_rows, self.bloom = spark, root.rstrip("/"), file_bytes, buffer_rows, bloom
        self.segment_bytes, self.snapshot_every = segment_bytes, snapshot_every
        self.files = Files(spark, self.root)
        self.pointers: dict[int, str] = {}
        self._open()

    # ---- opening, recovery, state

    def _open(self) -> None:
        rows = self._manifest_rows()
        self.version = max((r["version"] for r in rows), default=0)
        self.live: dict[int, dict] = {}
        self.next_sst = max((r["next_sst"] for r in rows), default=0)
        self.checkpoint = max((r["checkpoint"] for r in rows), default=0)
        self.batches: dict[str, int] = {}
        for r in sorted(rows, key=lambda r: (r["version"], r["action"] == "REMOVE")):
            if r["source"]:
                self.batches[r["source"]] = max(r["batch"], self.batches.get(r["source"], -1))
            if r["action"] == "ADD":
                self.live[r["sst_id"]] = {k: r[k] for k in META}
            elif r["action"] == "REMOVE":
                self.live.pop(r["sst_id"], None)
        self.flushed = max((r["segment"] for r in rows), default=-1)
        self.buffer: list[tuple[str, str, int, int]] = []
        self.log_file: Appender | None = None
        segments = self._segments()
        self.segment = 1 + max(self.flushed, *segments, -1)
        # Whole segments are flushed at a time, so what is left to replay is told by segment. A time would not
        # do: a transaction may commit at a tid older than others that were flushed before it.
        fresh = [f"{self.root}/wal/wal.{n}" for n in segments if n > self.flushed]
        if fresh:
            replayed = recovery.replay(binary.read_wal(self.spark, fresh), -1).orderBy("seq").collect()  # at most a buffer
            self.buffer = [(r.key, r.value, r.tid, i) for i, r in enumerate(replayed)]
        if not rows:
            self._backfill()
        self.tid = max([self.checkpoint, *(m["max_tid"] for m in self.live.values()), *(r[2] for r in self.buffer)]) + 1

    def _manifest_rows(self) -> list[dict]:
        """The events of the newest snapshot and of what came after it."""
        names = [n.partition("=") for n in self.files.names(f"{self.root}/manifest") if n.startswith(("version=", "snapshot="))]
        base = max((int(n) for kind, _, n in names if kind == "snapshot"), default=0)
        wanted = [f"{self.root}/manifest/{kind}={n}" for kind, _, n in names if (kind == "version" and int(n) > base) or (kind == "snapshot" and int(n) == base)]
        return [r.asDict() for r in self.spark.read.schema(MANIFEST).parquet(*wanted).collect()] if wanted else []

    def _segments(self) -> list[int]:
        return [int(n[4:]) for n in self.files.names(f"{self.root}/wal") if n.startswith("wal.")]

    def _backfill(self) -> None:
        """Without a manifest, take up the runs of every finished attempt, and write a manifest of them.

        Attempts that were finished but never committed, or replaced by a compaction, can't be told apart then.
        """
        added = []
        for attempt in self.files.names(f"{self.root}/data"):
            for level in self.files.names(f"{self.root}/data/{attempt}"):
                own = f"{attempt}/{level}"
                if level.startswith("level=") and self.files.exists(f"{self.root}/data/{own}/_SUCCESS"):
                    runs = [f"{own}/{run}" for run in self.files.names(f"{self.root}/data/{own}") if run.startswith("sst_id=")]
                    # By attempt, so that the folder's number tells a row's run. Its path would have to be cut and joined row by row.
                    for r in self._stats(runs, f"{self.root}/data/{own}") if runs else []:
                        added.append({**r, "sst_id": len(added), "level": int(level[6:]), "path": f"{own}/sst_id={r['sst_id']}"})
        if added:
            self.next_sst = len(added)
            self._record(added, (), max(r["max_tid"] for r in added), None, None)

    def manifest(self) -> DataFrame:
        """The live runs as a catalogue DataFrame."""
        return self.spark.createDataFrame([[m[k] for k in META] for m in self.live.values()], "sst_id long, level int, min_tid long, max_tid long, first_key string, last_key string, n_rows long, n_bytes long, path string")

    def allocate(self) -> int:
        """The next logical time; every call of the façade takes one."""
        self.tid += 1
        return self.tid - 1

    # ---- the log

    def _pending(self) -> DataFrame:
        return self.spark.createDataFrame(self.buffer, LOG)

    def _reader(self, parts: int | None = None) -> DataFrameReader:
        """A reader whose frames give a task one run. With parts, a shuffle of such a frame has that many partitions.

        Spark fills tasks by files' size on disk: sorted and compressed, a run may take a tenth of its entries' bytes, and less
        where keys have many versions, so a task would get many runs. The settings that tell are those of the session that
        reads; so that the caller's stay as they are, a copy of it does. (A SparkSession made in Python would become the one
        that `RDD.toDF` uses.)
        """
        own, reader = self.spark._jsparkSession.cloneSession(), self.spark.read
        conf = own.conf()
        conf.set("spark.sql.files.openCostInBytes", conf.get("spark.sql.files.maxPartitionBytes"))
        if parts is not None:
            conf.set("spark.sql.shuffle.partitions", str(parts))
            conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        reader._jreader = own.read()
        return reader

    def _paths(self, ids: Iterable[int]) -> list[str]:
        return [f"{self.root}/data/{self.live[i]['path']}" for i in sorted(ids)]

    def _run(self, ids: Iterable[int]) -> DataFrame | None:
        """Runs as a frame of the caller's session: it starts with an empty one of theirs, which the optimizer drops."""
        paths = self._paths(ids)
        empty = "SELECT '' AS key, '' AS value, 0L AS tid, 0L AS seq WHERE false"
        return self.spark.sql(empty).unionByName(self._reader().schema(LOG).parquet(*paths)) if paths else None

    def log(self, low: str | None = None, high: bytes | None = None) -> DataFrame:
        """All versions, less runs that hold no key in [low, high): those are never opened."""
        ids = [i for i, m in self.live.items() if (low is None or m["last_key"].encode() >= low.encode()) and (high is None or m["first_key"].encode() < high)]
        own = self._run(ids)
        parts = [x for x in (own, self._pending() if self.buffer or own is None else None) if x is not None]
        return reduce(DataFrame.unionByName, parts)

    # ---- writes

    def put(self, key: str, value: str) -> int:
        return self.put_batch([(key, value)])

    def put_batch(self, pairs: Sequence[tuple[str, str]]) -> int:
        """All pairs under one tid, later ones winning; returns it. An empty value deletes."""
        return self.write(pairs, self.allocate())

    def remove(self, key: str) -> int:
        return self.put_batch([(key, "")])

    def remove_batch(self, keys: Sequence[str]) -> int:
        return self.put_batch([(k, "") for k in keys])

    def write(self, pairs: Sequence[tuple[str, str]], tid: int) -> int:
        """Log and gather the pairs: once this returns, they survive a crash of the driver."""
        if any(k is None or v is None for k, v in pairs):
            raise ValueError("keys and values are never null")
        if pairs:
            self._append([(k.encode(), v.encode(), tid) for k, v in pairs])
        at = self.buffer[-1][3] + 1 if self.buffer else 0
        self.buffer += [(k, v, tid, at + i) for i, (k, v) in enumerate(pairs)]
        if len(self.buffer) >= self.buffer_rows:
            self.flush()
        return tid

    def _append(self, entries: list[tuple[bytes, bytes, int]]) -> None:
        if self.log_file is not None and self.log_file.size >= self.segment_bytes:
            self._roll()
        if self.log_file is None:
            self.log_file = self.files.appender(f"{self.root}/wal/wal.{self.segment}")
        self.log_file.write(binary.encode_wal(entries, self.log_file.size))

    def _roll(self) -> None:
        """End the current segment, if it has begun."""
        if self.log_file is not None:
            self.log_file.close()
            self.log_file, self.segment = None, self.segment + 1

    def write_frame(self, df: DataFrame, source: str | None = None, batch: int | None = None) -> int | None:
        """A DataFrame (key, value[, seq]) under one tid, straight to level 0; returns the tid.

        With a source and a batch number, a batch that was committed before is left out (None): replays of a
        stream's micro-batch don't write twice.
        """
        if source is not None and self.batches.get(source, -1) >= batch:
            return None
        self.flush()
        tid = self.allocate()
        seq = F.col("seq") if "seq" in df.columns else F.lit(0)
        self._commit(checked(df.select("key", "value", F.lit(tid).alias("tid"), seq.alias("seq"))), 0, (), tid, source, batch)
        return tid

    def sync(self) -> None:
        """Force the log to disk: logged writes then survive a loss of power too."""
        if self.log_file is not None:
            self.log_file.sync()

    def flush(self) -> None:
        """Write what is gathered as one run of level 0."""
        if self.buffer:
            self._roll()
            rows, top = self._pending(), max(r[2] for r in self.buffer)
            size = sum(len(k.encode()) + len(v.encode()) + ENTRY_OVERHEAD for k, v, _, _ in self.buffer)
            before, self.flushed = self.flushed, self.segment - 1
            try:
                self._commit(rows, 0, (), top, n_bytes=size)
            except BaseException:
                self.flushed = before
                raise
            self.buffer = []
            self._clean_wal()

    flush_all = flush

    def _clean_wal(self) -> None:
        """Drop the segments that are in runs, but for the newest: its number tells where to go on."""
        segments = sorted(self._segments())
        for n in segments[:-1]:
            if n <= self.flushed:
                self.files.delete(f"{self.root}/wal/wal.{n}")

    # ---- commits

    def _parts(self, n_bytes: int) -> int:
        return max(1, -(-n_bytes // self.file_bytes))

    def _commit(self, rows: DataFrame, level: int, removed: Iterable[int], checkpoint: int, source: str | None = None, batch: int | None = None, n_bytes: int | None = None) -> None:
        """Write rows as runs of a level, then record them.

        There are as many runs as n_bytes (an upper bound) asks for; where it isn't given, the rows are measured first. The
        size of shuffled data would not tell: compressed, it may be a small part of what a task has to sort.
        """
        first, attempt = self.next_sst, f"{uuid.uuid4().hex}/level={level}"
        path = f"{self.root}/data/{attempt}"
        sized = rows.withColumn("size", entry_bytes(F.col("key"), F.col("value")))
        if n_bytes is None:
            n_bytes = sized.agg(F.sum("size")).first()[0] or 0
        # Level 0 is always merged as a whole, so there a key's versions may spread over runs. Deeper runs go one by one.
        own = compaction.in_files(sized, self._parts(n_bytes), first, whole_keys=level > 0)
        writer = own.write.partitionBy("sst_id")
        if self.bloom:  # the writer makes a Bloom filter only where the column has no dictionary
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.enable.dictionary#key", "false")
        writer.parquet(path)
        made = [int(n[7:]) for n in self.files.names(path) if n.startswith("sst_id=")]
        stats = self._stats([f"{attempt}/sst_id={i}" for i in made], path) if made else []
        added = [{**r, "level": level, "path": f"{attempt}/sst_id={r['sst_id']}"} for r in stats]
        self.next_sst = 1 + max(made, default=first - 1)
        self._record(added, removed, checkpoint, source, batch)

    def _stats(self, paths: list[str], base: str) -> list[dict]:
        """The catalogue columns of one attempt's runs, from their narrow columns: values are not read."""
        found = self._reader().schema(RUN + ", sst_id long").option("basePath", base).parquet(*[f"{self.root}/data/{p}" for p in paths])
        stats = found.groupBy("sst_id").agg(F.min("tid").alias("min_tid"), F.max("tid").alias("max_tid"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
        return [r.asDict() for r in stats.collect()]

    def _record(self, added: list[dict], removed: Iterable[int], checkpoint: int, source: str | None, batch: int | None) -> None:
        """One manifest version: runs that come and go become so at once."""
        version, top = self.version + 1, max(self.checkpoint, checkpoint)
        tail = (top, source, batch, self.flushed, self.next_sst)
        events = [(version, "ADD", *[r[k] for k in META], *tail) for r in added]
        events += [(version, "REMOVE", i, *[None] * 8, *tail) for i in removed]
        self._publish(events or [(version, "NONE", *[None] * 9, *tail)], f"version={version}")
        self.version, self.checkpoint = version, top
        if source is not None:
            self.batches[source] = batch
        for i in removed:
            self.live.pop(i, None)
        for r in added:
            self.live[r["sst_id"]] = {k: r[k] for k in META}
        if version % self.snapshot_every == 0:
            self.snapshot()

    def _publish(self, events: list[tuple], name: str) -> None:
        made = f"{self.root}/manifest/_{uuid.uuid4().hex}"
        self.spark.createDataFrame(events, MANIFEST).coalesce(1).write.parquet(made)
        self.files.publish(made, f"{self.root}/manifest/{name}")

    def snapshot(self) -> None:
        """Write the live runs as one snapshot, so that opening needs no older event."""
        if not self.files.exists(f"{self.root}/manifest/snapshot={self.version}"):
            tail = (self.flushed, self.next_sst)
            events = [(self.version, "ADD", *[m[k] for k in META], self.checkpoint, None, None, *tail) for m in self.live.values()]
            events += [(self.version, "NONE", *[None] * 9, self.checkpoint, s, b, *tail) for s, b in [(None, None), *self.batches.items()]]
            self._publish(events, f"snapshot={self.version}")

    # ---- reads

    def get(self, key: str, as_of: int | None = None) -> str | None:
        """The newest live value, or the one visible at as_of; None if missing or deleted."""
        row = reads.get(self.log(key, key.encode() + b"\0"), key, as_of).first()
        return row.value if row else None

    def get_batch(self, keys: Sequence[str], as_of: int | None = None) -> list[tuple[str, str | None]]:
        """(key, value or None), one for each key, in the order asked."""
        log = self.log()
        return [(r.key, r.value) for r in reads.get_in_order(log, reads.requests(log, keys), as_of).collect()]

    def get_frame(self, wanted: DataFrame, as_of: int | None = None) -> DataFrame:
        """get_many over a DataFrame (pos, key) of any size."""
        return reads.get_many(self.log(), wanted, as_of)

    def get_prefix_range(self, prefix: str, as_of: int | None = None) -> DataFrame:
        from palimpsest.functions.keys import prefix_end

        return reads.prefix_scan(self.log(prefix or None, prefix_end(prefix)), prefix, as_of)

    def range(self, start: str | None, end: str | None, as_of: int | None = None) -> DataFrame:
        """Live rows with start <= key < end."""
        return reads.range_scan(self.log(start, end.encode() if end is not None else None), start, end, as_of)

    def scan(self, as_of: int | None = None) -> DataFrame:
        return reads.scan(self.log(), as_of)

    def view(self, name: str, as_of: int | None = None) -> None:
        """Register the live rows as a temporary view, for SQL."""
        live(self.log(), as_of).createOrReplaceTempView(name)

    def get_manifest_info(self) -> list[dict]:
        return [self.live[i] for i in sorted(self.live)]

    def level_ranges(self, level: int) -> list[tuple[str, str]]:
        return [(m["first_key"], m["last_key"]) for m in self.live.values() if m["level"] == level]

    # ---- maintenance

    def compact(self, level: int = 0) -> bool:
        """Merge all of level 0, or one run of a deeper level in turn, into the level below; False if empty."""
        self.flush()
        own = sorted((m for m in self.live.values() if m["level"] == level), key=lambda m: (m["first_key"].encode(), m["sst_id"]))
        if not own:
            return False
        if level:
            after = [m for m in own if m["first_key"] > self.pointers.get(level, "")] or own
            own = after[:1]
            self.pointers[level] = own[0]["first_key"]
        low, high = min(m["first_key"].encode() for m in own), max(m["last_key"].encode() for m in own)
        below = [m for m in self.live.values() if m["level"] == level + 1 and m["first_key"].encode() <= high and m["last_key"].encode() >= low]
        ids = [m["sst_id"] for m in own + below]
        deeper = self.manifest().where(F.col("level") > level + 1)
        size = sum(m["n_bytes"] for m in own + below)
        log = self._reader(self._parts(size)).schema(LOG).parquet(*self._paths(ids))
        self._commit(compaction.compact(log, deeper), level + 1, ids, self.checkpoint, n_bytes=size)
        return True

    def maintain(self) -> int:
        """Compact every level that is due, down the levels; returns how many compactions ran."""
        self.flush()
        ran, level = 0, 0
        while level <= max((m["level"] for m in self.live.values()), default=-1):
            due = {r.level: r.due for r in catalog.due(self.manifest()).collect()}
            if due.get(level) and self.compact(level):
                ran += 1
                if level:
                    continue
            level += 1
        return ran

    def vacuum(self) -> int:
        """Delete what no reader of the current version needs: runs that are not live (returned: how many), what
        failed attempts left, and manifest events before the newest snapshot."""
        used = {m["path"] for m in self.live.values()}
        gone = 0
        for attempt in self.files.names(f"{self.root}/data"):
            kept = False
            for level in self.files.names(f"{self.root}/data/{attempt}"):
                for run in self.files.names(f"{self.root}/data/{attempt}/{level}"):
                    if run.startswith("sst_id="):
                        if f"{attempt}/{level}/{run}" in used:
                            kept = True
                        else:
                            self.files.delete(f"{self.root}/data/{attempt}/{level}/{run}")
                            gone += 1
            if not kept:
                self.files.delete(f"{self.root}/data/{attempt}")
        names = self.files.names(f"{self.root}/manifest")
        base = max((int(n[9:]) for n in names if n.startswith("snapshot=")), default=0)
        for n in names:
            kind, _, at = n.partition("=")
            if n.startswith("_") or kind == "version" and int(at) <= base or kind == "snapshot" and int(at) < base:
                self.files.delete(f"{self.root}/manifest/{n}")
        return gone

    def clear(self) -> None:
        """Drop all rows and files and start over. One manifest version makes the store empty; then its files go."""
        self._roll()
        self.flushed = self.segment - 1
        self._record([], list(self.live), self.checkpoint, None, None)
        for part in ("wal", "data", "manifest"):
            self.files.delete(f"{self.root}/{part}")
        self.pointers = {}
        self._open()

    def transaction(self, level: Isolation = Isolation.REPEATABLE_READ) -> Transaction:
        return Transaction(self, level)
