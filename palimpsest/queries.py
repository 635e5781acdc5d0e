"""The registered queries over the driver's tables, each with the SQL that it must equal.

Two mutation logs are derived from the tables: `ev` (one version per tid) from events and `li` (batches, ties,
overwrites) from lineitem. Placement A deals li to files by time, placement B to narrow key ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.checksums import bloom_size
from palimpsest.functions.keys import entry_bytes, make_key, make_value
from palimpsest.operators import bloom, catalog, compaction, metrics, reads, recovery, transactions
from palimpsest.plans.visibility import live, visible, winners
from palimpsest.sources import binary
from palimpsest.sources.files import shared_folder
from palimpsest.sources.store import VersionedStore
from palimpsest.streaming.ingest import ingest

KEYS = [f"part:{i:08d}" for i in (5, 17, 1, 5, 999_999_999, 30)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    return e.select(key.alias("key"), F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("value"), (F.col("event_id") + 1).alias("tid"), F.lit(0).cast("long").alias("seq"))


def li_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    key = F.concat(F.lit("part:"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))
    value = F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat("l_returnflag", "l_linestatus"))
    return t.select(key.alias("key"), value.alias("value"), (F.col("l_orderkey") + 1).alias("tid"), F.col("l_linenumber").cast("long").alias("seq"))


def placed_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By time: 2000 tids a file; the newest four files are level 0, the others level 1."""
    log = li_log(spark, sf_dir).withColumn("sst_id", F.expr("(tid - 1) div 2000"))
    top = log.agg(F.max("sst_id").alias("top"))
    return log.join(F.broadcast(top)).withColumn("level", F.when(F.col("sst_id") > F.col("top") - 4, 0).otherwise(1)).drop("top")


def placed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half at level 0 by time; of the rest, 25 keys a file, by turns of level 1 and 0."""
    log = li_log(spark, sf_dir).withColumn("p", F.substring("key", 6, 8).cast("int"))
    log = log.join(F.broadcast(log.agg(F.max("tid").alias("mx"))))
    late = F.col("tid") * 2 > F.col("mx")
    upper = late | (F.expr("(p div 25) % 2") == 1)
    return log.withColumn("level", F.when(upper, 0).otherwise(1)).withColumn("sst_id", F.when(late, F.expr("tid div 1000")).otherwise(100_000 + F.expr("p div 25"))).drop("p", "mx")


def manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement A's files added in order; every third is removed later, and every sixth added again."""
    files = catalog.file_stats(placed_a(spark, sf_dir))
    base = files.select("sst_id", *catalog.META)
    add = base.select(F.col("sst_id").alias("version"), F.lit("ADD").alias("action"), "sst_id", *catalog.META)
    gone = base.where("sst_id % 3 = 0").select((F.col("sst_id") + 1_000_000).alias("version"), F.lit("REMOVE").alias("action"), "sst_id", *catalog.META)
    back = base.where("sst_id % 6 = 0").select((F.col("sst_id") + 2_000_000).alias("version"), F.lit("ADD").alias("action"), "sst_id", *catalog.META)
    return add.unionByName(gone).unionByName(back)


def wal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ev as log entries, 1000 a segment."""
    ev = ev_log(spark, sf_dir)
    return ev.select("key", "value", "tid", F.expr("(tid - 1) div 1000").alias("segment"), F.expr("(tid - 1) % 1000").alias("pos"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timed operations: ns from value, windows of 500 operations, hits by type."""
    e = _table(spark, sf_dir, "events")
    return e.select("event_type", F.floor(F.abs("value") * 1000).cast("long").alias("ns"), F.expr("event_id div 500").alias("window_id"), (F.col("event_type") != "error").alias("hit"))


def write_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction's writes: one key for each supplier, every third one a deletion."""
    s = _table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("part:"), F.lpad((F.col("s_suppkey") + 1).cast("string"), 8, "0"))
    return s.select(key.alias("key"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("T"), F.col("s_suppkey").cast("string"))).alias("value"), F.lit(0).cast("long").alias("seq"))


EV = "ev AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, event_id + 1 AS tid, CAST(0 AS BIGINT) AS seq FROM events)"
LI = "li AS (SELECT 'part:' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS key, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag || l_linestatus END AS value, l_orderkey + 1 AS tid, CAST(l_linenumber AS BIGINT) AS seq FROM lineitem)"
A = LI + ", a AS (SELECT *, (tid - 1) // 2000 AS sst_id, CASE WHEN (tid - 1) // 2000 > (SELECT max((tid - 1) // 2000) FROM li) - 4 THEN 0 ELSE 1 END AS level FROM li)"
B = LI + ", b0 AS (SELECT *, CAST(substr(key, 6, 8) AS INT) AS p, (SELECT max(tid) FROM li) AS mx FROM li), b AS (SELECT key, value, tid, seq, CASE WHEN tid * 2 > mx OR (p // 25) % 2 = 1 THEN 0 ELSE 1 END AS level, CASE WHEN tid * 2 > mx THEN tid // 1000 ELSE 100000 + p // 25 END AS sst_id FROM b0)"
SIZE = "CAST(strlen(key) + strlen(value) + 56 AS BIGINT)"
FILES = f"files AS (SELECT sst_id, level, min(tid) AS min_tid, max(tid) AS max_tid, min(key) AS first_key, max(key) AS last_key, count(*) AS n_rows, CAST(sum({SIZE}) AS BIGINT) AS n_bytes FROM {{}} GROUP BY sst_id, level)"
WAL = EV + ", wal AS (SELECT key, value, tid, (tid - 1) // 1000 AS segment, (tid - 1) % 1000 AS pos FROM ev)"
LAT = "lat AS (SELECT event_type, CAST(floor(abs(value) * 1000) AS BIGINT) AS ns, event_id // 500 AS window_id, event_type <> 'error' AS hit FROM events)"
WS = "ws AS (SELECT 'part:' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 8, '0') AS key, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'T' || CAST(s_suppkey AS VARCHAR) END AS value FROM supplier)"
MANIFEST = A + ", " + FILES.format("a") + ", m AS (SELECT sst_id AS version, 'ADD' AS action, * FROM files UNION ALL SELECT sst_id + 1000000, 'REMOVE', * FROM files WHERE sst_id % 3 = 0 UNION ALL SELECT sst_id + 2000000, 'ADD', * FROM files WHERE sst_id % 6 = 0)"
LIVE_M = MANIFEST + ", lm AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sst_id ORDER BY version DESC) AS rn FROM m) WHERE rn = 1 AND action = 'ADD')"


def won(source: str, where: str = "true") -> str:
    """SQL of the winners of a log."""
    return f"(SELECT key, value, tid, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tid DESC, seq DESC, value DESC) AS rn FROM {source} WHERE {where}) WHERE rn = 1)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- reads


@query(f"WITH {EV} SELECT key, value, tid FROM {won('ev')} WHERE value <> ''")
def live_scan(spark, sf_dir):
    return live(ev_log(spark, sf_dir))


@query(f"WITH {LI} SELECT key, value, tid FROM {won('li')} WHERE value <> ''")
def live_scan_batches(spark, sf_dir):
    return reads.scan(li_log(spark, sf_dir))


@query(f"WITH {LI} SELECT key, value, tid FROM {won('li')} WHERE value <> '' AND key = '{KEYS[1]}'")
def point_get(spark, sf_dir):
    return reads.get(li_log(spark, sf_dir), KEYS[1])


@query(f"WITH {LI}, w AS {won('li')} SELECT 0 AS pos, key, CAST(NULL AS VARCHAR) AS value, tid FROM w WHERE key = (SELECT min(key) FROM w WHERE value = '')")
def point_get_tombstoned(spark, sf_dir):
    log = li_log(spark, sf_dir)
    dead = winners(log).where("value = ''").agg(F.min("key").alias("key")).select(F.lit(0).alias("pos"), "key")
    return reads.get_many(log, dead)


_ASKED = ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYS))


@query(f"WITH {LI}, w AS {won('li')}, q(pos, key) AS (VALUES {_ASKED}) SELECT pos, q.key, nullif(value, '') AS value FROM q LEFT JOIN w USING (key)")
def multi_get(spark, sf_dir):
    log = li_log(spark, sf_dir)
    return reads.get_in_order(log, reads.requests(log, KEYS))


@query(f"WITH {LI}, w AS {won('li', 'tid <= 5000')}, q(pos, key) AS (VALUES {_ASKED}) SELECT pos, q.key, nullif(value, '') AS value, coalesce(tid, 0) AS tid FROM q LEFT JOIN w USING (key)")
def multi_get_snapshot(spark, sf_dir):
    log = li_log(spark, sf_dir)
    return reads.get_many(log, reads.requests(log, KEYS), as_of=5000)


@query(f"WITH {EV}, w AS {won('ev')}, q AS (SELECT o_orderkey AS pos, 'user:' || lpad(CAST(o_custkey % 300 AS VARCHAR), 6, '0') AS key FROM orders) SELECT pos, q.key, nullif(value, '') AS value, coalesce(tid, 0) AS tid FROM q LEFT JOIN w USING (key)")
def multi_get_frame(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    wanted = o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("user:"), F.lpad((F.col("o_custkey") % 300).cast("string"), 6, "0")).alias("key"))
    return reads.get_many(ev_log(spark, sf_dir), wanted)


@query(f"WITH {LI} SELECT key, value, tid FROM {won('li', 'tid <= 3000')} WHERE value <> '' AND key = '{KEYS[0]}'")
def snapshot_get(spark, sf_dir):
    return reads.get(li_log(spark, sf_dir), KEYS[0], as_of=3000)


@query(f"WITH {LI} SELECT key, value, tid FROM {won('li', 'tid <= 3000')} WHERE value <> ''")
def snapshot_scan(spark, sf_dir):
    return reads.scan(li_log(spark, sf_dir), as_of=3000)


@query(f"""WITH {EV}, q AS (SELECT o_orderkey AS pos, 'user:' || lpad(CAST(o_custkey % 300 AS VARCHAR), 6, '0') AS key, o_orderkey AS as_of FROM orders),
  j AS (SELECT pos, q.key, as_of, value, tid, row_number() OVER (PARTITION BY pos ORDER BY tid DESC, seq DESC, value DESC) AS rn FROM q LEFT JOIN ev ON ev.key = q.key AND tid <= as_of)
  SELECT pos, key, as_of, nullif(value, '') AS value, coalesce(tid, 0) AS tid FROM j WHERE rn = 1""")
def as_of_join(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    wanted = o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("user:"), F.lpad((F.col("o_custkey") % 300).cast("string"), 6, "0")).alias("key"), F.col("o_orderkey").alias("as_of"))
    return reads.as_of_join(ev_log(spark, sf_dir), wanted)


@query(f"WITH {LI} SELECT key, value, tid FROM {won('li')} WHERE value <> '' AND starts_with(key, 'part:0000001')")
def prefix_scan(spark, sf_dir):
    return reads.prefix_scan(li_log(spark, sf_dir), "part:0000001")


@query(f"WITH {LI} SELECT key, value, tid, seq FROM li WHERE starts_with(key, 'part:0000001') AND tid <= 4000")
def prefix_versions(spark, sf_dir):
    return reads.prefix_versions(li_log(spark, sf_dir), "part:0000001", as_of=4000)


@query(f"WITH {LI} SELECT key, value, tid FROM {won('li')} WHERE value <> '' AND key >= 'part:00000010' AND key < 'part:00000100'")
def range_scan(spark, sf_dir):
    return reads.range_scan(li_log(spark, sf_dir), "part:00000010", "part:00000100")


@query(f"WITH {EV}, {LI}, u AS (SELECT * FROM ev UNION ALL SELECT * FROM li) SELECT key, value, tid FROM {won('u')} WHERE value <> ''")
def merge_scan(spark, sf_dir):
    return live(reads.merge(ev_log(spark, sf_dir), li_log(spark, sf_dir)))


# ---- writes


@query("SELECT make_key AS key, CASE WHEN deleted THEN '' ELSE value END AS value, CAST(77 AS BIGINT) AS tid, CAST(i AS BIGINT) AS seq FROM (SELECT i, 'bk_' || lpad(CAST(i % 400 AS VARCHAR), 8, '0') AS make_key, i % 7 = 0 AS deleted, substr(repeat('abcdefghijklmnopqrstuvwxyz', 3), i % 26 + 1, 40) AS value FROM range(1000) t(i))")
def batch_write_rows(spark, sf_dir):
    """One batch under a single tid, deletions included, over generated keys and values."""
    i = F.col("id")
    value = F.when(i % 7 == 0, "").otherwise(make_value(40, i))
    return spark.range(1000).select(make_key("bk_", i % 400).alias("key"), value.alias("value"), F.lit(77).cast("long").alias("tid"), i.alias("seq"))


# ---- catalogue


@query(f"WITH {A} SELECT count(*) AS n_rows, count(DISTINCT key) AS n_keys, count(*) FILTER (WHERE value = '') AS n_tombstones, CAST(sum({SIZE}) AS BIGINT) AS n_bytes FROM a")
def overwrite_stats(spark, sf_dir):
    return catalog.size_stats(li_log(spark, sf_dir))


@query(f"WITH {LI} SELECT key, count(*) AS n_versions, count(*) FILTER (WHERE value = '') AS n_tombstones, CAST(sum({SIZE}) AS BIGINT) AS n_bytes FROM li GROUP BY key")
def key_stats(spark, sf_dir):
    return li_log(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n_versions"), F.count_if(F.col("value") == "").alias("n_tombstones"), F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("n_bytes"))


@query(f"WITH {LI} SELECT value = '' AS deleted, count(*) AS n_keys FROM {won('li')} GROUP BY 1")
def tombstone_stats(spark, sf_dir):
    return winners(li_log(spark, sf_dir)).groupBy((F.col("value") == "").alias("deleted")).agg(F.count("*").alias("n_keys"))


@query(f"WITH {A}, {FILES.format('a')} SELECT * FROM files")
def file_stats(spark, sf_dir):
    return catalog.file_stats(placed_a(spark, sf_dir))


@query(f"WITH {LIVE_M} SELECT sst_id, level, min_tid, max_tid, first_key, last_key FROM lm")
def manifest_live(spark, sf_dir):
    return catalog.live_files(manifest_log(spark, sf_dir))


@query(f"WITH {LIVE_M} SELECT CAST(coalesce(max(max_tid), 0) AS BIGINT) AS checkpoint FROM lm")
def checkpoint(spark, sf_dir):
    return catalog.checkpoint(catalog.live_files(manifest_log(spark, sf_dir)))


@query(f"WITH {A}, {FILES.format('a')} SELECT level, count(*) AS n_files, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM files GROUP BY level")
def level_stats(spark, sf_dir):
    return catalog.level_stats(catalog.file_stats(placed_a(spark, sf_dir)))


@query(f"WITH {A}, {FILES.format('a')} SELECT level, count(*) AS n_files, CAST(sum(n_bytes) // 1048576 AS BIGINT) AS mb, CASE WHEN level = 0 THEN count(*) >= 4 ELSE sum(n_bytes) // 1048576 >= 120 * pow(10, level - 1) END AS due FROM files GROUP BY level")
def compaction_due(spark, sf_dir):
    return catalog.due(catalog.file_stats(placed_a(spark, sf_dir)))


@query(f"WITH {B}, {FILES.format('b')} SELECT x.sst_id AS upper_id, y.sst_id AS lower_id FROM files x JOIN files y ON x.level = 0 AND y.level = 1 AND x.first_key <= y.last_key AND x.last_key >= y.first_key")
def overlapping_files(spark, sf_dir):
    return catalog.overlapping_pairs(catalog.file_stats(placed_b(spark, sf_dir)), 0, 1)


@query(f"WITH {B}, {FILES.format('b')} SELECT sst_id FROM files WHERE level = 1 AND first_key <= 'part:00000120' AND last_key >= 'part:00000060'")
def overlapping_range(spark, sf_dir):
    return catalog.overlapping(catalog.file_stats(placed_b(spark, sf_dir)), 1, "part:00000060", "part:00000120").select("sst_id")


@query(f"WITH {B}, {FILES.format('b')} SELECT sst_id FROM files WHERE level = 1 ORDER BY first_key <= 'part:00000060', first_key, sst_id LIMIT 1")
def compaction_pick(spark, sf_dir):
    return catalog.next_file(catalog.file_stats(placed_b(spark, sf_dir)), 1, "part:00000060").select("sst_id")


@query(f"WITH {B}, {FILES.format('b')} SELECT min(first_key) AS first_key, max(last_key) AS last_key FROM files WHERE level = 0")
def compaction_range(spark, sf_dir):
    return catalog.key_range(catalog.file_stats(placed_b(spark, sf_dir)).where("level = 0"))


_BLOCKS = A + f", s AS (SELECT *, coalesce(sum({SIZE}) OVER (PARTITION BY sst_id ORDER BY key, tid DESC, seq DESC, value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a), blk AS (SELECT sst_id, CAST(before // 4096 AS INT) AS block_id, min(key) AS first_key, max(key) AS last_key, count(*) AS n_rows FROM s GROUP BY 1, 2)"


@query(f"WITH {_BLOCKS} SELECT * FROM blk")
def block_index(spark, sf_dir):
    return catalog.block_index(placed_a(spark, sf_dir))


@query(f"WITH {_BLOCKS} SELECT * FROM blk WHERE first_key <= '{KEYS[1]}' AND last_key >= '{KEYS[1]}'")
def find_block(spark, sf_dir):
    return catalog.may_hold(catalog.block_index(placed_a(spark, sf_dir)), KEYS[1])


@query(f"WITH {_BLOCKS} SELECT * FROM blk WHERE last_key >= 'part:0000001' AND first_key < 'part:0000002'")
def find_block_range(spark, sf_dir):
    return catalog.may_hold_prefix(catalog.block_index(placed_a(spark, sf_dir)), "part:0000001")


_HASHED = "list_reduce(list_prepend(CAST(13787848793156543929 AS UHUGEINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS UHUGEINT))), lambda h, c: (xor(h, c) * CAST(13787848793156543929 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT))"


@query(f"WITH {LI}, h AS (SELECT *, {_HASHED} AS h0 FROM li), m AS (SELECT *, (xor(h0, h0 >> 33) * CAST(18397679294719823053 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS h1 FROM h) SELECT CAST(xor(h1, h1 >> 33) % 8 AS INT) AS shard, count(*) AS n_rows, CAST(sum({SIZE}) AS BIGINT) AS n_bytes FROM m GROUP BY 1")
def shard_counts(spark, sf_dir):
    return catalog.shard_counts(li_log(spark, sf_dir))


_BITS, _HASHES = bloom_size(bloom.EXPECTED, bloom.RATE)
_PLACE = f"(CAST('0x' || substr(md5(key), 1, 13) AS BIGINT) + i * (CAST('0x' || substr(md5(key), 14, 13) AS BIGINT) | 1)) % {_BITS} AS place"


@query(f"WITH {A}, q(key) AS (VALUES {', '.join(f"('{k}')" for k in dict.fromkeys(KEYS))}), has AS (SELECT DISTINCT sst_id, {_PLACE} FROM (SELECT DISTINCT sst_id, key FROM a), range({_HASHES}) t(i)), need AS (SELECT DISTINCT key, {_PLACE} FROM q, range({_HASHES}) t(i)) SELECT sst_id, key FROM need JOIN has USING (place) GROUP BY sst_id, key HAVING count(*) = (SELECT count(*) FROM need n WHERE n.key = need.key)")
def bloom_candidates(spark, sf_dir):
    """Files that a point read of each key has to open."""
    log = placed_a(spark, sf_dir)
    return bloom.may_contain(bloom.build(log), reads.requests(log, KEYS))


# ---- compaction, recovery


@query(f"WITH {B}, {FILES.format('b')}, w AS {won('b', 'level = 0')} SELECT key, value, tid, seq FROM w WHERE value <> '' OR EXISTS (SELECT 1 FROM files WHERE level = 1 AND first_key <= w.key AND w.key <= last_key)")
def compaction_output(spark, sf_dir):
    placed = placed_b(spark, sf_dir)
    return compaction.compact(placed.where("level = 0"), catalog.file_stats(placed.where("level = 1")))


@query(f"WITH {B}, {FILES.format('b')}, w AS {won('b', 'level = 0')} SELECT value = '' AS deleted, EXISTS (SELECT 1 FROM files WHERE level = 1 AND first_key <= w.key AND w.key <= last_key) AS covered, count(*) AS n FROM w GROUP BY 1, 2")
def tombstone_gc(spark, sf_dir):
    placed = placed_b(spark, sf_dir)
    won_rows = winners(placed.where("level = 0"))
    inside = compaction.covered(won_rows, catalog.file_stats(placed.where("level = 1"))).select("key", F.lit(True).alias("covered"))
    return won_rows.join(inside, "key", "left").groupBy((F.col("value") == "").alias("deleted"), F.coalesce("covered", F.lit(False)).alias("covered")).agg(F.count("*").alias("n"))


@query(f"WITH {B}, {FILES.format('b')}, w AS {won('b', 'level = 0 AND tid <= 4000')} SELECT key, value, tid, seq FROM w WHERE value <> '' OR EXISTS (SELECT 1 FROM files WHERE level = 1 AND first_key <= w.key AND w.key <= last_key) UNION ALL SELECT key, value, tid, seq FROM b WHERE level = 0 AND tid > 4000")
def compaction_retaining(spark, sf_dir):
    placed = placed_b(spark, sf_dir)
    return compaction.compact(placed.where("level = 0"), catalog.file_stats(placed.where("level = 1")), retain_since=4000)


@query(f"WITH {WAL} SELECT key, value, tid, segment * 1099511627776 + pos AS seq FROM wal WHERE tid > (SELECT max(tid) FROM wal) // 2")
def wal_replay(spark, sf_dir):
    wal = wal_log(spark, sf_dir)
    half = wal.agg(F.expr("max(tid) div 2")).first()[0] or 0
    return recovery.replay(wal, half)


@query(f"WITH {WAL} SELECT segment, count(*) AS n_entries, max(tid) AS max_tid FROM wal WHERE segment < (SELECT max(segment) FROM wal) GROUP BY segment HAVING max(tid) <= 2500")
def wal_segments_cleanable(spark, sf_dir):
    return recovery.cleanable_segments(wal_log(spark, sf_dir), 2500)


@query(f"WITH {EV} SELECT greatest(coalesce(max(tid), 0), 700) + 1 AS next_tid FROM ev")
def recovered_next_tid(spark, sf_dir):
    return recovery.next_tid(ev_log(spark, sf_dir), 700)


# ---- transactions


@query(f"WITH {LI}, {WS} SELECT key, max(tid) AS tid FROM li WHERE tid > 3000 AND key IN (SELECT key FROM ws) GROUP BY key")
def txn_conflicts(spark, sf_dir):
    return transactions.conflicts(li_log(spark, sf_dir), write_set(spark, sf_dir), 3000)


@query(f"WITH {LI}, {WS}, w AS {won('li')} SELECT key, coalesce(ws.value, w.value) AS value FROM w FULL JOIN ws USING (key) WHERE coalesce(ws.value, w.value) <> ''")
def txn_read_committed(spark, sf_dir):
    return transactions.overlay(li_log(spark, sf_dir), write_set(spark, sf_dir), None)


@query(f"WITH {LI}, {WS}, w AS {won('li', 'tid <= 3000')} SELECT key, coalesce(ws.value, w.value) AS value FROM w FULL JOIN ws USING (key) WHERE coalesce(ws.value, w.value) <> ''")
def txn_repeatable_read(spark, sf_dir):
    return transactions.overlay(li_log(spark, sf_dir), write_set(spark, sf_dir), 3000)


@query(f"WITH {LI}, {WS}, u AS (SELECT key, value, tid, seq FROM li UNION ALL SELECT key, value, 1000000000, 0 FROM ws) SELECT key, value, tid FROM {won('u')} WHERE value <> ''")
def txn_commit(spark, sf_dir):
    rows = transactions.committed(write_set(spark, sf_dir), 1_000_000_000)
    return live(reads.merge(li_log(spark, sf_dir), rows))


@query(f"WITH {LI}, {WS}, w AS {won('li', 'tid < 3000')} SELECT ws.key, coalesce(w.value, '') AS value, CAST(2000000000 AS BIGINT) AS tid, CAST(0 AS BIGINT) AS seq FROM ws LEFT JOIN w USING (key)")
def txn_rollback(spark, sf_dir):
    return transactions.rollback(li_log(spark, sf_dir), write_set(spark, sf_dir), 3000, 2_000_000_000)


@query(f"WITH {WS}, r AS (SELECT t.tid, CASE WHEN value = '' THEN 'DELETE' ELSE 'PUT' END AS op, key, nullif(value, '') AS value FROM ws, (VALUES (3000), (3001), (3000)) t(tid) UNION ALL SELECT t.tid, o.op, NULL, NULL FROM (VALUES (3000, 'COMMIT'), (3001, 'ROLLBACK'), (3000, 'COMMIT')) t(tid, fin), LATERAL (VALUES ('CREATE'), (t.fin)) o(op)) SELECT CAST(tid AS BIGINT) AS tid, op, key, value, count(*) AS n FROM r GROUP BY 1, 2, 3, 4")
def txn_records(spark, sf_dir):
    """Journals of two transactions, one of them logged twice; equal records counted."""
    own = write_set(spark, sf_dir)
    logs = [transactions.journal(own, own, tid, ended) for tid, ended in ((3000, "COMMIT"), (3001, "ROLLBACK"), (3000, "COMMIT"))]
    return transactions.distinct_records(logs[0].unionByName(logs[1]).unionByName(logs[2]))


# ---- metrics


@query("WITH d AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), r AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM d) SELECT id FROM r WHERE g <> (SELECT min(g) FROM r) UNION ALL SELECT max(id) FROM r WHERE g = (SELECT min(g) FROM r)")
def compress_ids(spark, sf_dir):
    """Orders without a line leave gaps."""
    return metrics.compress_ids(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@query(f"WITH {LAT}, g AS (SELECT event_type, list_sort(list(ns)) AS l, count(*) AS n FROM lat GROUP BY event_type) SELECT event_type, p, l[CAST(floor(p * (n - 1)) AS BIGINT) + 1] AS value FROM g, (VALUES (CAST(0.5 AS DOUBLE)), (0.95), (0.99), (0.999), (0.9999)) t(p)")
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(latencies(spark, sf_dir), ["event_type"], "ns")


@query(f"WITH {LAT}, g AS (SELECT event_type, list_sort(list(ns)) AS l, count(*) AS n FROM lat GROUP BY event_type) SELECT event_type, CAST(pct AS INT) AS pct, l[least(pct * n // 100, n - 1) + 1] AS value FROM g, range(5, 101, 5) t(pct)")
def latency_cdf(spark, sf_dir):
    return metrics.cdf(latencies(spark, sf_dir), ["event_type"], "ns")


@query(f"WITH {LAT} SELECT window_id, count(*) AS n, CAST(count(*) AS DOUBLE) * 1000000 / sum(ns) AS ops_per_sec FROM lat GROUP BY window_id HAVING sum(ns) > 0")
def throughput_windows(spark, sf_dir):
    rows = latencies(spark, sf_dir).groupBy("window_id").agg(F.count("*").alias("n"), F.sum("ns").alias("s")).where("s > 0")
    return rows.select("window_id", "n", (F.col("n").cast("double") * 1_000_000 / F.col("s")).alias("ops_per_sec"))


@query(f"WITH {LAT}, w AS (SELECT window_id, CAST(count(*) AS DOUBLE) * 1000000 / sum(ns) AS r FROM lat GROUP BY window_id HAVING sum(ns) > 0) SELECT arg_min(r, window_id) AS first_rate, arg_max(r, window_id) AS last_rate, min(r) AS min_rate, max(r) AS max_rate, (1 - arg_max(r, window_id) / arg_min(r, window_id)) * 100 AS degradation_pct FROM w")
def sustained_throughput(spark, sf_dir):
    return metrics.sustained(throughput_windows(spark, sf_dir)).drop("mean_rate")


@query(f"WITH {LAT} SELECT window_id, count(*) AS n, 100 * CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS hit_rate FROM lat GROUP BY window_id")
def hit_rate(spark, sf_dir):
    return metrics.hit_rate(latencies(spark, sf_dir), ["window_id"])


@query(f"WITH {LAT}, v AS (SELECT event_type AS benchmark, 'w' || CAST(window_id % 4 AS VARCHAR) AS variant, CAST(count(*) AS DOUBLE) AS ops_per_sec FROM lat GROUP BY 1, 2) SELECT benchmark, arg_max(variant, (ops_per_sec, variant)) AS variant, max(ops_per_sec) AS ops_per_sec, avg(ops_per_sec) AS mean_ops FROM v GROUP BY benchmark")
def benchmark_peaks(spark, sf_dir):
    v = latencies(spark, sf_dir).groupBy(F.col("event_type").alias("benchmark"), F.concat(F.lit("w"), (F.col("window_id") % 4).cast("string")).alias("variant")).agg(F.count("*").cast("double").alias("ops_per_sec"))
    return metrics.peaks(v)


@query(None)
def cache_lru2(spark, sf_dir):
    """Hits of a replayed access trace: each user's part of the events as block reads."""
    trace = _table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("step"), (F.col("event_id") % 7).alias("sst_id"), (F.col("event_id") % 3).alias("block_id"))
    return metrics.simulate_cache(trace, capacity=8)


@query(f"WITH {LI} SELECT count(*) AS n_oversized FROM li WHERE strlen(key) > 65535 OR strlen(value) > 1")
def oversized_rows(spark, sf_dir):
    return visible(li_log(spark, sf_dir)).where((F.octet_length("key") > 65_535) | (F.octet_length("value") > 1)).agg(F.count("*").alias("n_oversized"))


# ---- the persistent store: each query writes one into the shared folder and reads it back


def loaded_store(spark: SparkSession, sf_dir: str, compact_after: tuple[int, ...] = ()) -> VersionedStore:
    """li in four batches by time, one tid each, through `write_frame`; level 0 is compacted after the batches named."""
    log = li_log(spark, sf_dir)
    log = log.join(F.broadcast(log.agg(F.max("tid").alias("mx")))).select("key", "value", (F.col("tid") * 8 + F.col("seq")).alias("seq"), F.expr("tid * 4 div (mx + 1)").alias("batch"))
    store = VersionedStore(spark, shared_folder(spark, "store"))
    for k in range(4):
        store.write_frame(log.where(F.col("batch") == k).drop("batch"))
        if k in compact_after:
            store.compact(0)
    return store


def logged_store(spark: SparkSession, sf_dir: str) -> VersionedStore:
    """Single writes of the nations (25, whatever the scale), a flush, then writes that only the log holds; reopened."""
    nations = _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    regions = _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    store = VersionedStore(spark, shared_folder(spark, "store"))
    for n in nations:
        store.put(f"nation:{n.n_name}", f"n{n.n_regionkey}")
    store.flush()
    store.put_batch([(f"region:{r.r_name}", f"r{r.r_regionkey}") for r in regions])
    store.remove(f"region:{regions[0].r_name}")
    store.remove_batch([f"nation:{n.n_name}" for n in nations if n.n_regionkey == 2])
    store.sync()
    return VersionedStore(spark, store.root)


BATCHES = LI + ", bt AS (SELECT key, value, tid * 4 // ((SELECT max(tid) FROM li) + 1) + 1 AS tid, tid * 8 + seq AS seq FROM li)"
LOGGED = """n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS turn, count(*) OVER () AS most FROM nation), lg AS (
  SELECT 'nation:' || n_name AS key, 'n' || n_regionkey AS value, turn AS tid, 0 AS seq FROM n
  UNION ALL SELECT 'region:' || r_name, 'r' || r_regionkey, (SELECT max(most) + 1 FROM n), 0 FROM region
  UNION ALL SELECT 'region:' || r_name, '', (SELECT max(most) + 2 FROM n), 0 FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)
  UNION ALL SELECT 'nation:' || n_name, '', most + 3, 0 FROM n WHERE n_regionkey = 2)"""


@query(f"WITH {BATCHES} SELECT key, value, tid FROM {won('bt')} WHERE value <> ''")
def store_batches(spark, sf_dir):
    return loaded_store(spark, sf_dir).scan()


@query(f"WITH {BATCHES} SELECT key, value, tid FROM {won('bt', 'tid <= 2')} WHERE value <> ''")
def store_snapshot_scan(spark, sf_dir):
    return loaded_store(spark, sf_dir).scan(as_of=2)


@query(f"WITH {BATCHES} SELECT key, value, tid, seq FROM {won('bt')} WHERE value <> ''")
def store_compacted(spark, sf_dir):
    """The rows left in the runs: two compactions into the lowest level drop old versions and tombstones."""
    return loaded_store(spark, sf_dir, compact_after=(1, 3)).log()


@query(f"WITH {BATCHES}, w AS {won('bt')}, q(pos, key) AS (VALUES {_ASKED}) SELECT pos, q.key, nullif(value, '') AS value, coalesce(tid, 0) AS tid FROM q LEFT JOIN w USING (key)")
def store_multi_get(spark, sf_dir):
    store = loaded_store(spark, sf_dir, compact_after=(2,))
    return store.get_frame(reads.requests(store.log(), KEYS))


@query(f"WITH {BATCHES} SELECT key, value, tid FROM {won('bt')} WHERE value <> '' AND starts_with(key, 'part:0000001')")
def store_prefix(spark, sf_dir):
    return loaded_store(spark, sf_dir, compact_after=(2,)).get_prefix_range("part:0000001")


@query(f"WITH {BATCHES} SELECT key, value, tid FROM {won('bt')} WHERE value <> ''")
def store_backfilled(spark, sf_dir):
    """The store opens from the runs that it finds where its manifest is gone."""
    store = loaded_store(spark, sf_dir)
    store.files.delete(f"{store.root}/manifest")
    return VersionedStore(spark, store.root).scan()


@query(f"WITH {LOGGED} SELECT key, value, tid FROM {won('lg')} WHERE value <> ''")
def store_logged_writes(spark, sf_dir):
    return logged_store(spark, sf_dir).scan()


@query(f"WITH {LOGGED} SELECT key, value, tid FROM lg")
def store_versions(spark, sf_dir):
    """Every version, deletions included, from runs and replayed log."""
    return logged_store(spark, sf_dir).log().select("key", "value", "tid")


@query(f"WITH {LI} SELECT key, value, CAST(1 AS BIGINT) AS tid FROM {won('li')} WHERE value <> ''")
def store_cleared(spark, sf_dir):
    """A cleared store holds nothing of before, log and times included."""
    store = logged_store(spark, sf_dir)
    store.clear()
    store.write_frame(li_log(spark, sf_dir).select("key", "value", (F.col("tid") * 8 + F.col("seq")).alias("seq")))
    return VersionedStore(spark, store.root).scan()


@query(f"WITH {LOGGED}, tx(key, value, tid, seq) AS (SELECT 'region:' || r_name, 'second', (SELECT max(most) + 5 FROM n), 0 FROM region UNION ALL SELECT 'region:new', 'second', (SELECT max(most) + 5 FROM n), 0), u AS (SELECT * FROM lg UNION ALL SELECT * FROM tx) SELECT key, value, tid FROM {won('u')} WHERE value <> ''")
def store_transactions(spark, sf_dir):
    """Of two transactions on the regions the later commits first and wins; a third is aborted; what stays is reopened."""
    store = logged_store(spark, sf_dir)
    names = [r.r_name for r in _table(spark, sf_dir, "region").collect()]
    first, second, third = (store.transaction() for _ in range(3))
    for t, said in ((second, "second"), (first, "first"), (third, "third")):
        for name in (*names, "new"):
            t.put(f"region:{name}", said)
    third.abort()
    second.commit()
    try:
        first.commit()
    except transactions.Conflict:
        pass
    return VersionedStore(spark, store.root).scan()


@query(f"WITH {EV} SELECT key, value FROM {won('ev')} WHERE value <> ''")
def store_stream_ingest(spark, sf_dir):
    """ev as a stream, taken up by two runs of one query: what the first committed doesn't come again."""
    store = VersionedStore(spark, shared_folder(spark, "store"))
    # The pattern lets a stream read a table that is one file as well as one that is a folder.
    e = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    rows = e.select(key.alias("key"), F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("value"), F.col("event_id").alias("seq"))
    for _ in range(2):
        ingest(rows, store, "events", f"{store.root}-progress").awaitTermination()
    return store.scan().select("key", "value")


# ---- binary formats: encoded and decoded again inside the tasks, a batch of rows a file


def _recoded(df: DataFrame, recode, schema: str, by: str | None = None) -> DataFrame:
    """recode(rows) for each batch of rows, or for all rows of a value of `by`, which a format bounds."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]
    frame = lambda pdf: pd.DataFrame(recode(list(pdf.itertuples(index=False))), columns=names)
    if by is not None:
        return df.groupBy(by).applyInPandas(frame, schema)
    return df.mapInPandas(lambda batches: map(frame, batches), schema)


@query(f"WITH {EV} SELECT key, value, tid FROM ev")
def wal_codec(spark, sf_dir):
    def recode(rows):
        data = binary.encode_wal([(r.key.encode(), r.value.encode(), r.tid) for r in rows])
        return [(k.decode(), v.decode(), t) for k, v, t in binary.decode_wal(data)]

    return _recoded(ev_log(spark, sf_dir), recode, "key string, value string, tid long")


@query(f"WITH {A} SELECT sst_id, key, value, tid FROM a")
def table_codec(spark, sf_dir):
    """Placement A's files as sorted tables of blocks of 64 entries."""

    def recode(rows):
        rows = sorted(rows, key=lambda r: (r.key.encode(), -r.tid, -r.seq))
        blocks = [[(r.key.encode(), r.value.encode(), r.tid) for r in rows[i : i + 64]] for i in range(0, len(rows), 64)]
        found = list(binary.decode_table(binary.encode_table(blocks)))
        return [(rows[0].sst_id, k.decode(), v.decode(), t) for _, k, v, t in found]

    return _recoded(placed_a(spark, sf_dir), recode, "sst_id long, key string, value string, tid long", "sst_id")


@query(f"WITH {MANIFEST} SELECT version, action, sst_id, CASE action WHEN 'ADD' THEN level END AS level, CASE action WHEN 'ADD' THEN first_key END AS first_key, CASE action WHEN 'ADD' THEN last_key END AS last_key FROM m")
def manifest_codec(spark, sf_dir):
    def recode(rows):
        events = [("REMOVE", r.sst_id) if r.action == "REMOVE" else ("ADD", r.sst_id, r.level, r.min_tid, r.max_tid, r.first_key.encode(), r.last_key.encode()) for r in rows]
        out = []
        for r, (action, sst, *rest) in zip(rows, binary.decode_manifest(binary.encode_manifest(events))):
            out.append((r.version, action, sst, rest[0], rest[3].decode(), rest[4].decode()) if rest else (r.version, action, sst, None, None, None))
        return out

    return _recoded(manifest_log(spark, sf_dir), recode, "version long, action string, sst_id long, level int, first_key string, last_key string")


@query(f"WITH {WS} SELECT CAST(3000 AS BIGINT) AS tid, CASE WHEN value = '' THEN 'DELETE' ELSE 'PUT' END AS op, key, value FROM ws")
def record_codec(spark, sf_dir):
    def recode(rows):
        records = [(3000, "PUT" if r.value else "DELETE", r.key.encode(), r.value.encode()) for r in rows]
        return [(t, op, k.decode(), v.decode()) for t, op, k, v in binary.decode_records(binary.encode_records(records))]

    return _recoded(write_set(spark, sf_dir), recode, "tid long, op string, key string, value string")


@query(f"WITH {A} SELECT sst_id, count(DISTINCT place) AS n_bits, CAST({_BITS} AS BIGINT) AS bits FROM (SELECT sst_id, {_PLACE} FROM (SELECT DISTINCT sst_id, key FROM a), range({_HASHES}) t(i)) GROUP BY sst_id")
def bloom_codec(spark, sf_dir):
    """Each file's filter as bytes and back: how many bits are set."""

    def recode(rows):
        for r in rows:
            _, _, _, bits, filled = binary.decode_bloom(binary.encode_bloom(bloom.EXPECTED, bloom.RATE, _HASHES, _BITS, bytes(r.bits)))
            yield r.sst_id, int.from_bytes(filled, "little").bit_count(), bits

    return _recoded(bloom.filled(bloom.build(placed_a(spark, sf_dir))), recode, "sst_id long, n_bits long, bits long")
