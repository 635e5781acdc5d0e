"""Binary layouts, checksums, reports, generated data, catalogue edges and cache simulation."""

import random

from hypothesis import given
from hypothesis import strategies as st

from palimpsest.functions import checksums, keys
from palimpsest.operators import catalog, compaction, metrics
from palimpsest.sources import binary, reports


def test_checksums():
    assert checksums.crc32c(b"123456789") == 0xE3069283
    assert all(checksums.unmask(checksums.mask(c)) == c for c in (0, 1, 0xFFFFFFFF, 0xDEADBEEF))
    assert checksums.bloom_size(65_536, 0.01) == (628_167, 7)


def test_shards_agree_with_plain_integers():
    def plain(key):
        h = m = 0xBF58476D1CE4E5B9
        for c in key:
            h = ((h ^ c) * m) % 2**64
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD % 2**64
        return (h ^ h >> 33) & 7

    many = [b"", b"a", b"key_0001", "日本".encode(), bytes(range(200))]
    assert checksums.shard_hash(many).tolist() == [plain(k) for k in many]


ENTRIES = st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=60), st.integers(0, 2**63)), min_size=1, max_size=20)


@given(ENTRIES)
def test_blocks_tables_and_logs_round_trip(entries):
    assert list(binary.decode_block(binary.encode_block(entries))) == entries
    assert list(binary.decode_wal(binary.encode_wal(entries))) == entries
    cut = [entries[: len(entries) // 2 + 1], entries[len(entries) // 2 + 1 :]]
    table = binary.encode_table([b for b in cut if b])
    assert [e[1:] for e in binary.decode_table(table)] == entries


def test_log_records_span_blocks_and_stop_at_damage():
    entries = [(b"k%d" % i, bytes([i]) * 20_000, i) for i in range(8)]
    data = binary.encode_wal(entries)
    assert list(binary.decode_wal(data)) == entries
    assert list(binary.decode_wal(data[:-5])) == entries[:-1]
    assert list(binary.decode_wal(data[:50] + b"\xff" + data[51:])) == []


def test_manifest_replay_stops_at_damage():
    events = [("ADD", 1, 0, 5, 9, b"a", b"m"), ("ADD", 2, 1, 1, 4, b"", b"z"), ("REMOVE", 1)]
    data = binary.encode_manifest(events)
    assert list(binary.decode_manifest(data)) == events
    assert list(binary.decode_manifest(data[:-1])) == events[:2]
    assert list(binary.decode_manifest(data[:20] + b"\xff" + data[21:])) == []


def test_binary_readers(spark, tmp_path):
    (tmp_path / "wal.3").write_bytes(binary.encode_wal([(b"k", b"v", 7), (b"k2", b"", 8)]))
    rows = binary.read_wal(spark, str(tmp_path / "wal.3")).collect()
    assert [(r.key, r.value, r.tid, r.segment, r.pos) for r in rows] == [("k", "v", 7, 3, 0), ("k2", "", 8, 3, 1)]
    (tmp_path / ("sst_" + "5".zfill(32) + ".1")).write_bytes(binary.encode_table([[(b"a", b"1", 1)], [(b"b", b"2", 2)]]))
    rows = binary.read_tables(spark, str(tmp_path / ("sst_" + "5".zfill(32) + ".1"))).collect()
    assert [(r.key, r.tid, r.level, r.sst_id, r.block_id) for r in rows] == [("a", 1, 1, 5, 0), ("b", 2, 1, 5, 1)]
    (tmp_path / "MANIFEST").write_bytes(binary.encode_manifest([("ADD", 1, 0, 5, 9, b"a", b"m"), ("ADD", 2, 0, 1, 4, b"b", b"c"), ("REMOVE", 1)]))
    live = catalog.live_files(binary.read_manifest(spark, str(tmp_path / "MANIFEST")))
    assert [(r.sst_id, r.max_tid) for r in live.collect()] == [(2, 4)]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("write", "1t", 10.0, 1.0, 2.0, 3.0, 4.0), ("write", "4t", 30.0, 1.0, 2.0, 3.0, 4.0)], reports.RESULT)
    reports.write_csv(rows, str(tmp_path / "csv"))
    best = metrics.peaks(reports.read_csv(spark, str(tmp_path / "csv")))
    assert best.first().asDict() == {"benchmark": "write", "variant": "4t", "ops_per_sec": 30.0, "mean_ops": 20.0}
    assert reports.markdown(best).splitlines()[-1] == "| write | 4t | 30.0 | 20.0 |"


def test_prefix_end():
    assert keys.prefix_end("ab") == b"ac" and keys.prefix_end(b"a\xff\xff") == b"b"
    assert keys.prefix_end(b"\xff") is None and keys.prefix_end("") is None


def test_random_numbers_stay_in_range(spark):
    df = spark.range(2000, numPartitions=2).select(keys.random_int(-3, 5, seed=4).alias("x"))
    found = [r.x for r in df.collect()]
    assert set(found) == set(range(-3, 6)) and found == [r.x for r in df.collect()]


def test_nearest_ranks(spark):
    df = spark.createDataFrame([("g", x) for x in (1, 2, 3, 4)], "g string, x long")
    assert {r.p: r.value for r in metrics.percentiles(df, ["g"], "x", (0.5, 0.95)).collect()} == {0.5: 2, 0.95: 3}
    assert {r.pct: r.value for r in metrics.cdf(df, ["g"], "x", 25).collect()} == {25: 2, 50: 3, 75: 4, 100: 4}
    assert metrics.percentiles(df.where("false"), ["g"], "x").count() == 0


def test_compressed_ids(spark):
    def run(ids):
        return sorted(r.id for r in metrics.compress_ids(spark.createDataFrame([(i,) for i in ids], "id long")).collect())

    assert run([1, 2, 3, 5, 6, 9, 3]) == [3, 5, 6, 9] and run([4]) == [4] and run([]) == [] and run([1, 3]) == [1, 3]


def test_cache_against_a_plain_model(spark):
    rng = random.Random(3)
    trace = [(t, i, rng.randrange(4), rng.randrange(5)) for t in (1, 2) for i in range(300)]

    def model(accesses, capacity=6):
        young, old, uses, hits = [], [], {}, []
        for a in accesses:  # most recent first
            if a in old:
                old.remove(a)
                old.insert(0, a)
                hits.append(True)
            elif a in young:
                young.remove(a)
                old.insert(0, a)
                hits.append(True)
            else:
                if len(young) + len(old) >= capacity:
                    (young or old).pop()
                young.insert(0, a)
                hits.append(False)
        return hits

    df = spark.createDataFrame(trace, "trace_id long, step long, sst_id int, block_id int")
    found = {(r.trace_id, r.step): r.hit for r in metrics.simulate_cache(df, 6).collect()}
    for t in (1, 2):
        assert [found[t, i] for i in range(300)] == model([(s, b) for x, _, s, b in trace if x == t])


def test_range_cover_at_every_boundary(spark):
    rng = random.Random(5)
    files = [(a, a + rng.randrange(12)) for a in (rng.randrange(1000) for _ in range(60))]
    ranges = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in files], "first_key string, last_key string")
    points = spark.range(1020).selectExpr("lpad(id, 4, '0') AS key")
    found = {int(r.key) for r in compaction.covered(points, ranges).collect()}
    assert found == {k for k in range(1020) if any(a <= k <= b for a, b in files)}
    assert compaction.covered(points, ranges.where("false")).count() == 0
