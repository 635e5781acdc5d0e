"""Operators against plain code: as-of joins, ranks, overlaps, Bloom filters, transaction records and times."""

import bisect
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from palimpsest.functions.checksums import _bytewise, bloom_size, crc32c
from palimpsest.operators import bloom, catalog, compaction, metrics, reads, transactions
from palimpsest.sources import binary

LOG = "key string, value string, tid long, seq long"


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_as_of_joins_of_a_hot_key(spark, slices):
    rng = random.Random(slices)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.choice(["", "v1", "v2", "v3"]), rng.randrange(400), i) for i in range(600)]
    asks = [(i, rng.choice(["hot", "k1", "k3", "gone"]), rng.randrange(-5, 420)) for i in range(200)] + [(900, "hot", None), (901, None, 5), (902, "hot", 10), (902, "hot", 10)]
    found = reads.as_of_join(spark.createDataFrame(rows, LOG), spark.createDataFrame(asks, "pos int, key string, as_of long"), slices).collect()
    expected = []
    for pos, key, at in asks:
        seen = max(((t, s, v) for k, v, t, s in rows if k == key and at is not None and t <= at), default=None)
        expected.append((pos, str(key), str(at), str(seen[2] or None) if seen else "None", seen[0] if seen else 0))
    assert sorted((r.pos, str(r.key), str(r.as_of), str(r.value), r.tid) for r in found) == sorted(expected)


def test_versions_nobody_asks_for_are_left_out_of_the_sort(spark, sf_dir):
    from palimpsest.queries import QUERIES

    plan = QUERIES["as_of_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert all("slice" in line for line in plan.splitlines() if "Window [" in line)


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot", int(rng.expovariate(0.001)) if rng.random() < 0.7 else 5) for _ in range(5000)] + [("two", 1), ("two", 9), ("one", 3), ("none", None), (None, 4)]
    df = spark.createDataFrame(rows, "g string, x long")
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    found = {(r.g, r.p): r.value for r in metrics.percentiles(df, ["g"], "x").collect()}
    assert found == {(g, p): sorted(x)[int(p * (len(x) - 1))] for g, x in by.items() for p in metrics.PERCENTILES}
    found = {(r.g, r.pct): r.value for r in metrics.cdf(df, ["g"], "x").collect()}
    assert found == {(g, p): sorted(x)[min(p * len(x) // 100, len(x) - 1)] for g, x in by.items() for p in range(5, 101, 5)}


def test_overlaps_of_many_ranges(spark):
    rng = random.Random(4)
    files = [(i, i % 2, *sorted(f"{rng.randrange(500):03d}" for _ in range(2))) for i in range(120)] + [(200, 0, "000", "999"), (201, 1, "", "zzz"), (202, 1, "250", "250")]
    found = catalog.overlapping_pairs(spark.createDataFrame(files, "sst_id long, level int, first_key string, last_key string"), 0, 1).collect()
    expected = [(a[0], b[0]) for a in files for b in files if a[1] == 0 and b[1] == 1 and a[2] <= b[3] and b[2] <= a[3]]
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert catalog.overlapping_pairs(spark.createDataFrame([], "sst_id long, level int, first_key string, last_key string"), 0, 1).count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 50, 256])
def test_slots_count_the_bounds_below(spark, n):
    bounds = sorted({f"{x:03d}" for x in random.Random(n).sample(range(1000), n)})
    from pyspark.sql import functions as F

    keys = spark.range(0, 1000, 7).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("key"))
    assert all(r.s == bisect.bisect_right(bounds, r.key) for r in keys.select("key", compaction.slot(F.col("key"), bounds).alias("s")).collect())


@pytest.mark.parametrize("n", [1, 3, 40, 400])
def test_covered_keys_of_any_number_of_ranges(spark, n):
    from pyspark.sql import functions as F

    draw = random.Random(n)
    begin = [draw.randrange(3000) for _ in range(n)]
    ranges = [(f"{b:04d}", f"{b + (draw.randrange(400) if draw.random() < 0.05 else draw.randrange(4)):04d}") for b in begin]
    files = spark.createDataFrame(ranges, "first_key string, last_key string")
    keys = spark.range(0, 4000, 3).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("key"), F.col("id").alias("more"))
    found = compaction.covered(keys, files)
    assert found.columns == ["key", "more"]
    assert sorted(tuple(r) for r in found.collect()) == [(f"{i:04d}", i) for i in range(0, 4000, 3) if any(a <= f"{i:04d}" <= z for a, z in ranges)]


def test_covered_keys_meet_no_ranges_and_are_computed_once(spark):
    """The sweep has no join, and the rows that stay and those that are asked share one aggregate."""
    log = spark.range(200).selectExpr("format_string('k%03d', id) key", "IF(id % 2 = 0, '', 'v') value", "id tid", "0L seq")
    deeper = spark.createDataFrame([("k010", "k020"), ("k015", "k150")], "first_key string, last_key string")
    found = compaction.compact(log, deeper)
    assert sorted(r.key for r in found.collect()) == sorted([f"k{i:03d}" for i in range(200) if i % 2 or 10 <= i <= 150])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ReusedExchange" in plan


def test_retaining_compactions_collect_old_tombstones(spark):
    log = spark.createDataFrame([("a", "1", 1, 0), ("a", "", 2, 0), ("b", "", 2, 0), ("c", "x", 2, 0), ("a", "2", 9, 0), ("b", "", 9, 0)], LOG)
    deeper = spark.createDataFrame([("b", "c")], "first_key string, last_key string")
    found = sorted(tuple(r) for r in compaction.compact(log, deeper, retain_since=5).select("key", "value", "tid").collect())
    assert found == [("a", "2", 9), ("b", "", 2), ("b", "", 9), ("c", "x", 2)]


def test_bloom_filters_never_miss(spark):
    rows = [(f, f"key{f}_{i}") for f in range(3) for i in range(200)] + [(0, "日本"), (0, "日本"), (9, "")]
    filters = bloom.build(spark.createDataFrame(rows, "sst_id long, key string"), expected=200, rate=0.01)
    asked = spark.createDataFrame([(k,) for _, k in rows] + [(f"no{i}",) for i in range(500)], "key string")
    found = {tuple(r) for r in bloom.may_contain(filters, asked, expected=200, rate=0.01).collect()}
    assert set(rows) <= found
    false = found - set(rows)
    assert len(false) < 0.03 * 4 * (500 + 3 * 200)
    bits, hashes = bloom_size(200, 0.01)
    for r in bloom.filled(filters, expected=200, rate=0.01).collect():
        data = binary.encode_bloom(200, 0.01, hashes, bits, bytes(r.bits))
        assert binary.decode_bloom(data) == (200, 0.01, hashes, bits, bytes(r.bits)) and any(r.bits)
        with pytest.raises(ValueError):
            binary.decode_bloom(data[:-1])


def test_bloom_places_hash_a_key_once_and_unasked_words_go_first(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "sst_id long, key string")
    filters = bloom.build(rows)
    plan = filters._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and plan.count("conv(") == 2
    plan = bloom.may_contain(filters, rows.select("key"))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    assert "Aggregate" in lines[semi - 1] and "mask" in lines[semi - 1]  # the filters' bits combine above the semi join


RECORDS = st.lists(st.tuples(st.integers(0, 2**64 - 1), st.sampled_from(transactions.OPERATIONS), st.binary(max_size=30), st.binary(max_size=30)), max_size=12)


@given(RECORDS)
def test_transaction_records_round_trip(records):
    kept = [(t, op, k if op in ("PUT", "DELETE") else b"", v if op == "PUT" else b"") for t, op, k, v in records]
    data = binary.encode_records(records)
    assert list(binary.decode_records(data)) == kept
    if data:
        with pytest.raises(ValueError):
            list(binary.decode_records(data[:-1]))


def test_equal_records(spark):
    rows = [(1, "CREATE", "x", None), (1, "CREATE", None, "y"), (1, "DELETE", "k", "a"), (1, "DELETE", "k", "b"), (1, "PUT", "k", "a"), (1, "PUT", "k", "b"), (2, "PUT", "k", "b"), (None, None, None, None)]
    found = transactions.distinct_records(spark.createDataFrame(rows, transactions.RECORD)).collect()
    assert sorted((str(r.tid), str(r.op), r.n) for r in found) == sorted([("1", "CREATE", 2), ("1", "DELETE", 2), ("1", "PUT", 1), ("1", "PUT", 1), ("2", "PUT", 1), ("None", "None", 1)])


def test_the_book_of_times_outlives_its_process():
    book = transactions.TidBook()
    tids = [book.take() for _ in range(6)]
    assert tids == list(range(6))
    for t in (1, 2, 4, 5):
        book.end(t, aborted=t == 2)
    book.flush(1)
    assert book.flushed == {1} and book.checkpoint == 1
    book.flush(4)  # settles the aborted 2 as well; 3 is still open
    assert book.flushed == {2, 4} and book.checkpoint == 2
    again = transactions.TidBook.decode(book.encode())
    assert (again.next_tid, again.flushed) == (6, {2, 4})
    again.end(3)
    again.flush(3)
    assert again.flushed == {4}
    again.flush(77)
    assert again.flushed == {4}
    with pytest.raises(ValueError):
        transactions.TidBook.decode(book.encode()[:-1])


@given(st.binary(max_size=200), st.integers(0, 40))
def test_checksums_in_lanes(data, times):
    data *= times + 1
    assert crc32c(data) == _bytewise(0xFFFFFFFF, data) ^ 0xFFFFFFFF
