"""Snapshot visibility: tables of versions and what each time must show."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palimpsest.operators import reads
from palimpsest.plans.log import LOG, checked
from palimpsest.plans.visibility import live, visible, winners


def log_of(spark, rows):
    """rows: (tid, key, value), in order of arrival."""
    return spark.createDataFrame([(k, v, t, i) for i, (t, k, v) in enumerate(rows)], LOG)


def seen(log, as_of):
    return {r.key: r.value for r in live(log, as_of).collect()}


def test_each_time_sees_its_version(spark):
    log = log_of(spark, [(100, "test_key", "value_100"), (200, "test_key", "value_200"), (300, "test_key", "value_300")])
    expected = {99: None, 100: 100, 150: 100, 200: 200, 250: 200, 300: 300, 400: 300}
    for at, version in expected.items():
        assert seen(log, at) == ({"test_key": f"value_{version}"} if version else {})


def test_deletions_show_as_empty_below_and_missing_above(spark):
    log = log_of(spark, [(100, "k", "value_100"), (200, "k", "value_200"), (300, "k", ""), (400, "k", "value_400")])
    raw = {at: winners(visible(log, at)).first().value for at in (250, 300, 350, 400, 500)}
    assert raw == {250: "value_200", 300: "", 350: "", 400: "value_400", 500: "value_400"}
    assert seen(log, 350) == {}


THREE = [(100, "key1", "v1_100"), (200, "key1", "v1_200"), (300, "key1", ""), (400, "key1", "v1_400"), (150, "key2", "v2_150"), (250, "key2", "v2_250"), (350, "key2", "v2_350"), (120, "key3", "v3_120"), (220, "key3", "v3_220"), (320, "key3", "v3_320"), (420, "key3", "")]
SNAPSHOTS = {
    90: (None, None, None),
    110: ("v1_100", None, None),
    180: ("v1_100", "v2_150", "v3_120"),
    250: ("v1_200", "v2_250", "v3_220"),
    320: (None, "v2_250", "v3_320"),
    450: ("v1_400", "v2_350", None),
}


def test_three_keys(spark):
    log = log_of(spark, THREE)
    for at, values in SNAPSHOTS.items():
        found = seen(log, at)
        assert tuple(found.get(k) for k in ("key1", "key2", "key3")) == values


def test_interleaved_writers(spark):
    rows = [(100, "A"), (150, "B"), (200, "C"), (250, "D"), (300, "E"), (350, "A"), (400, "C"), (450, "-E"), (500, "B"), (550, "-D"), (600, "-A"), (650, "A"), (700, "D")]
    log = log_of(spark, [(t, k.strip("-"), "" if k[0] == "-" else f"{k}_v{t}") for t, k in rows])
    expected = {325: "A100 B150 C200 D250 E300", 475: "A350 B150 C400 D250", 625: "B500 C400", 750: "A650 B500 C400 D700"}
    for at, versions in expected.items():
        assert seen(log, at) == {x[0]: f"{x[0]}_v{x[1:]}" for x in versions.split()}


def test_ties_zero_and_only_deleted(spark):
    log = log_of(spark, [(100, "same", "first"), (100, "same", "second"), (100, "same", "third"), (100, "gone", ""), (0, "zero", "value_at_zero")])
    assert seen(log, 100) == {"same": "third", "zero": "value_at_zero"}
    assert seen(log, 99) == seen(log, 0) == {"zero": "value_at_zero"}
    assert reads.get(log, "same", as_of=0).first().value == "third"  # a point read at 0 reads the newest
    assert reads.get(log, "missing").first() is None
    assert [r.key for r in reads.prefix_versions(log, "", as_of=0).collect()] == ["zero"]


def test_prefix_in_byte_order(spark):
    log = log_of(spark, [(0, f"key{i}", "v") for i in range(101)])
    assert [r.key for r in reads.prefix_scan(log, "key1").collect()] == ["key1", "key10", "key100", *(f"key{i}" for i in range(11, 20))]
    special = ["key\nwith\nnewlines", "key\twith\ttabs", "key with spaces", "key/with/slashes", "key:with:colons", "日本語キー", "emoji🎉key", "user:10:", "user:1:"]
    log = log_of(spark, [(1, k, "v") for k in special])
    assert [r.key for r in reads.scan(log).collect()] == sorted(special, key=str.encode)


PREFIXED = [("user:1:name", [(100, "Alice"), (200, "Alicia")]), ("user:1:age", [(100, "25"), (150, "26")]), ("user:2:name", [(100, "Bob"), (250, "Robert")]), ("user:2:age", [(100, "30")]), ("user:10:city", [(100, "NY"), (300, "LA")]), ("product:1:name", [(100, "Laptop")]), ("product:2:price", [(100, "999")])]


@pytest.mark.parametrize(
    ("prefix", "at", "expected"),
    [("user:1:", 150, ["25", "26", "Alice"]), ("user:1:", 200, ["25", "26", "Alice", "Alicia"]), ("user:", 300, ["LA", "NY", "25", "26", "Alice", "Alicia", "30", "Bob", "Robert"]), ("user:1:", 50, [])],
)
def test_all_versions_under_a_prefix(spark, prefix, at, expected):
    log = log_of(spark, [(t, k, v) for k, versions in PREFIXED for t, v in versions])
    rows = reads.prefix_versions(log, prefix, at).collect()
    assert [v for _, v in sorted((r.key.encode(), r.value) for r in rows)] == expected


@pytest.mark.parametrize(("at", "n"), [(1050, 1), (2050, 2), (3050, 3), (999, 0)])
def test_versions_of_a_range_family(spark, at, n):
    log = log_of(spark, [(1000 * v + i, f"key_{i:04d}", f"value_v{v}_{i:04d}") for v in (1, 2, 3) for i in range(100)])
    assert reads.prefix_versions(log, "key_0050", at).count() == n


def test_multi_get_keeps_order_misses_and_repeats(spark):
    log = log_of(spark, [(1, "exists_a", "alpha"), (2, "exists_b", "beta"), (3, "dead", "x"), (4, "dead", "")])
    asked = ["exists_a", "missing_x", "exists_b", "dead", "exists_a"]
    rows = reads.get_in_order(log, reads.requests(log, asked)).collect()
    assert [(r.key, r.value) for r in rows] == list(zip(asked, ["alpha", None, "beta", None, "alpha"]))
    tids = {r.pos: r.tid for r in reads.get_many(log, reads.requests(log, asked)).collect()}
    assert tids == {0: 1, 1: 0, 2: 2, 3: 4, 4: 1}
    assert reads.get_in_order(log, reads.requests(log, [])).count() == 0


def test_tombstones_must_be_dropped_after_the_winner(spark):
    log = log_of(spark, [(1, "k", "old"), (2, "k", "")])
    assert seen(log, None) == {}
    assert winners(log.where("value <> ''")).count() == 1  # the wrong order brings the key back


def test_nulls_are_refused(spark):
    with pytest.raises(Exception, match="no null value"):
        checked(spark.sql("SELECT 'k' key, CAST(NULL AS STRING) value, 1L tid, 0L seq")).collect()


def test_filters_reach_the_scan(spark, tmp_path):
    log_of(spark, [(1, "a1", "x"), (2, "b1", "y")]).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a1)" in plan(reads.get(log, "a1", 5)) and "LessThanOrEqual(tid,5)" in plan(reads.get(log, "a1", 5))
    assert "StringStartsWith(key,a)" in plan(reads.prefix_scan(log, "a"))
    assert "GreaterThanOrEqual(key,a)" in plan(reads.range_scan(log, "a", "b"))


WRITES = st.lists(st.tuples(st.integers(0, 6), st.sampled_from("abc"), st.sampled_from(["", "x", "y"])), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(WRITES, st.integers(0, 6))
def test_against_a_dictionary(spark, rows, at):
    model = {}
    for t, k, v in sorted(rows, key=lambda r: r[0]):  # stable: arrival breaks ties
        if t <= at:
            model[k] = v
    log = log_of(spark, rows)
    assert seen(log, at) == {k: v for k, v in model.items() if v}
    asked = spark.createDataFrame([(i, k, at) for i, k in enumerate("abc")], "pos long, key string, as_of long")
    assert {r.key: r.value for r in reads.as_of_join(log, asked).collect()} == {k: model.get(k) or None for k in "abc"}
