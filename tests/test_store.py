"""The persistent store: façade, flush, compaction, recovery, transactions, streams."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.keys import ENTRY_OVERHEAD
from palimpsest.operators.transactions import Conflict, Isolation
from palimpsest.plans.visibility import winners
from palimpsest.sources.store import VersionedStore
from palimpsest.streaming.ingest import ingest


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "store"), file_bytes=20_000)


def pairs(df):
    return [(r.key, r.value) for r in df.collect()]


def test_write_delete_write_with_flushes(store):
    store.put("k", "v1")
    store.flush()
    assert store.get("k") == "v1"
    store.remove("k")
    assert store.get("k") is None
    store.flush()
    assert store.get("k") is None
    store.put("k", "v2")
    assert store.get("k") == "v2"
    store.put("k", "")
    assert store.get("k") is None and store.get("never") is None


def test_removed_batches_stay_hidden_before_and_after_flush(store):
    store.put_batch([(f"k{i}", "v") for i in range(20)])
    store.flush()
    store.remove_batch([f"k{i}" for i in range(0, 20, 2)])
    assert store.get("k4") is None and store.get("k5") == "v"
    store.flush()
    assert store.get_batch(["k4", "k5", "nope"]) == [("k4", None), ("k5", "v"), ("nope", None)]


def family(store):
    for name in ("alpha", "beta", "gamma"):
        store.put_batch([(f"{name}_{i:04d}", f"{name}_v1_{i}") for i in range(200)])
        store.put_batch([(f"noise_{name}_{i * 7919 % 1000:06d}", "n") for i in range(50)])
    for name in ("alpha", "beta"):
        store.put_batch([(f"{name}_{i:04d}", f"{name}_v2_{i}") for i in range(0, 200, 2)])
    store.remove_batch([f"gamma_{i:04d}" for i in range(50)])
    store.put_batch([(f"gamma_{i:04d}", f"gamma_v1_{i}") for i in range(200, 250)])


@pytest.mark.parametrize("flushed", [False, True])
def test_prefixes_with_overwrites_and_deletions(store, flushed):
    family(store)
    if flushed:
        store.flush_all()
    for name in ("alpha", "beta"):
        assert pairs(store.get_prefix_range(name + "_")) == [(f"{name}_{i:04d}", f"{name}_v{1 if i % 2 else 2}_{i}") for i in range(200)]
    assert [k for k, _ in pairs(store.get_prefix_range("gamma_"))] == [f"gamma_{i:04d}" for i in range(50, 250)]
    assert pairs(store.get_prefix_range("nonexist_")) == []
    assert [k for k, _ in pairs(store.range("alpha_0010", "alpha_0013"))] == ["alpha_0010", "alpha_0011", "alpha_0012"]


def test_deletions_survive_compactions(store):
    store.put_batch([(f"del_key_{i:05d}", f"v{i}") for i in range(300)])
    store.flush()
    store.remove_batch([f"del_key_{i:05d}" for i in range(0, 300, 2)])
    store.flush()
    store.put_batch([(f"new_key_{i:05d}", "n") for i in range(100)])
    assert store.compact(0) and not store.compact(0)
    while store.level_ranges(1):  # as many runs as the sizes of what was merged allow
        assert store.compact(1)
    found = dict(pairs(store.scan()))
    assert found == {f"del_key_{i:05d}": f"v{i}" for i in range(1, 300, 2)} | {f"new_key_{i:05d}": "n" for i in range(100)}
    assert {m["level"] for m in store.get_manifest_info()} == {2}
    assert store.vacuum() > 0 and len(pairs(store.scan())) == 250


def test_compaction_drops_tombstones_only_outside_deeper_ranges(store):
    for k in ("a", "b"):  # level 2 holds a to b
        store.put(k, "old")
    store.compact(0), store.compact(1)
    store.remove_batch(["b", "z"])
    store.compact(0)
    left = {r.key for r in store.log().where("value = ''").collect()}
    assert left == {"b"} and store.get("b") is None
    store.compact(1)
    assert {r.key for r in winners(store.log()).collect()} == {"a"}


def test_partly_overlapping_compactions(store):
    for lo in (0, 150, 75):
        store.put_batch([(f"k{i:04d}", f"{lo}") for i in range(lo, lo + 150)])
        store.compact(0)
    expected = {f"k{i:04d}": str(75 if 75 <= i < 225 else 0 if i < 150 else 150) for i in range(300)}
    assert dict(pairs(store.scan())) == expected
    assert all(store.get(k) == expected[k] for k in ("k0000", "k0074", "k0075", "k0224", "k0225", "k0299"))


def test_files_are_cut_by_size_with_disjoint_ranges(store):
    store.put_batch([(f"k{i:05d}", "x" * 50) for i in range(2000)])
    store.compact(0)
    files = sorted(store.get_manifest_info(), key=lambda m: m["first_key"])
    assert len(files) > 3 and all(a["last_key"] < b["first_key"] for a, b in zip(files, files[1:]))
    assert sum(m["n_rows"] for m in files) == 2000


def test_maintenance_follows_the_policy(store):
    for n in range(4):
        store.put(f"k{n}", "v")
        store.flush()
    assert store.maintain() == 1 and {m["level"] for m in store.get_manifest_info()} == {1}


def test_clear_starts_over(store):
    family(store)
    store.flush()
    store.clear()
    assert store.get("alpha_0001") is None and store.get_manifest_info() == []
    store.put("new", "1")
    store.flush()
    assert pairs(store.scan()) == [("new", "1")]


def test_reopening_twice_and_replay(spark, store):
    store.put("flushed", "1")
    store.flush()
    early = store.transaction(Isolation.READ_COMMITTED)
    store.put("later", "2")
    store.flush()
    early.put("early", "3")
    early.commit()  # its time is older than what is flushed already
    store.put("synced", "4")
    store.sync()
    store.put("logged", "5")  # the log has it once put returns
    for _ in range(2):
        again = VersionedStore(spark, store.root)
        assert dict(pairs(again.scan())) == {"flushed": "1", "later": "2", "early": "3", "synced": "4", "logged": "5"}
        assert again.tid > max(r.tid for r in again.log().collect())
    again.flush()
    assert dict(pairs(VersionedStore(spark, store.root).scan())) == {"flushed": "1", "later": "2", "early": "3", "synced": "4", "logged": "5"}


def test_writes_after_a_reopening_survive(spark, store):
    """The log was cleaned by then; its numbers must not begin again below what is flushed."""
    expected = {}
    for i in range(4):
        store.put(f"a{i}", "1")
        if i % 2 == 0:
            store.flush()
        expected[f"a{i}"] = "1"
        store = VersionedStore(spark, store.root)
        assert dict(pairs(store.scan())) == expected and store.get(f"a{i}") == "1"


class Crash(RuntimeError):
    pass


STEPS = ["roll", "data", "stats", "manifest", "recorded", "clean"]


def crash_at(monkeypatch, step):
    """Let a store fail at a step of flush or commit, before or after what the step does."""
    from palimpsest.sources.files import Files

    def fail(*_, **__):
        raise Crash(step)

    real = VersionedStore._record
    if step == "roll":
        monkeypatch.setattr(VersionedStore, "_commit", fail)
    elif step == "data":
        monkeypatch.setattr(Files, "names", lambda self, path: fail() if "/data/" in path else [])
    elif step == "stats":
        monkeypatch.setattr(VersionedStore, "_stats", fail)
    elif step == "manifest":
        monkeypatch.setattr(Files, "publish", fail)
    elif step == "recorded":
        monkeypatch.setattr(VersionedStore, "_record", lambda *a: (real(*a), fail()))
    elif step == "clean":
        monkeypatch.setattr(Files, "delete", fail)


@pytest.mark.parametrize("step", STEPS)
def test_a_crash_at_any_step_of_a_flush_loses_and_invents_nothing(spark, store, step):
    store.put("a", "1")
    store.flush()
    store.put("b", "2")
    store.remove("a")
    store.sync()
    with pytest.MonkeyPatch.context() as patch:
        crash_at(patch, step)
        try:
            store.flush()
        except Crash:
            pass
    for _ in range(2):
        again = VersionedStore(spark, store.root)
        assert dict(pairs(again.scan())) == {"b": "2"} and again.get("b") == "2" and again.get("a") is None
    again.put("c", "3")
    again.flush()
    again.vacuum()
    assert dict(pairs(VersionedStore(spark, store.root).scan())) == {"b": "2", "c": "3"}


@pytest.mark.parametrize("step", STEPS[:-1])
def test_a_commit_that_failed_stays_unseen(spark, store, step):
    def ghost(key):
        return spark.createDataFrame([(key, "x")], "key string, value string")

    store.put("a", "1")
    store.flush()
    with pytest.MonkeyPatch.context() as patch:
        crash_at(patch, step)
        with pytest.raises(Crash):
            store.write_frame(ghost("ghost"), "feed", 1)
    seen = {"a": "1"} | ({"ghost": "x"} if step == "recorded" else {})
    for _ in range(2):
        again = VersionedStore(spark, store.root)
        assert dict(pairs(again.scan())) == seen
    again.write_frame(ghost("b"), "feed", 2)
    assert dict(pairs(VersionedStore(spark, store.root).scan())) == seen | {"b": "x"}
    again.compact(0)
    again.vacuum()
    assert dict(pairs(VersionedStore(spark, store.root).scan())) == seen | {"b": "x"}


def test_segments_roll_and_the_newest_stays(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "rolling"), segment_bytes=300)
    for i in range(12):
        store.put(f"k{i}", "v" * 50)
    before = store._segments()
    assert len(before) > 2
    assert len(pairs(VersionedStore(spark, store.root).scan())) == 12
    store.flush()
    assert store._segments() == before[-1:]
    assert len(pairs(VersionedStore(spark, store.root).scan())) == 12


def test_a_torn_log_record_ends_its_segment_only(spark, store):
    store.put("a", "1")
    store.put("b", "2")
    store._roll()
    path = f"{store.root}/wal/wal.0"
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-3])
    again = VersionedStore(spark, store.root)
    again.put("c", "3")
    assert dict(pairs(VersionedStore(spark, store.root).scan())) == {"a": "1", "c": "3"}


def test_opening_without_a_manifest_takes_up_the_runs(spark, store):
    store.put_batch([(f"k{i:03d}", "old") for i in range(50)])
    store.compact(0)
    store.put_batch([(f"k{i:03d}", "new") for i in range(10)])
    store.flush()
    store.put("logged", "1")
    store.vacuum()
    expected = dict(pairs(store.scan()))
    levels = sorted(m["level"] for m in store.get_manifest_info())
    spark.createDataFrame([("ghost", "x", 999, 0, 1)], "key string, value string, tid long, seq long, size long").write.parquet(f"{store.root}/data/torn/level=0/sst_id=0")  # no mark of success
    store.files.delete(f"{store.root}/manifest")
    for _ in range(2):
        again = VersionedStore(spark, store.root)
        assert dict(pairs(again.scan())) == expected and sorted(m["level"] for m in again.get_manifest_info()) == levels
    again.put("more", "2")
    again.flush()
    assert dict(pairs(VersionedStore(spark, store.root).scan())) == expected | {"more": "2"}


def test_snapshots_bound_what_opening_reads(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "many"), snapshot_every=3)
    df = spark.createDataFrame([("k", "v")], "key string, value string")
    for i in range(7):
        store.write_frame(df.withColumn("value", F.lit(str(i))), "feed", i)
    store.compact(0)
    store.vacuum()
    names = store.files.names(f"{store.root}/manifest")
    assert names == ["snapshot=6", "version=7", "version=8"]
    again = VersionedStore(spark, store.root)
    assert again.get("k") == "6" and again.batches == {"feed": 6} and again.next_sst == store.next_sst
    assert again.write_frame(df, "feed", 6) is None


def test_keys_have_bloom_filters(spark, tmp_path):
    import glob
    import os

    sizes = {}
    for bloom in (True, False):
        store = VersionedStore(spark, str(tmp_path / str(bloom)), bloom=bloom)
        store.put_batch([(f"k{i * 7919 % 5000}", "v") for i in range(2000)])
        store.flush()
        [path] = glob.glob(f"{store.root}/data/*/level=0/sst_id=0/*.parquet")
        sizes[bloom] = os.path.getsize(path)
    assert sizes[True] > sizes[False] + 2000


def test_snapshots_survive_flushes(store):
    first = store.put("k", "1")
    store.put("k", "2")
    store.flush()
    assert store.get("k", as_of=first) == "1" and store.get("k") == "2"


def test_frames_and_sql(spark, store):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("v").alias("value"))
    assert store.write_frame(df, "job", 1) and store.write_frame(df, "job", 1) is None
    store.view("kv")
    assert spark.sql("SELECT count(*) AS n FROM kv").first().n == 500
    wanted = spark.createDataFrame([(0, "k7"), (1, "zz")], "pos int, key string")
    assert {r.pos: r.value for r in store.get_frame(wanted).collect()} == {0: "v", 1: None}


def test_isolation_levels(store):
    store.put("k", "0")
    dirty, committed, repeat = (store.transaction(x) for x in (Isolation.READ_UNCOMMITTED, Isolation.READ_COMMITTED, Isolation.REPEATABLE_READ))
    assert repeat.get("k") == "0"
    dirty.put("k", "dirty")
    assert committed.get("k") == "dirty" and repeat.get("k") == "0"
    dirty.abort()
    assert committed.get("k") == "0" and store.get("k") == "0"
    committed.put("mine", "1")
    committed.remove("k")
    assert committed.get("mine") == "1" and committed.get("k") is None and store.get("mine") is None
    committed.commit()
    assert store.get("mine") == "1"
    with pytest.raises(RuntimeError):
        committed.get("k")


@pytest.mark.parametrize("level", [Isolation.REPEATABLE_READ, Isolation.SERIALIZABLE])
def test_the_first_committer_wins(store, level):
    store.put("k", "0")
    one, two = store.transaction(level), store.transaction(level)
    two.put("k", "two")
    two.commit()
    one.put("k", "one")
    with pytest.raises(Conflict):
        one.commit()
    assert store.get("k") == "two"


def test_streaming_ingest_is_exactly_once(spark, store, tmp_path):
    source = str(tmp_path / "in")
    schema = "key string, value string"
    spark.createDataFrame([("a", "1"), ("b", "2")], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for _ in range(2):
        ingest(stream, store, "feed", str(tmp_path / "checkpoint")).awaitTermination()
    assert dict(pairs(store.scan())) == {"a": "1", "b": "2"} and store.log().count() == 2
    assert store.write_frame(spark.createDataFrame([("a", "again")], schema), "feed", 0) is None


def test_runs_keep_to_their_size_however_well_rows_compress(spark, store):
    """More runs than the session shuffles to, of one key's versions too; each sorted, and all of them read."""
    hot = spark.range(3000).select(F.lit("hot").alias("key"), F.lit("v").alias("value"), F.col("id").alias("seq"))
    cold = spark.range(3000).select(F.format_string("k%05d", "id").alias("key"), F.lit("v").alias("value"), F.col("id").alias("seq"))
    store.write_frame(hot.unionByName(cold))
    runs = store.get_manifest_info()
    assert len(runs) >= 17 and sum(m["n_rows"] for m in runs) == 6000
    assert max(m["n_bytes"] for m in runs) < 3 * store.file_bytes
    for m in runs:
        rows = [(r.key, -r.seq) for r in spark.read.parquet(f"{store.root}/data/{m['path']}").coalesce(1).collect()]
        assert rows == sorted(rows)
    assert [r.seq for r in winners(store.log()).where("key = 'hot'").collect()] == [2999] and store.scan().count() == 3001
    assert store.compact(0) and store.scan().count() == 3001
    store.write_frame(hot.where("false"))
    assert store.scan().count() == 3001


def test_backfilling_shuffles_runs_statistics_not_their_rows(spark, store):
    """The catalogue found again is the one that was; the rows combine before they are dealt by run."""
    for turn in range(2):
        store.write_frame(spark.range(2000).select(F.format_string("k%05d", "id").alias("key"), F.lit(f"v{turn}").alias("value")))
    columns = "level, min_tid, max_tid, first_key, last_key, n_rows, n_bytes, path".split(", ")
    kept = lambda s: sorted(tuple(m[c] for c in columns) for m in s.get_manifest_info())
    expected = kept(store)
    store.files.delete(f"{store.root}/manifest")
    before = set(_stages(spark))
    again = VersionedStore(spark, store.root)
    assert kept(again) == expected and len(expected) > 8
    assert max(n for stage, n in _stages(spark).items() if stage not in before) < 500


def _stages(spark):
    """The rows that each stage so far wrote to a shuffle."""
    status = spark.sparkContext._jsc.sc().statusStore()
    found = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}


def test_a_task_reads_one_run_and_merges_a_run_s_worth(spark, store, monkeypatch):
    """Reads and compaction, whatever the session's settings, which stay."""
    from palimpsest.operators import compaction

    for turn in range(2):
        store.write_frame(spark.range(2000).select(F.format_string("k%05d", "id").alias("key"), F.lit(f"v{turn}").alias("value")))
    runs = store.get_manifest_info()
    assert len(runs) > 12
    before = _settings(spark)
    read = lambda df: [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.countDistinct("path").alias("n")).collect()]
    assert read(store.log().select(F.input_file_name().alias("path"))) == [1] * len(runs)
    merged, compact = [], compaction.compact
    monkeypatch.setattr(compaction, "compact", lambda log, deeper: merged.append((log, compact(log, deeper))) or merged[0][1])
    assert store.compact(0)
    log, left = merged[0]
    assert read(log.select(F.input_file_name().alias("path"))) == [1] * len(runs)
    tasks = [r["count"] for r in left.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 10 and max(tasks) < 400 and sum(tasks) == 2000
    assert _settings(spark) == before and int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    store.view("kept")
    assert spark.sql("SELECT count(*) AS n FROM kept WHERE value = 'v1'").first().n == 2000


def test_batch_reads_give_each_run_a_task(spark, store):
    """Of several runs, of which the wanted keys may be in any."""
    keys = _many_runs(spark, store)
    tasks, found = _most_tasks(spark, lambda: store.get_frame(store.spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "pos long, key string")).collect())
    assert {(r.key, r.value) for r in found} == {(keys[0], "v1"), (keys[1], "v1"), (keys[2], None)}
    assert tasks >= len(store.get_manifest_info()) > 12


def test_prefix_reads_give_each_run_a_task(spark, store):
    """Of the runs whose key range may hold the prefix."""
    _many_runs(spark, store)
    tasks, found = _most_tasks(spark, lambda: store.get_prefix_range("k0").collect())
    assert [(r.key, r.value) for r in found] == [(f"k{i:05d}", "v1") for i in range(2000)]
    assert tasks >= len(store.get_manifest_info()) > 12


def _many_runs(spark, store):
    for turn in range(2):
        store.write_frame(spark.range(2000).select(F.format_string("k%05d", "id").alias("key"), F.lit(f"v{turn}").alias("value")))
    return ["k00003", "k01999", "none"]


def _most_tasks(spark, action):
    """The most tasks of a stage that the action runs, and what it returns."""
    known = set(_tasks(spark))
    found = action()
    return max(n for stage, n in _tasks(spark).items() if stage not in known), found


def _tasks(spark):
    status = spark.sparkContext._jsc.sc().statusStore()
    found = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {s.stageId(): s.numTasks() for s in map(found.apply, range(found.size()))}


@pytest.mark.parametrize("name", ["store_multi_get", "store_prefix"])
def test_no_task_of_a_query_sorts_more_of_a_larger_table(spark, monkeypatch, name):
    """Loading, compacting and reading at full: ten times the rows make more tasks that sort, of a run's rows each."""
    from palimpsest import queries

    run = 128 << 10
    monkeypatch.setattr(queries, "VersionedStore", lambda spark, root: VersionedStore(spark, root, file_bytes=run))
    sorted_rows = {}
    for sf in ("sf0.001", "sf0.01"):
        known = set(_tasks(spark))
        queries.QUERIES[name](spark, f"/root/testdata/{sf}").collect()
        sorted_rows[sf] = [n for stage in set(_tasks(spark)) - known for n in _rows_of_sorting_tasks(spark, stage)]
    assert len(sorted_rows["sf0.01"]) > 2 * len(sorted_rows["sf0.001"])
    assert 500 < max(sorted_rows["sf0.001"]) and max(sorted_rows["sf0.01"]) < 2 * run / (ENTRY_OVERHEAD + len("part:00000000") + 2)


def _rows_of_sorting_tasks(spark, stage):
    """The rows read by each task of a stage that took execution memory; one that only scans, filters and deals takes none."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().taskList(stage, 0, 1 << 20)
    done = [t.taskMetrics().get() for t in map(found.apply, range(found.size())) if t.taskMetrics().isDefined()]
    return [m.inputMetrics().recordsRead() + m.shuffleReadMetrics().recordsRead() for m in done if m.peakExecutionMemory()]


def _settings(spark):
    return {r.key: r.value for r in spark.sql("SET").collect()}
