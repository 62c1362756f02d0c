"""The store against a dictionary, over flushes, compactions and reopenings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keystrata.operators import prune, resolve, runs
from keystrata.operators.mutations import sequenced
from keystrata.schema import ENTRY_SCHEMA, violations
from keystrata.store import Config, Store, StoreLocked
from keystrata.streaming.ingest import ingest, latest_stream


def contents(store: Store) -> dict[bytes, bytes]:
    return {bytes(r.key): bytes(r.value) for r in store.live().collect()}


def test_single_writes(spark, tmp_path):
    with Store(spark, Config(str(tmp_path / "s"), memtable_entries=4)) as s:
        for k, v in ((b"", b"empty key"), (b"a\x00b", b"\x00\x01"), (b"e", b""), (b"k", b"1"), (b"k", b"2")):
            s.put(k, v)
        s.delete(b"never there")
        assert s.get(b"") == b"empty key" and s.get(b"a\x00b") == b"\x00\x01" and s.get(b"e") == b"" and s.get(b"k") == b"2"
        assert s.get(b"never there") is None and s.get(b"absent") is None
        s.delete(b"k")
        assert s.get(b"k") is None
        s.put(b"k", b"3")
        assert s.get(b"k") == b"3"
        with pytest.raises(ValueError):
            s.put(b"k", None)
    with pytest.raises(RuntimeError):
        s.get(b"k")


@pytest.mark.parametrize("seed", [1, 2])
def test_model(spark, tmp_path, seed):
    r, model, path = random.Random(seed), {}, str(tmp_path / "s")
    for session in range(3):
        with Store(spark, Config(path, memtable_entries=15, level0_threshold=3)) as s:
            assert contents(s) == model
            for _ in range(40):
                k = b"key%d" % r.randrange(25)
                if r.random() < 0.3:
                    s.delete(k)
                    model.pop(k, None)
                else:
                    model[k] = v = b"v%d" % r.randrange(10**6)
                    s.put(k, v)
            if session == 1:
                assert s.compact() and s.level_files(0) == 0
                s.vacuum()
            assert contents(s) == model
            assert violations(s.log()).count() == 0


def test_sequence_goes_on_after_a_flush_and_restart(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store(spark, Config(path)) as s:
        s.put(b"k", b"old")
        s.put(b"k", b"older than the next")
        s.flush()
    with Store(spark, Config(path)) as s:
        assert s.seq == 2
        s.put(b"k", b"new")
        s.flush()
        assert s.get(b"k") == b"new"


def test_lock_and_torn_log(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store(spark, Config(path)) as s:
        with pytest.raises(StoreLocked):
            Store(spark, Config(path))
        s.put(b"a", b"1")
        s.put(b"b", b"2")
    wal = tmp_path / "s" / "wal"
    wal.write_bytes(wal.read_bytes()[:-3])
    with Store(spark, Config(path)) as s:
        assert s.get(b"a") == b"1" and s.get(b"b") is None and s.seq == 1


def test_one_run_for_each_write(spark, tmp_path):
    with Store(spark, Config(str(tmp_path / "s"), memtable_entries=1, level0_threshold=4000)) as s:
        for i in range(5):
            s.put(b"u%d" % (i % 3), b"x")
        assert s.level_files(0) == 5


def test_batches_and_purge(spark, tmp_path):
    with Store(spark, Config(str(tmp_path / "s"), level0_threshold=2)) as s:
        rows = spark.range(200).select(F.encode((F.col("id") % 50).cast("string"), "UTF-8").alias("key"), (F.col("id") >= 190).alias("tombstone"), F.when(F.col("id") < 190, F.encode(F.col("id").cast("string"), "UTF-8")).alias("value"), "id")
        s.write(rows, ["id"])
        assert len(contents(s)) == 40 and contents(s)[b"0"] == b"150"
        s.write(rows.filter("id < 10"), ["id"])
        assert contents(s)[b"3"] == b"3"
        before = contents(s)
        s.compact(purge_tombstones=True)
        assert contents(s) == before and s.log().filter("tombstone").count() == 0
        asked = spark.createDataFrame([(bytearray(b"3"),), (bytearray(b"none"),)], "key binary")
        assert {bytes(r.key): r.found for r in s.multi_get(asked, 2).collect()} == {b"3": True, b"none": False}


@pytest.mark.parametrize("most", [None, 25, 1000])
def test_flush_boundaries(spark, most):
    r = random.Random(4)
    rows = [(w, i, bytearray(b"%d" % r.randrange(12)), bytearray(r.randrange(12))) for i in range(200) for w in ("a", "b")]
    got = {(x.w, x.seq): x.flush_id for x in runs.flush_ids(spark.createDataFrame(rows, "w string, seq bigint, key binary, value binary"), 5, "w", most).collect()}
    for w in "ab":
        flush, seen = 0, {}
        for _, i, k, v in sorted(x for x in rows if x[0] == w):
            seen[bytes(k)] = len(k) + len(v)
            assert got[w, i] == flush
            if len(seen) == 5 or (most and sum(seen.values()) >= most):
                flush, seen = flush + 1, {}


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(bytearray(b"k%d" % (i % 7)), i + 1, i % 5 == 0, None if i % 5 == 0 else bytearray(b"%d" % i)) for i in range(60)]
    log = spark.createDataFrame(rows, ENTRY_SCHEMA)
    log.repartition(3).write.parquet(source)
    want = {bytes(r.key): bytes(r.value) for r in resolve.live(log).collect()}
    stream = spark.readStream.schema(ENTRY_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    with Store(spark, Config(str(tmp_path / "s"))) as s:
        for _ in range(2):  # started again: nothing is taken twice
            ingest(stream, s, "events", str(tmp_path / "ckpt"), ["seq"]).awaitTermination(120)
            assert contents(s) == want and s.seq == 60
        done = s.manifest.batches["events"]
        from keystrata.streaming.ingest import store_sink

        store_sink(s, "events", ["seq"])(log, done)
        assert s.seq == 60 and contents(s) == want
    q = latest_stream(stream).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {bytes(r.key): bytes(r.value) for r in spark.table("newest").filter("NOT tombstone").collect()}
    assert got == want


def test_nothing_is_lost_between_single_writes_and_batches(spark, tmp_path):
    log = spark.createDataFrame([(bytearray(b"s"), 10, False, bytearray(b"streamed"))], ENTRY_SCHEMA)
    path = str(tmp_path / "s")
    with Store(spark, Config(path)) as s:
        s.put(b"a", b"1")
        s.commit_entries(log, "stream", 0)
        s.put(b"b", b"2")
        s.delete(b"a2")
    with Store(spark, Config(path)) as s:
        assert contents(s) == {b"a": b"1", b"s": b"streamed", b"b": b"2"} and s.get(b"a") == b"1" and s.seq == 12
        with pytest.raises(ValueError):
            s.commit_entries(log.drop("value"))


def test_sequences_of_a_large_batch_have_no_gaps(spark, tmp_path):
    """Enough rows, with a payload, for two samples of the same rows to differ."""
    n = 2_000_000
    rows = spark.range(n).select((F.xxhash64("id") % 1000).alias("ts"), "id", F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = sequenced(rows, 100, ["ts", "id"], blocks=16)
    got = out.agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()
    assert tuple(got) == (n, n, 101, 100 + n)
    at = out.select("seq", F.lead("seq").over(Window.partitionBy("ts").orderBy("id")).alias("following")).filter("following <> seq + 1")
    assert at.count() == 0
    batch = rows.limit(1_500_000).select(F.encode("payload", "UTF-8").alias("key"), F.lit(False).alias("tombstone"), F.encode(F.repeat("payload", 2), "UTF-8").alias("value"), "ts", "id")
    with Store(spark, Config(str(tmp_path / "s"))) as s:
        assert s.write(batch, ["ts", "id"]) == 1_500_000
        assert tuple(s.log().agg(F.count_distinct("seq"), F.max("seq")).first()) == (1_500_000, 1_500_000)


def test_a_cached_store_says_the_same(spark, tmp_path):
    with Store(spark, Config(str(tmp_path / "s"), level0_threshold=2)) as s:
        s.put(b"a", b"1")
        s.flush()
        s.cache()
        s.put(b"b", b"2")
        s.delete(b"a")
        assert contents(s) == {b"b": b"2"} and s.get(b"a") is None
        s.flush()
        assert s._kept is None and contents(s) == {b"b": b"2"}


def test_fences_without_a_broadcast(spark):
    r = random.Random(3)
    key = lambda: bytearray(r.randrange(256) for _ in range(r.randrange(4)))
    ranges = [sorted((key(), key())) for _ in range(40)]
    probes = {bytes(key()) for _ in range(60)}
    of = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "run_id bigint, min_key binary, max_key binary")
    asked = spark.createDataFrame([(bytearray(k),) for k in probes], "key binary")
    want = {(k, i) for k in probes for i, (a, b) in enumerate(ranges) if a <= k <= b}
    for most in (1000, 3):
        assert {(bytes(x.key), x.run_id) for x in prune.fence(asked, of, most).collect()} == want
    filters = prune.bloom_filters(asked.withColumn("run_id", F.lit(1)))
    assert filters.agg(F.max(F.octet_length("bitmap"))).first()[0] == 4096
    both = asked.withColumn("run_id", F.lit(1)).unionByName(spark.createDataFrame([(bytearray(b"not there"), 1), (bytearray(b"a"), 2)], "key binary, run_id int"))
    assert {bytes(x.key) for x in prune.might_contain(both, filters).collect()} == probes


def test_blocks_and_files_roll_by_the_next_record(spark):
    r = random.Random(5)
    rows = [(w, bytearray(b"%04d" % i), i, r.choice([5, 40, 90, 300])) for w in (1, 2) for i in range(300)]
    d = spark.createDataFrame(rows, "run_id bigint, key binary, seq bigint, size int").repartition(3)
    blocks = {(x.run_id, x.seq): x.block_id for x in runs.block_ids(d, F.col("size"), 100).collect()}
    files = {(x.run_id, x.seq): x.file_id for x in runs.file_ids(d, F.col("size"), 1000, "run_id").collect()}
    for w in (1, 2):
        block = file = in_block = in_file = 0
        for v, _, i, size in rows:
            if v != w:
                continue
            if in_block and in_block + size > 100:
                block, in_block = block + 1, 0
            if in_file and int(in_file * 1.2) + size > 1000:
                file, in_file = file + 1, 0
            in_block, in_file = in_block + size, in_file + size
            assert (blocks[w, i], files[w, i]) == (block, file)
