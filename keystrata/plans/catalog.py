"""The query catalogue: one query for each operator, over the given tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions import codec, scalar
from keystrata.operators import compaction, manifest_fold, mutations, prune, resolve, runs
from keystrata.sources.shared import session_folder
from keystrata.sources.tables import as_log, conversation_log, document_log, order_log, primary_log, run_level, table
from keystrata.store import Config, Store
from keystrata.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Where the log was last flushed, in the queries that have a tail.
FLUSHED = 750
#: The level-1 size limit of the compaction queries; the production one is in functions.scalar.
PICK_LIMIT = 50_000
LEVEL0_THRESHOLD = 4
FLUSH_KEYS, FLUSH_BYTES = 5, 130
WRITERS = 16
#: A small filter, so that it has false answers, and a small file.
FILTER = (1024, 4)
ROLL_AT = 1 << 16


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def text(df: DataFrame) -> DataFrame:
    """Binary columns as text: no result has bytes."""
    return df.select(*[F.decode(F.col(c), "UTF-8").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.properties(primary_log(spark, d)).withColumn("level", run_level(F.col("run_id")))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.encode((F.col("s_suppkey") * 3).cast("string"), "UTF-8").alias("key"))


def _levels(spark: SparkSession, d: str, level: int) -> DataFrame:
    return _runs(spark, d).filter(F.col("level") == level)


@query
def q_live(spark, d):
    return text(resolve.live(primary_log(spark, d)))


@query
def q_point_get(spark, d):
    return text(resolve.get(primary_log(spark, d), bytearray(b"7")))


@query
def q_get_missing(spark, d):
    return text(resolve.get(primary_log(spark, d), bytearray(b"no such key")))


@query
def q_multi_get(spark, d):
    return text(resolve.multi_get(primary_log(spark, d), _asked(spark, d)))


@query
def q_put_overwrite(spark, d):
    log = primary_log(spark, d).filter(~F.col("tombstone"))
    out = log.groupBy("key").agg(F.count("*").alias("versions"), F.min_by("value", "seq").alias("first_value"), F.max_by("value", "seq").alias("last_value"))
    return text(out.filter("versions > 1"))


def _with_deletes(spark, d, step: int) -> DataFrame:
    log = primary_log(spark, d).select("key", "seq", "tombstone", "value")
    keys = table(spark, d, "supplier").select((F.col("s_suppkey") * step).cast("string").alias("k"), (F.col("s_suppkey") + 10**9).cast("bigint").alias("seq"))
    gone = mutations.deletes(keys, F.encode("k", "UTF-8")).select("key", "seq", "tombstone", "value")
    return log.unionByName(gone)


@query
def q_delete(spark, d):
    return text(resolve.live(_with_deletes(spark, d, 3)))


@query
def q_delete_missing(spark, d):
    return text(resolve.tombstones(_with_deletes(spark, d, 7000)))


@query
def q_tombstones(spark, d):
    return text(resolve.tombstones(primary_log(spark, d)))


@query
def q_scan_all(spark, d):
    return text(primary_log(spark, d).select("key", "seq", "tombstone", "value"))


@query
def q_scan_sorted(spark, d):
    """Every entry of every run with its place in the run's key order."""
    at = F.row_number().over(_by_run()) - 1
    return text(primary_log(spark, d).select("run_id", "key", "seq", at.cast("bigint").alias("ordinal")))


def _by_run():
    return Window.partitionBy("run_id").orderBy("key", "seq")


@query
def q_multi_run(spark, d):
    return text(resolve.latest(runs.resolved_runs(primary_log(spark, d))))


@query
def q_memtable_scan(spark, d):
    return text(resolve.latest(primary_log(spark, d).filter(F.col("seq") > FLUSHED)).orderBy("key"))


@query
def q_memtable_size(spark, d):
    return runs.memtable_size(primary_log(spark, d).filter(F.col("seq") > FLUSHED))


@query
def q_wal_replay(spark, d):
    log = primary_log(spark, d)
    return text(resolve.upsert(resolve.latest(log.filter(F.col("seq") <= FLUSHED)), log.filter(F.col("seq") > FLUSHED)))


@query
def q_max_seq(spark, d):
    log = primary_log(spark, d)
    return resolve.max_seq(log.filter(F.col("seq") <= FLUSHED), log.filter(F.col("seq") > FLUSHED))


@query
def q_flush_runs(spark, d):
    log = primary_log(spark, d).withColumn("writer", F.decode("key", "UTF-8").cast("bigint") % WRITERS)
    return runs.flush_ids(log, FLUSH_KEYS, "writer", FLUSH_BYTES)


@query
def q_run_props(spark, d):
    return text(runs.properties(primary_log(spark, d)))


@query
def q_level_files(spark, d):
    return _runs(spark, d).groupBy("level").agg(F.count("*").alias("files"))


@query
def q_level_size(spark, d):
    return _runs(spark, d).groupBy("level").agg(F.sum("data_size").alias("bytes"))


@query
def q_level_hull(spark, d):
    return text(_runs(spark, d).groupBy("level").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key")))


@query
def q_level_threshold(spark, d):
    sized = q_level_size(spark, d)
    return sized.select("level", "bytes", scalar.level_limit(F.col("level")).alias("level_limit"), scalar.file_target(F.col("level")).alias("file_target"))


@query
def q_fence_prune(spark, d):
    return prune.fence(text(_asked(spark, d)), text(_runs(spark, d)))


@query
def q_bloom_candidates(spark, d):
    """What the fences and each run's Bloom filter leave, false answers among it."""
    return prune.candidates(text(_asked(spark, d)), text(_runs(spark, d)), primary_log(spark, d), *FILTER)


def _blocks(spark, d) -> DataFrame:
    log = document_log(spark, d).withColumn("run_id", F.floor((F.col("seq") - 1) / 100).cast("bigint"))
    return runs.block_ids(log, scalar.record_size())


@query
def q_block_assign(spark, d):
    return text(_blocks(spark, d).select("run_id", "key", "block_id"))


def _restarts(spark, d) -> DataFrame:
    log = order_log(spark, d).withColumn("run_id", F.floor((F.col("seq") - 1) / 1000).cast("bigint"))
    return runs.restart_flags(runs.block_ids(log, F.octet_length("key")))


@query
def q_restart_points(spark, d):
    return text(_restarts(spark, d).select("run_id", "key", "block_id", "restart"))


@query
def q_restart_search(spark, d):
    """Keys that are there, and odd ones with a letter more, which are not."""
    n = F.col("s_suppkey") * 7
    key = F.concat(F.lpad(n.cast("string"), 12, "0"), F.when(F.col("s_suppkey") % 2 == 1, "x").otherwise(""))
    asked = table(spark, d, "supplier").select(F.encode(key, "UTF-8").alias("key"), F.floor(n / 1000).cast("bigint").alias("run_id"))
    blocks = _restarts(spark, d)
    return text(prune.restart_search(prune.seek(asked, prune.block_index(blocks)), blocks))


@query
def q_block_seek(spark, d):
    asked = table(spark, d, "supplier").select(F.encode(F.lpad((F.col("s_suppkey") * 7).cast("string"), 12, "0"), "UTF-8").alias("key"), F.floor(F.col("s_suppkey") * 7 / 100).cast("bigint").alias("run_id"))
    return text(prune.seek(asked, prune.block_index(_blocks(spark, d))))


@query
def q_file_roll(spark, d):
    log = document_log(spark, d).withColumn("writer", F.floor((F.col("seq") - 1) / 500).cast("bigint"))
    return text(runs.file_ids(log, scalar.record_size(), ROLL_AT, "writer").select("writer", "key", "file_id"))


@query
def q_composite_key(spark, d):
    log = conversation_log(spark, d)
    return text(log.select("key", scalar.entry_size().alias("bytes")))


@query
def q_overlap_join(spark, d):
    r = _runs(spark, d)
    return compaction.overlap_pairs(r, r).filter("run_id < other_id")


@query
def q_overlap_score(spark, d):
    return compaction.overlap_score(_levels(spark, d, 1), _levels(spark, d, 2)).orderBy("n_overlaps", "run_id")


@query
def q_range_sort(spark, d):
    return text(_runs(spark, d).select("run_id", "min_key", "max_key").orderBy("min_key", "max_key", "run_id"))


@query
def q_l0_inputs(spark, d):
    return compaction.level0_inputs(_runs(spark, d), LEVEL0_THRESHOLD)


@query
def q_ln_inputs(spark, d):
    return compaction.deeper_inputs(_runs(spark, d), 1, PICK_LIMIT)


@query
def q_excluded_runs(spark, d):
    return _runs(spark, d).select("run_id").join(q_ln_inputs(spark, d), "run_id", "left_anti")


@query
def q_greedy_pick(spark, d):
    return compaction.greedy_pick(compaction.overlap_score(_levels(spark, d, 1), _levels(spark, d, 2)), PICK_LIMIT)


@query
def q_compact_merge(spark, d):
    return text(compaction.merged(primary_log(spark, d).filter("level < 2").select("key", "seq", "tombstone", "value")))


@query
def q_obsolete_anti(spark, d):
    log = primary_log(spark, d).select("key", "seq", "tombstone", "value", "level")
    return text(compaction.merged(log.filter("level = 2").drop("level"), log.filter("level = 0").drop("level")))


def _manifest(spark, d) -> DataFrame:
    ids = primary_log(spark, d).select("run_id").distinct()
    adds = ids.select((F.col("run_id") + 1).alias("commit_id"), F.lit(0).alias("pos"), F.lit("add").alias("op"), "run_id")
    gone = ids.filter("run_id % 3 = 0").select((F.col("run_id") + 5).alias("commit_id"), F.lit(1).alias("pos"), F.lit("remove").alias("op"), "run_id")
    back = ids.filter("run_id % 6 = 0").select((F.col("run_id") + 9).alias("commit_id"), F.lit(2).alias("pos"), F.lit("add").alias("op"), "run_id")
    return adds.unionByName(gone).unionByName(back)


@query
def q_manifest_snapshot(spark, d):
    return manifest_fold.snapshot(_manifest(spark, d))


@query
def q_manifest_next_run(spark, d):
    return manifest_fold.next_run_id(_manifest(spark, d))


@query
def q_manifest_checkpoint(spark, d):
    return manifest_fold.snapshot(manifest_fold.checkpointed(_manifest(spark, d), 8)).select("run_id")


@query
def q_snapshot_diff(spark, d):
    opened = _runs(spark, d).filter("level < 2").select("run_id")
    return manifest_fold.difference(opened, manifest_fold.snapshot(_manifest(spark, d)))


@query
def q_seq_assign(spark, d):
    return mutations.sequenced(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), 100, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "seq")


@query
def q_version_rank(spark, d):
    return text(resolve.ranked(primary_log(spark, d)).select("key", "seq", "rank"))


@query
def q_version_history(spark, d):
    return text(resolve.history(primary_log(spark, d)).select("key", "seq", "prev_seq", "next_seq"))


@query
def q_as_of(spark, d):
    return text(resolve.as_of(primary_log(spark, d), FLUSHED))


@query
def q_key_scan(spark, d):
    return text(resolve.key_scan(primary_log(spark, d), bytearray(b"1"), bytearray(b"3")))


@query
def q_key_order(spark, d):
    """Signed numbers as keys: their unsigned byte order is the order of the numbers."""
    keys = table(spark, d, "orders").select((F.col("o_orderkey") - 100).alias("n")).select("n", codec.ordered_long_key("n").alias("key"))
    return mutations.sequenced(keys, 0, ["key"]).select("n", F.hex("key").alias("key_hex"), F.col("seq").alias("rank"))


@query
def q_checksum(spark, d):
    """Every seventh record is damaged after its checksum was stored, and is dropped."""
    log = primary_log(spark, d).withColumn("crc", scalar.checksum())
    value = F.when(F.col("seq") % 7 == 0, F.concat(F.coalesce("value", F.lit(b"")), F.lit(b"?"))).otherwise(F.col("value"))
    return text(log.withColumn("value", value).filter(scalar.intact("crc")).select("key", "seq"))


def _store(spark, **config) -> Config:
    """A new store in the shared folder; the log of single writes is the driver's own."""
    return Config(session_folder(spark), wal_dir=tempfile.mkdtemp(), **config)


@query
def q_store_live(spark, d):
    """The primary log in four batches, compacted after each second one."""
    log = primary_log(spark, d).select("key", "seq", "tombstone", "value")
    with Store(spark, _store(spark, level0_threshold=2)) as s:
        for k in range(4):
            s.commit_entries(log.filter(F.col("seq") % 4 == k))
            s.compact()
        return text(s.live())


@query
def q_store_recovery(spark, d):
    """Single writes before and after a batch, found again after the store was reopened."""
    batch = table(spark, d, "supplier").select(codec.text_key("s_suppkey").alias("key"), F.lit(False).alias("tombstone"), F.encode("s_name", "UTF-8").alias("value"))
    config = _store(spark)
    with Store(spark, config) as s:
        s.put(b"first", b"1")
        s.put(b"5", b"older than the batch")
        s.write(batch)
        s.put(b"2", b"new")
        s.delete(b"3")
    with Store(spark, config) as s:
        return text(s.live().select("key", "value"))


@query
def q_stream_live(spark, d):
    """The primary log as a stream into a store."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    with Store(spark, _store(spark)) as s:
        ingest(as_log(events).select("key", "seq", "tombstone", "value"), s, "events", session_folder(spark), ["seq"], compact_every=4).awaitTermination()
        return text(s.live())
