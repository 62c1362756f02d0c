"""Fences and filters at their limits, and what passes through a fold."""

from __future__ import annotations

import hashlib
import random

import pytest
from compare import connect, same
from pyspark.sql import functions as F

from keystrata.functions import scalar
from keystrata.operators import prune, runs
from keystrata.plans.catalog import FILTER, QUERIES
from keystrata.plans.oracles import ORACLES


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def places(key: bytes, bits: int, hashes: int) -> set[int]:
    h = hashlib.md5(key).hexdigest()
    return {(int(h[:8], 16) + int(h[8:16], 16) * i) % bits for i in range(hashes)}


@pytest.mark.parametrize("kind", ["binary", "string"])
@pytest.mark.parametrize("bits,hashes", [FILTER, (100, 3), (64, 1)])
def test_candidates_are_what_fences_and_filters_leave(spark, kind, bits, hashes):
    r = random.Random(6)
    held = {run: [b"%d" % r.randrange(3000) for _ in range(r.randrange(1, 60))] for run in range(30)}
    probes = [b"%d" % r.randrange(3000) for _ in range(200)]
    filters = {run: set().union(*(places(k, bits, hashes) for k in keys)) for run, keys in held.items()}
    want = sorted((k.decode(), run) for k in set(probes) for run, keys in held.items() if min(keys) <= k <= max(keys) and places(k, bits, hashes) <= filters[run])
    rows = [(bytearray(k), run) for run, keys in held.items() for k in keys]
    log = spark.createDataFrame([*rows, (None, 0), (None, 77)], "key binary, run_id bigint").withColumn("key", F.col("key").cast(kind))
    ranges = log.groupBy("run_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    asked = spark.createDataFrame([(bytearray(k),) for k in [*probes, *probes]], "key binary").withColumn("key", F.col("key").cast(kind))
    for limits in ({}, {"broadcast_runs": 5}, {"broadcast_filters": 8}):
        got = prune.candidates(asked, ranges, log, bits, hashes, **limits)
        assert sorted((bytes(x.key).decode() if kind == "binary" else x.key, x.run_id) for x in got.collect()) == want


def test_pairs_of_the_fences_are_judged_where_they_arise(spark):
    """No pair is spread into the bits of its key, nor moved."""
    said = plan(QUERIES["q_bloom_candidates"](spark, "/root/testdata/sf0.01"))
    above = said[: said.index("Join Inner")]
    assert "Generate" not in above and "Aggregate" not in above


def grown(tmp_path, times: int, **tables: str) -> str:
    """Tables of sf0.001 repeated with shifted keys; tables: columns and their shifts."""
    con = connect("/root/testdata/sf0.001")
    for name, shifted in tables.items():
        con.execute(f"COPY (SELECT * REPLACE ({shifted}) FROM {name}, range({times}) t(k)) TO '{tmp_path}/{name}.parquet'".replace("SELECT *", "SELECT * EXCLUDE (k)"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["q_bloom_candidates", "q_fence_prune"])
def test_pairs_of_repeated_tables_are_those_of_sql(spark, tmp_path, name):
    """Suppliers twice: a key is asked once."""
    d = grown(tmp_path, 4, events="event_id + 1000 * k AS event_id, user_id + 10 * k AS user_id", supplier="s_suppkey + 10 * (k // 2) AS s_suppkey")
    con = connect("/root/testdata/sf0.001")
    for t in ("events", "supplier"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    same(QUERIES[name](spark, d), con, ORACLES[name])


def test_fences_are_compared_in_many_tasks(spark):
    """However small the file of the asked keys is."""
    assert QUERIES["q_fence_prune"](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_fences_of_text(spark):
    r = random.Random(7)
    key = lambda: "".join(r.choice("a\x00z\u00e9\u4e2d\U0001f600") for _ in range(r.randrange(4)))
    ranges = [sorted((key(), key()), key=str.encode) for _ in range(40)]
    probes = [key() for _ in range(60)]
    of = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "run_id bigint, min_key string, max_key string")
    want = sorted((k, i) for k in set(probes) for i, (a, b) in enumerate(ranges) if a.encode() <= k.encode() <= b.encode())
    for most in (1000, 3):
        assert sorted((x.key, x.run_id) for x in prune.fence(spark.createDataFrame([(k,) for k in probes], "key string"), of, most).collect()) == want


def test_values_stay_out_of_the_fold(spark):
    """Blocks and files roll by sizes, and batches of large values would fill a worker's memory."""
    rows = [(w, bytearray(b"%03d" % i), i, bytearray(i % 7 * 10)) for w in (1, 2) for i in range(50)]
    d = spark.createDataFrame(rows, "run_id bigint, key binary, seq bigint, value binary").withColumn("tombstone", F.lit(False))
    size = scalar.record_size()
    for out in (runs.block_ids(d, size, 100), runs.file_ids(d, size, 500, "run_id")):
        fed = next(line for line in plan(out).splitlines() if "MapInPandas" in line)
        assert "value" not in fed and "tombstone" not in fed and out.count() == 100
    for name in ("q_block_assign", "q_block_seek", "q_file_roll", "q_restart_points", "q_restart_search"):
        fed = [line for line in plan(QUERIES[name](spark, "/root/testdata/sf0.01")).splitlines() if "MapInPandas" in line]
        assert fed and not any("value" in line for line in fed)
