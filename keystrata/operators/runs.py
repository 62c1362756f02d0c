"""Sorted runs: their layout, their properties and the writer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.scalar import FILE_OVERHEAD, entry_size, file_target_of
from keystrata.operators.resolve import latest

BLOCK_BYTES = 4096
RESTART_EVERY = 16


def properties(log: DataFrame, by: str = "run_id") -> DataFrame:
    """Entries, bytes, key range and highest sequence of each run."""
    return log.groupBy(by).agg(
        F.count("*").alias("entries"), F.sum(entry_size()).alias("data_size"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq")
    )


def resolved_runs(log: DataFrame) -> DataFrame:
    """What a flush keeps of each run: the latest version of a key within it."""
    newest = F.max_by(F.struct("tombstone", "value"), F.col("seq"))
    return log.groupBy("run_id", "key").agg(F.max("seq").alias("seq"), newest.alias("v")).select("run_id", "key", "seq", "v.tombstone", "v.value")


def memtable_size(tail: DataFrame) -> DataFrame:
    """Entries and bytes of a log tail with one version for each key."""
    return latest(tail).agg(F.count("*").alias("entries"), F.coalesce(F.sum(entry_size()), F.lit(0)).cast("bigint").alias("bytes"))


def _folded(rows: DataFrame, by: str, order: list[str], sizes: list[str], step: Callable[[], Callable[..., int]], name: str) -> DataFrame:
    """rows (by, order, sizes) with `name`, a number that a fold in order gives within each
    value of `by`. A task streams its rows; step() makes the fold of one value. Other columns
    stay out, as a batch of large values would fill the worker's memory."""
    rows = rows.select(*dict.fromkeys([by, *order, *sizes]))

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number = object(), None
        for pdf in parts:
            out = []
            for s, *x in zip(pdf[by], *[pdf[c] for c in sizes], strict=True):
                if s != at:
                    at, number = s, step()
                out.append(number(*x))
            yield pdf.assign(**{name: out})

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", {name} bigint"
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInPandas(fold, schema)


def flush_ids(log: DataFrame, limit: int, shard: str, limit_bytes: int | None = None) -> DataFrame:
    """The flush that takes each mutation when a buffer is flushed at `limit` distinct keys
    or at `limit_bytes` of keys and values.

    An overwrite does not fill the buffer by another key, and its old value no longer
    counts, so this is a fold in sequence order and no window function. `shard` names the
    column of independent writers: each folds its own rows, streamed in order, with the keys
    of one buffer (at most `limit`) as the state.
    """

    def buffer() -> Callable[[bytes, int], int]:
        flush, held, seen = 0, 0, {}

        def put(key: bytes, size: int) -> int:
            nonlocal flush, held
            mine = flush
            held += size - seen.get(bytes(key), 0)
            seen[bytes(key)] = size
            if len(seen) >= limit or (limit_bytes is not None and held >= limit_bytes):
                flush, held = flush + 1, 0
                seen.clear()
            return mine

        return put

    size = F.lit(0) if limit_bytes is None else entry_size()
    return _folded(log.withColumn("_size", size), shard, ["seq"], ["key", "_size"], buffer, "flush_id").select(shard, "seq", "flush_id")


def _rolled(full: Callable[[int, int], bool]) -> Callable[[], Callable[[int], int]]:
    """A fold that counts up before a record for which full(written, size) holds."""

    def start() -> Callable[[int], int]:
        number, written = 0, 0

        def add(size: int) -> int:
            nonlocal number, written
            if written and full(written, size):
                number, written = number + 1, 0
            written += size
            return number

        return add

    return start


def block_ids(run: DataFrame, size: Column, block_bytes: int = BLOCK_BYTES, by: str = "run_id") -> DataFrame:
    """(by, key, seq, block_id) of a run's records: a block ends before the record that would
    not fit, and a record larger than a block has one of its own. A fold over each run in key
    order."""
    return _folded(run.withColumn("_size", size), by, ["key", "seq"], ["_size"], _rolled(lambda written, size: written + size > block_bytes), "block_id").drop("_size")


def file_ids(entries: DataFrame, size: Column, target: int, by: str) -> DataFrame:
    """(by, key, seq, file_id) of entries: a writer's file ends before the record with which it
    would pass the target size, what was written counting 1.2 times. `by` names the column of
    independent writers, each with a key range of its own."""
    return _folded(entries.withColumn("_size", size), by, ["key", "seq"], ["_size"], _rolled(lambda written, size: int(written * FILE_OVERHEAD) + size > target), "file_id").drop("_size")


def restart_flags(blocks: DataFrame, every: int = RESTART_EVERY, by: str = "run_id") -> DataFrame:
    """Mark every `every`-th entry of a block, its first included."""
    nth = F.row_number().over(Window.partitionBy(by, "block_id").orderBy("key", "seq")) - 1
    return blocks.withColumn("restart", nth % every == 0)


def write_run_files(entries: DataFrame, path: str, total_bytes: int, level: int, rows: int) -> DataFrame:
    """Write entries as key-ordered Parquet files with key statistics and Bloom filters and
    return the properties of each file. Files cover disjoint key ranges. total_bytes and rows
    may be upper bounds. Each entry's size is a column, so that the properties are read
    without the values."""
    n = max(1, -(-int(total_bytes * FILE_OVERHEAD) // file_target_of(level)))
    (
        entries.withColumn("size", entry_size())
        .repartitionByRange(n, "key")
        .sortWithinPartitions("key", "seq")
        .write.option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.expected.ndv#key", str(max(1, rows // n)))
        .option("parquet.bloom.filter.fpp#key", "0.01")
        .mode("overwrite")
        .parquet(path)
    )
    written = entries.sparkSession.read.parquet(path).withColumn("path", F.col("_metadata.file_path"))
    return written.groupBy("path").agg(F.count("*").alias("entries"), F.sum("size").alias("data_size"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.max("seq").alias("max_seq"))
