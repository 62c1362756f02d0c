"""The store: single and batch writes, lookups, flush, compaction, recovery.

Data live in Parquet runs listed by the manifest; runs are never changed in place. Single
writes are buffered on the driver up to `memtable_entries` or `memtable_bytes` (both bounds
that the configuration sets) and logged before they count; batches of any size go straight
to a run, after the buffer, so that the sequence that a commit says it reached covers all
that was acknowledged before. One writer at a time holds the lock, which is a file lock of
the log's machine; of two drivers elsewhere the second one to commit gets an error, as a
commit's name can be taken only once.
"""

from __future__ import annotations

import fcntl
import threading
import uuid
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from keystrata.functions.scalar import entry_size, level_limit_of
from keystrata.operators import compaction, resolve
from keystrata.operators.mutations import sequenced
from keystrata.operators.runs import write_run_files
from keystrata.schema import ENTRY_SCHEMA, RUN_SCHEMA, conform
from keystrata.sources.manifest_files import Files, Manifest
from keystrata.sources.wal import Wal


@dataclass(frozen=True)
class Config:
    """path: the store's folder, made if it is not there. wal_dir: a local folder for the
    log of single writes (default: in the store, which then has to be on a local disk)."""

    path: str
    memtable_entries: int = 10_000
    memtable_bytes: int = 1 << 20
    level0_threshold: int = 4
    wal_dir: str | None = None

    def __post_init__(self) -> None:
        if min(self.memtable_entries, self.memtable_bytes, self.level0_threshold) < 1:
            raise ValueError("limits have to be 1 or more")


def _size(entry: tuple[bytes, tuple[int, bool, bytes | None]]) -> int:
    key, (_, _, value) = entry
    return len(key) + len(value or b"")


class StoreLocked(RuntimeError):
    """Another store object holds the folder."""


class Store:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self._mutex = threading.RLock()
        self.files = Files(spark, config.path)
        self.files.mkdirs("")
        local = Path(config.wal_dir or config.path.removeprefix("file://"))
        local.mkdir(parents=True, exist_ok=True)
        self._lock = (local / "LOCK").open("w")
        try:
            fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self._lock.close()
            raise StoreLocked(config.path) from e
        try:
            self.manifest = Manifest(self.files)
            self.wal = Wal(str(local / "wal"))
        except BaseException:
            self._lock.close()
            raise
        # what a run already holds was flushed before the log could be cut
        self.buffer: dict[bytes, tuple[int, bool, bytes | None]] = {}
        for key, seq, dead, value in self.wal.entries:
            if seq > self.manifest.max_seq:
                self.buffer[key] = (seq, dead, value)
        self.seq = max([self.manifest.max_seq, *[s for s, _, _ in self.buffer.values()]])
        self.buffered = sum(map(_size, self.buffer.items()))
        self._kept: DataFrame | None = None
        self.open = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _guard(self) -> None:
        if not self.open:
            raise RuntimeError("the store is closed")

    # writes

    def put(self, key: bytes, value: bytes) -> None:
        if key is None or value is None:
            raise ValueError("key and value may be empty but not None")
        self._write(bytes(key), False, bytes(value))

    def delete(self, key: bytes) -> None:
        """Also of a key that was never there: that writes a tombstone too."""
        if key is None:
            raise ValueError("key may be empty but not None")
        self._write(bytes(key), True, None)

    def _write(self, key: bytes, dead: bool, value: bytes | None) -> None:
        with self._mutex:
            self._guard()
            self.wal.append(key, self.seq + 1, dead, value)
            self.seq += 1
            if key in self.buffer:
                self.buffered -= _size((key, self.buffer[key]))
            self.buffer[key] = (self.seq, dead, value)
            self.buffered += _size((key, self.buffer[key]))
            if len(self.buffer) >= self.config.memtable_entries or self.buffered >= self.config.memtable_bytes:
                self.flush()

    def write(self, batch: DataFrame, order: list[str] | None = None) -> int:
        """One batch of mutations (key, tombstone, value), at once or not at all.

        order: the columns that say which of two mutations of a key is newer; without it,
        a key may occur once. Returns the sequence reached.
        """
        with self._mutex:
            self._guard()
            self.flush()
            rows = sequenced(batch, self.seq, order or ["key"]).select(*ENTRY_SCHEMA.fieldNames())
            return self.commit_entries(rows)

    def commit_entries(self, entries: DataFrame, stream: str | None = None, batch_id: int | None = None) -> int:
        """Entries with their sequences become level-0 runs in one commit, after the buffer."""
        with self._mutex:
            self._guard()
            self.flush()
            return self._commit(conform(entries), stream, batch_id)

    def _commit(self, entries: DataFrame, stream: str | None = None, batch_id: int | None = None) -> int:
        """The entries as they come, before they are resolved, bound the size of the runs."""
        n, size = entries.agg(F.count("*"), F.coalesce(F.sum(entry_size()), F.lit(0))).first()
        add = self._write_runs(resolve.latest(entries), 0, n, size)
        reached = max([self.seq, *[r["max_seq"] for r in add]])
        self._changed(add, [], reached, stream, batch_id)
        self.seq = reached
        return self.seq

    def _changed(self, *commit: Any) -> None:
        self.manifest.commit(*commit)
        self.uncache()

    def _write_runs(self, entries: DataFrame, level: int, rows: int, size: int) -> list[dict[str, Any]]:
        """One pass over the entries. rows and size may be upper bounds."""
        if not rows:
            return []
        rel = f"runs/{level}-{uuid.uuid4().hex}"
        props = write_run_files(entries.select(*ENTRY_SCHEMA.fieldNames()), self.files.path(rel).toString(), size, level, rows).orderBy("min_key").collect()
        return [
            {"run_id": self.manifest.next_run + i, "level": level, "entries": p.entries, "data_size": p.data_size, "min_key": p.min_key.hex(), "max_key": p.max_key.hex(), "max_seq": p.max_seq, "path": p.path}
            for i, p in enumerate(props)
        ]

    def flush(self) -> None:
        with self._mutex:
            self._guard()
            if not self.buffer:
                return
            self._commit(self._tail())
            self.buffer.clear()
            self.buffered = 0
            self.wal.reset()

    # reads

    def _tail(self) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(k), s, d, None if v is None else bytearray(v)) for k, (s, d, v) in self.buffer.items()], ENTRY_SCHEMA)

    def _files(self, runs: list[dict[str, Any]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(*[r["path"] for r in runs])

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Every entry that runs and buffer hold, of runs that can meet [low, high]."""
        with self._mutex:
            self._guard()
            runs = [r for r in self.manifest.runs.values() if (high is None or bytes.fromhex(r["min_key"]) <= high) and (low is None or bytes.fromhex(r["max_key"]) >= low)]
            data = self._files(runs) if self._kept is None else self._kept
            return data.unionByName(self._tail()) if self.buffer else data

    def live(self) -> DataFrame:
        return resolve.live(self.log())

    def cache(self) -> DataFrame:
        """Keep the runs' latest versions in the executors' memory (and on their disks) for
        live(), get and multi_get until the next commit or uncache()."""
        with self._mutex:
            self._guard()
            if self._kept is None:
                self._kept = resolve.latest(self._files(list(self.manifest.runs.values()))).persist(StorageLevel.MEMORY_AND_DISK)
            return self._kept

    def uncache(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def get(self, key: bytes) -> bytes | None:
        with self._mutex:
            self._guard()
            if key in self.buffer:
                return self.buffer[key][2]
            row = resolve.live(self.log(key, key).filter(F.col("key") == F.lit(bytearray(key)))).first()
            return None if row is None else bytes(row.value)

    def multi_get(self, keys: DataFrame, broadcast_rows: int | None = None) -> DataFrame:
        return resolve.multi_get(self.log(), keys, broadcast_rows)

    def runs(self) -> DataFrame:
        with self._mutex:
            rows = [(r["run_id"], r["level"], r["entries"], r["data_size"], bytearray.fromhex(r["min_key"]), bytearray.fromhex(r["max_key"]), r["max_seq"], r["path"]) for r in self.manifest.runs.values()]
            return self.spark.createDataFrame(rows, RUN_SCHEMA)

    def level_files(self, level: int) -> int:
        return sum(r["level"] == level for r in self.manifest.runs.values())

    # compaction

    def compact(self, purge_tombstones: bool = False) -> int:
        """Compact level 0 when it is full, then every level over its limit, top down.
        Returns how many merges were done."""
        with self._mutex:
            self._guard()
            self.flush()
            done = 0
            if self.level_files(0) >= self.config.level0_threshold:
                self._merge({r.run_id for r in compaction.level0_inputs(self.runs(), self.config.level0_threshold).collect()}, 1, purge_tombstones)
                done += 1
            level = 1
            while any(r["level"] >= level for r in self.manifest.runs.values()):
                if sum(r["data_size"] for r in self.manifest.runs.values() if r["level"] == level) >= level_limit_of(level):
                    self._merge({r.run_id for r in compaction.deeper_inputs(self.runs(), level, level_limit_of(level)).collect()}, level + 1, purge_tombstones)
                    done += 1
                level += 1
            return done

    def _merge(self, ids: set[int], target: int, purge: bool) -> None:
        inputs = [r for r in self.manifest.runs.values() if r["run_id"] in ids]
        low, high = min(bytes.fromhex(r["min_key"]) for r in inputs), max(bytes.fromhex(r["max_key"]) for r in inputs)
        rest = [r for r in self.manifest.runs.values() if r["run_id"] not in ids and bytes.fromhex(r["min_key"]) <= high and bytes.fromhex(r["max_key"]) >= low]
        bottom = not rest
        out = compaction.merged(self._files(inputs), self._files(rest) if rest else None, purge and bottom)
        self._changed(self._write_runs(out, target, sum(r["entries"] for r in inputs), sum(r["data_size"] for r in inputs)), sorted(ids), self.seq)

    def vacuum(self) -> int:
        """Delete run folders that no committed run lies in. Call it when no reader of an
        older snapshot is left."""
        with self._mutex:
            self._guard()
            kept = {r["path"].rstrip("/").split("/")[-2] for r in self.manifest.runs.values()}
            gone = [n for n in self.files.names("runs") if n not in kept]
            for n in gone:
                self.files.delete(f"runs/{n}")
            return len(gone)

    def close(self) -> None:
        with self._mutex:
            if self.open:
                self.uncache()
                self.open = False
                self.wal.close()
                self._lock.close()
