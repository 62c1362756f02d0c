"""Structured Streaming into a store, and a streaming latest-value view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.operators.mutations import sequenced
from keystrata.schema import ENTRY_SCHEMA
from keystrata.store import Store


def store_sink(store: Store, stream: str, order: list[str], compact_every: int = 0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: one batch is one commit that names the batch, so a batch that
    Spark repeats after a crash is seen to be there and left out.

    order: which of two mutations in a batch is newer. A `seq` column is used as it is.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        if store.manifest.batches.get(stream, -1) >= batch_id:
            return
        rows = batch if "seq" in batch.columns else sequenced(batch, store.seq, order)
        store.commit_entries(rows.select(*ENTRY_SCHEMA.fieldNames()), stream, batch_id)
        if compact_every and batch_id % compact_every == compact_every - 1:
            store.compact()

    return sink


def ingest(source: DataFrame, store: Store, stream: str, checkpoint: str, order: list[str], compact_every: int = 0, **trigger: object) -> StreamingQuery:
    """compact_every: compact after every so many batches; 0 for never."""
    return source.writeStream.foreachBatch(store_sink(store, stream, order, compact_every)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_stream(source: DataFrame) -> DataFrame:
    """The newest mutation of each key as a streaming aggregate (update or complete mode);
    a late mutation with a lower sequence changes nothing."""
    newest = F.max_by(F.struct("tombstone", "value"), F.col("seq"))
    return source.groupBy("key").agg(F.max("seq").alias("seq"), newest.alias("v")).select("key", "seq", "v.tombstone", "v.value")
