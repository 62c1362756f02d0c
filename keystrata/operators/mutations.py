"""Puts, deletes and sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.operators.running import running_total


def puts(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """A null key or value is an error when the rows are computed, never a silent delete."""
    said = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"put: null {what}")).cast("binary"))
    return df.select("*", said(key, "key").alias("key"), F.lit(False).alias("tombstone"), said(value, "value").alias("value"))


def deletes(df: DataFrame, key: Column) -> DataFrame:
    """Tombstones, also for keys that were never there."""
    return df.select("*", F.coalesce(key, F.raise_error(F.lit("delete: null key")).cast("binary")).alias("key"), F.lit(True).alias("tombstone"), F.lit(None).cast("binary").alias("value"))


def sequenced(batch: DataFrame, base: int, order: list[str], blocks: int | None = None) -> DataFrame:
    """seq = base + rank in `order`, gapless from base + 1."""
    return running_total(batch, order, F.lit(1), "_rank", blocks).withColumn("seq", (F.col("_rank") + base + 1).cast("bigint")).drop("_rank")
