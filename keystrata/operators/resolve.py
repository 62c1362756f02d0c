"""From a mutation log to what it says: latest versions, the live view, lookups, history.

Every reader uses `latest`, and tombstones go only after it: dropping them first would
bring back the values that they hide. A filter on `key` passes below the aggregate to the
scan, as the key is what is grouped by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """The mutation with the highest sequence of each key, tombstones included.

    One partial aggregate before one exchange on the key, so a hot key shrinks to a row
    for each map task before it moves.
    """
    newest = F.max_by(F.struct("tombstone", "value"), F.col("seq"))
    return log.groupBy("key").agg(F.max("seq").alias("seq"), newest.alias("v")).select("key", "seq", "v.tombstone", "v.value")


def live(log: DataFrame) -> DataFrame:
    """key, value, seq of the keys that exist."""
    return latest(log).filter(~F.col("tombstone")).select("key", "value", "seq")


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).filter("tombstone").select("key", "seq")


def get(log: DataFrame, key: bytes) -> DataFrame:
    """One row (key, found, value) whether or not the key exists."""
    hit = live(log.filter(F.col("key") == F.lit(key))).select("value")
    return hit.agg(F.lit(key).alias("key"), (F.count("*") > 0).alias("found"), F.max("value").alias("value"))


def multi_get(log: DataFrame, keys: DataFrame, broadcast_rows: int | None = None) -> DataFrame:
    """(key, found, value) for each distinct key of `keys`.

    The log is cut to the asked keys by a semi join before it is resolved. `broadcast_rows`
    is the caller's proven bound on the keys; only a small bound lets them be broadcast.
    """
    asked = keys.select("key").distinct()
    small = F.broadcast(asked) if broadcast_rows is not None and broadcast_rows <= 100_000 else asked
    hits = live(log.join(small, "key", "left_semi")).select("key", "value", F.lit(True).alias("hit"))
    return asked.join(hits, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("found"), "value")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live view as it was after mutation `seq` (an extension; needs the whole log)."""
    return live(log.filter(F.col("seq") <= seq))


def key_scan(log: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """The live view in [low, high), in key order (an extension)."""
    cond: Column = F.lit(True)
    if low is not None:
        cond &= F.col("key") >= F.lit(low)
    if high is not None:
        cond &= F.col("key") < F.lit(high)
    return live(log.filter(cond)).orderBy("key")


def ranked(log: DataFrame) -> DataFrame:
    """Every version with its rank in its key, newest first."""
    return log.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))).cast("bigint"))


def history(log: DataFrame) -> DataFrame:
    """Every version with the sequences before and after it."""
    w = Window.partitionBy("key").orderBy("seq")
    return log.withColumn("prev_seq", F.lag("seq").over(w)).withColumn("next_seq", F.lead("seq").over(w))


def max_seq(*parts: DataFrame) -> DataFrame:
    """The highest sequence over log tail and runs alike; 0 when all are empty."""
    out = None
    for p in parts:
        m = p.agg(F.max("seq").alias("seq"))
        out = m if out is None else out.unionByName(m)
    return out.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("bigint").alias("max_seq"))


def upsert(old: DataFrame, tail: DataFrame) -> DataFrame:
    """Replay a log tail over an older resolved state."""
    cols = ["key", "seq", "tombstone", "value"]
    return latest(old.select(*cols).unionByName(tail.select(*cols)))
