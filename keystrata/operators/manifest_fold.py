"""The manifest log as a table: fold, checkpoint and difference of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(log: DataFrame) -> DataFrame:
    """Runs whose last word in (commit_id, pos) order is an add."""
    last = log.groupBy("run_id").agg(F.max_by("op", F.struct("commit_id", "pos")).alias("op"), F.max("commit_id").alias("commit_id"))
    return last.filter("op = 'add'").select("run_id", "commit_id")


def next_run_id(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("run_id"), F.lit(-1)) + 1).cast("bigint").alias("next_run"))


def checkpointed(log: DataFrame, at_commit: int) -> DataFrame:
    """The same state with the commits up to `at_commit` replaced by one batch of adds."""
    old = snapshot(log.filter(F.col("commit_id") <= at_commit))
    adds = old.select(F.lit(at_commit).cast("bigint").alias("commit_id"), F.lit(0).alias("pos"), F.lit("add").alias("op"), "run_id")
    return adds.unionByName(log.filter(F.col("commit_id") > at_commit).select("commit_id", "pos", "op", "run_id"))


def difference(opened: DataFrame, committed: DataFrame) -> DataFrame:
    """What to do with each run so that the open set becomes the committed one."""
    a = opened.select("run_id", F.lit(True).alias("is_open"))
    b = committed.select("run_id", F.lit(True).alias("is_committed"))
    return a.join(b, "run_id", "full_outer").select(
        "run_id", F.when(F.col("is_open") & F.col("is_committed"), "keep").when(F.col("is_open"), "close").otherwise("open").alias("action")
    )
