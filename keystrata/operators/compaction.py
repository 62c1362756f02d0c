"""Choosing what to compact, over run metadata, and the merge of the chosen runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.scalar import overlaps
from keystrata.operators.resolve import latest


def overlap_pairs(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(run_id, other_id) of runs whose key ranges meet; run metadata only."""
    a, b = upper.alias("a"), lower.alias("b")
    cond = overlaps(F.col("a.min_key"), F.col("a.max_key"), F.col("b.min_key"), F.col("b.max_key"))
    return a.join(b, cond).select(F.col("a.run_id").alias("run_id"), F.col("b.run_id").alias("other_id"))


def overlap_score(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """How many lower runs each upper run would rewrite; none counts as zero."""
    n = overlap_pairs(upper, lower).groupBy("run_id").agg(F.count("*").alias("n_overlaps"))
    return upper.select("run_id", "data_size").join(n, "run_id", "left").select("run_id", "data_size", F.coalesce("n_overlaps", F.lit(0)).cast("bigint").alias("n_overlaps"))


def greedy_pick(scored: DataFrame, limit: int) -> DataFrame:
    """Fewest overlaps first, until what stays fits the limit; nothing when the level is
    below the limit, and at least one run when it is not.

    The window has no partition key: it runs over the runs of one level, metadata that the
    driver holds anyway.
    """
    order = Window.orderBy("n_overlaps", "run_id")
    total = F.sum("data_size").over(Window.partitionBy())
    cum = F.sum("data_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = scored.select("run_id", "data_size", "n_overlaps", total.alias("total"), cum.alias("cum"), F.row_number().over(order).alias("rn"))
    return d.filter((F.col("total") >= limit) & ((F.col("rn") == 1) | (F.col("total") - (F.col("cum") - F.col("data_size")) > limit))).select("run_id", "data_size", "n_overlaps")


def hull(runs: DataFrame) -> DataFrame:
    return runs.agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def hull_overlaps(picked: DataFrame, lower: DataFrame) -> DataFrame:
    """The lower runs that meet the hull of the picked ones."""
    h = hull(picked).alias("h")
    cond = overlaps(F.col("h.min_key"), F.col("h.max_key"), F.col("b.min_key"), F.col("b.max_key"))
    return lower.alias("b").join(h, cond, "left_semi")


def level0_inputs(runs: DataFrame, threshold: int) -> DataFrame:
    """All of level 0 with what it meets of level 1, when level 0 has `threshold` runs."""
    l0, l1 = runs.filter("level = 0"), runs.filter("level = 1")
    full = l0.agg((F.count("*") >= threshold).alias("full")).filter("full")
    ids = l0.select("run_id").unionByName(hull_overlaps(l0, l1).select("run_id"))
    return ids.join(full, how="left_semi")


def deeper_inputs(runs: DataFrame, level: int, limit: int) -> DataFrame:
    """The greedy pick of a level with what it meets of the next one."""
    upper, lower = runs.filter(F.col("level") == level), runs.filter(F.col("level") == level + 1)
    picked = upper.join(greedy_pick(overlap_score(upper, lower), limit).select("run_id"), "run_id", "left_semi")
    return picked.select("run_id").unionByName(hull_overlaps(picked, lower).select("run_id"))


def obsolete_removed(merged: DataFrame, rest: DataFrame) -> DataFrame:
    """Drop merged entries that a run outside the merge has in the same or a newer version."""
    newest = rest.groupBy("key").agg(F.max("seq").alias("rest_seq"))
    m = merged.alias("m")
    return m.join(newest.alias("r"), (F.col("m.key") == F.col("r.key")) & (F.col("r.rest_seq") >= F.col("m.seq")), "left_anti")


def merged(inputs: DataFrame, rest: DataFrame | None = None, purge: bool = False) -> DataFrame:
    """The merge of the inputs: the latest of each key, tombstones kept unless `purge`,
    which only the lowest level may ask for."""
    out = latest(inputs)
    if rest is not None:
        out = obsolete_removed(out, rest)
    return out.filter(~F.col("tombstone")) if purge else out
