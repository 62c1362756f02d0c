"""A running total over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.sources.shared import Cut


def running_total(df: DataFrame, order: list[str], size: Column, name: str, blocks: int | None = None) -> DataFrame:
    """name: the sum of `size` over the rows before this one in `order`.

    The rows are range-partitioned and written once, each with its block: two range
    exchanges would sample their own bounds and disagree about which block a row is in, and
    so would one that is computed again. Blocks sum their own rows; the totals of the blocks
    before are added: as many rows as there are blocks (`blocks`, or the session's shuffle
    partitions). The order has to be total for the result to be one result.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = {"_size", "_block", "_before", "_own"} & set(df.columns)
    if made:
        raise ValueError(f"columns in use: {', '.join(sorted(made))}")
    parted = Cut(df.sparkSession)(df.withColumn("_size", size.cast("bigint")).repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))
    sums = parted.groupBy("_block").agg(F.sum("_size").alias("_sum"))
    up_to = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(up_to.orderBy("_block")), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum("_size").over(up_to.partitionBy("_block").orderBy(*order)), F.lit(0))
    return parted.withColumn("_own", own).join(F.broadcast(before), "_block").withColumn(name, F.col("_before") + F.col("_own")).drop("_block", "_own", "_before", "_size")
