"""Connected components by alternating stars, each round cut off by a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import Cut

#: Rounds grow with the logarithm of the longest chain; more than this is an error.
MOST_ROUNDS = 60


def _with_least(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (u, v), root being the least node reachable.

    In a large star every node hands its least neighbour to its larger ones, in a small star
    to its smaller ones; both keep the components, and they end in stars around the roots.
    Minima are combined before they move, so a hub costs no more than its edges. Loops and
    repeated edges do no harm; no edges give no rows.
    """
    cut = Cut(edges.sparkSession)

    def state(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 2**40), F.lit(0))).first()
        return r[0], r[1]

    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = state(e)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.filter("u <> v").distinct())
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
