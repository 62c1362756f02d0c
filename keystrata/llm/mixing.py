"""Mixing sources to target weights, by hash thresholds.

Every document has a 60-bit hash of its id and text. A source whose target is k whole copies and a
rest takes each document k times, and once more the documents whose hash lies below the
source's threshold, at which the rest is reached. Thresholds are nested: a smaller budget
takes a subset. They come from histograms, not from a sort: sizes are summed by source and
hash bucket, the bucket where the rest is reached is split into buckets of its own, and so
on, five times twelve bits; each time only the rows of that one bucket are read again. The
document at the boundary is taken if half of it fits, so a source misses its target by half
a document at most (where rows share id and text, and so a hash, by half of them together).
The narrow table of sizes and hashes is written once, as each level reads it, and so is what
each level leaves, a row for each source.

Targets: sources by code point, null last, have the weights in turn and share the whole
size; a target stops at `most` times its source's size, and the excess is shared by weight
until none is above. With the sources in order of most * size / weight this has a closed
form in running sums.

Rows: a null or blank text has size 0 and nothing to take; a null source is a source; rows
without an id are told apart by their texts; repeated rows are taken alike; an empty table
gives an empty one. `mixed` keeps extra columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm.common import Cut, read

WEIGHTS = (5, 2, 1)
MOST = 3
LEVELS, BITS = 5, 12
#: Up to so many sources their table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, the extra columns, source, size, h and `sk`, a source key without nulls."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    h = F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 15), 16, 10).cast("bigint")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    return docs.select("doc_id", *extra, "source", size.alias("size"), h.alias("h"), key.alias("sk"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sk, source_size, target of the table of sources (sk, source, source_size).

    Its windows see all sources at once: one row each, whatever the number of documents.
    """
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), at.cast("int") + 1)
    d = sizes.withColumn("w", weight.cast("bigint"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    d = d.withColumn("cap", most * F.col("source_size"))
    d = d.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"), (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open_w"), F.sum("source_size").over(whole).alias("total"))
    level = (F.col("total") - F.col("capped")) / F.col("open_w")
    d = d.withColumn("level", level)
    # the least level at which the source that comes next is not above its cap
    final = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("capped"), F.col("level")))).over(whole)
    d = d.withColumn("final", final["level"])
    target = F.when(F.col("final").isNull() | (F.col("final") * F.col("w") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("w"))
    return d.select("sk", "source_size", target.alias("target"))


def _near(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def taken(base: DataFrame, rows: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sized() with source_size, target and `copies`, how often a document is taken.

    rows: the same documents, sized with more columns, to be returned instead.
    """
    base, step = Cut(base.sparkSession)(base), Cut(base.sparkSession)
    sums = base.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    small = sums.count() <= BROADCAST_SOURCES
    goal = targets(sums, weights, most)
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goal = goal.withColumn("whole", F.least(share, F.lit(most)))
    goal = goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = goal.select("sk", F.lit(0).cast("bigint").alias("prefix"), "rest")
    for k in range(LEVELS):
        low = BITS * (LEVELS - 1 - k)
        inside = base.join(_near(state, small), "sk").filter(F.shiftright("h", low + BITS) == F.col("prefix"))
        sums = inside.groupBy("sk", F.shiftright("h", low).alias("bucket")).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = sums.withColumn("before", before)
        # the last bucket that begins within the budget holds its end
        edge = at.filter(F.col("before") <= F.col("rest")).groupBy("sk").agg(F.max(F.struct("bucket", "before", "s", "rest")).alias("x"))
        state = edge.select("sk", F.col("x.bucket").alias("prefix"), (F.col("x.rest") - F.col("x.before")).alias("rest"), F.col("x.s").alias("s"))
        state = step(state if k == LEVELS - 1 else state.drop("s"))
    limit = state.select("sk", (F.col("prefix") + F.when(F.col("s") / 2 <= F.col("rest"), 1).otherwise(0)).alias("threshold"))
    goal = goal.join(limit, "sk", "left")
    out = (base if rows is None else rows).join(_near(goal.select("sk", "source_size", "target", "whole", "threshold"), small), "sk")
    return out.withColumn("copies", F.col("whole") + F.when(F.col("whole") >= most, 0).when(F.col("h") < F.col("threshold"), 1).otherwise(0))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it had."""
    inner = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = taken(sized(docs), sized(inner, "row"), weights, most).filter("copies > 0")
    return out.select("row", F.explode(F.expr("sequence(1, cast(copies as int))"))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taken(sized(read(spark, sf_dir)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS s FROM base GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * s AS cap FROM sums),
-- the rounds of sharing: whoever is above its cap stops there, the others share what is left
rounds AS (
  SELECT 0 AS n, source, s, w, cap, false AS stopped, (SELECT sum(s) FROM sums)::DOUBLE / (SELECT sum(w) FROM ranked)::DOUBLE AS level FROM ranked
  UNION ALL
  SELECT n + 1, source, s, w, cap, stopped OR level * w > cap,
    ((SELECT sum(s) FROM sums) - coalesce(sum(CASE WHEN stopped OR level * w > cap THEN cap END) OVER (), 0))::DOUBLE
      / coalesce(sum(CASE WHEN stopped OR level * w > cap THEN NULL ELSE w END) OVER (), 1)::DOUBLE
  FROM rounds WHERE n < 100),
goal AS (SELECT source, s, CASE WHEN stopped THEN cap::DOUBLE ELSE level * w END AS target FROM rounds WHERE n = 100),
goal2 AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), 3)::BIGINT ELSE 0 END AS whole FROM goal),
ordered AS (
  SELECT b.*, g.s AS source_size, g.target, g.whole, g.target - g.whole * g.s AS rest,
         sum(size) OVER (PARTITION BY b.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY b.source, h) AS tied
  FROM base b JOIN goal2 g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN whole < 3 AND upto - tied / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered"""
