"""Which runs and blocks can hold a key: fences, Bloom filters, block index, restart points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many runs their key ranges are broadcast.
BROADCAST_RUNS = 100_000
#: A filter for 100,000 keys with one false answer in a hundred.
BLOOM_BITS, BLOOM_HASHES = 958_506, 7
#: Bits of one row of a filter.
BITMAP = 32_768
#: Up to so many bytes of filters are broadcast with the key ranges.
BROADCAST_FILTERS = 64 << 20


def _prefix(key: Column) -> Column:
    """The first two bytes as a number, which never falls as keys rise."""
    byte = lambda i: F.coalesce(F.conv(F.nullif(F.hex(F.substring(key.cast("binary"), i, 1)), F.lit("")), 16, 10).cast("int"), F.lit(0))
    return byte(1) * 256 + byte(2)


def _spread(probes: DataFrame) -> DataFrame:
    """The distinct keys, in several tasks a core however few bytes they are: each is
    compared with all runs."""
    spark = probes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return probes.select("key").repartition(n, "key").distinct()


def _few(runs: DataFrame, most: int) -> bool:
    return runs.select("run_id").limit(most + 1).count() <= most


def _inside() -> Column:
    return (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))


def fence(probes: DataFrame, runs: DataFrame, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """(key, run_id) where the distinct key lies in the run's closed range. Keys are bytes
    or text, in both tables.

    The runs' metadata are broadcast up to `broadcast_runs` runs, which are counted; more
    are spread under the two-byte prefixes of their range and joined by these.
    """
    ranges = runs.select("run_id", "min_key", "max_key")
    if _few(runs, broadcast_runs):
        return _spread(probes).join(F.broadcast(ranges), _inside()).select("key", "run_id")
    spread = ranges.withColumn("_prefix", F.explode(F.sequence(_prefix(F.col("min_key")), _prefix(F.col("max_key")))))
    return probes.select("key").distinct().withColumn("_prefix", _prefix(F.col("key"))).join(spread, "_prefix").filter(_inside()).select("key", "run_id")


def _bits(bits: int, hashes: int) -> Column:
    """The places of a key in a filter: two halves of its MD5, one stepping by the other."""
    half = lambda i: F.conv(F.substring(F.md5("key"), i, 8), 16, 10).cast("bigint")
    return F.array(*[(half(1) + half(9) * F.lit(i)) % F.lit(bits) for i in range(hashes)])


def bloom_filters(log: DataFrame, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """(run_id, part, bitmap): the Bloom filter of each run's keys, BITMAP bits a row."""
    at = log.select("run_id", F.explode(_bits(bits, hashes)).alias("at"))
    return at.groupBy("run_id", F.floor(F.col("at") / BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bitmap"))


def might_contain(candidates: DataFrame, filters: DataFrame, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """Of the candidates (key, run_id), those whose run's filter has all bits of the key:
    every key that is there, and now and then one that is not."""
    asked = candidates.select("key", "run_id", F.explode(F.array_distinct(_bits(bits, hashes))).alias("at")).withColumn("part", F.floor(F.col("at") / BITMAP))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), ((F.col("at") % BITMAP) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("at") % 8).cast("int")) == 1
    said = asked.join(filters, ["run_id", "part"], "left").groupBy("key", "run_id").agg(F.bool_and(F.coalesce(hit, F.lit(False))).alias("maybe"))
    return said.filter("maybe").select("key", "run_id")


def _words(log: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(run_id, words): the Bloom filter of each run's keys as an array of 64-bit words."""
    at = log.select("run_id", _bits(bits, hashes).alias("_bits")).select("run_id", F.explode("_bits").alias("at")).filter("at IS NOT NULL")
    words = at.groupBy("run_id", F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("set"))
    by_word = words.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("_set"))
    of = lambda i: F.coalesce(F.try_element_at("_set", i), F.lit(0).cast("bigint"))
    return by_word.select("run_id", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit((bits - 1) // 64).cast("bigint")), of).alias("words"))


def candidates(probes: DataFrame, runs: DataFrame, log: DataFrame, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES, broadcast_runs: int = BROADCAST_RUNS, broadcast_filters: int = BROADCAST_FILTERS) -> DataFrame:
    """(key, run_id) that `fence` and the filters of `log` leave.

    Filters of up to BITMAP bits, `broadcast_filters` bytes of them, are broadcast with the
    ranges of at most `broadcast_runs` runs: a pair is judged where it arises and only what
    stays is a row. Otherwise the pairs of the fences are joined with the filters.
    """
    if bits > BITMAP or not _few(runs, min(broadcast_runs, broadcast_filters * 8 // bits)):
        return might_contain(fence(probes, runs, broadcast_runs), bloom_filters(log, bits, hashes), bits, hashes)
    judged = runs.select("run_id", "min_key", "max_key").join(_words(log, bits, hashes), "run_id")
    asked = _spread(probes).withColumn("_bits", _bits(bits, hashes))
    word = lambda i: F.expr(f"int(_bits[{i}] div 64)").alias(f"_word{i}")
    mask = lambda i: F.expr(f"shiftleft(1L, int(_bits[{i}] % 64))").alias(f"_mask{i}")
    asked = asked.select("key", *[f(i) for i in range(hashes) for f in (word, mask)])
    said = _inside()
    for i in range(hashes):
        said &= F.get(F.col("words"), F.col(f"_word{i}")).bitwiseAND(F.col(f"_mask{i}")) != 0
    return asked.join(F.broadcast(judged), said).select("key", "run_id")


def block_index(blocks: DataFrame) -> DataFrame:
    """The last key of each block."""
    return blocks.groupBy("run_id", "block_id").agg(F.max("key").alias("last_key"), F.count("*").alias("entries"))


def seek(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """For each (key, run), the first block whose last key is not below the key."""
    hit = candidates.join(index, "run_id").filter(F.col("last_key") >= F.col("key"))
    return hit.groupBy("key", "run_id").agg(F.min("block_id").alias("block_id"))


def restart_search(sought: DataFrame, blocks: DataFrame) -> DataFrame:
    """sought (key, run_id, block_id) with the restart point at or below the key, null if
    it lies below the block's first, and whether an entry up to the next point has the key.
    blocks: the entries, with `restart`."""
    upto = Window.partitionBy("run_id", "block_id").orderBy("key", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entries = blocks.select("run_id", "block_id", "key", F.max(F.when(F.col("restart"), F.col("key"))).over(upto).alias("point"))
    points = blocks.filter("restart").select("run_id", "block_id", F.col("key").alias("point")).orderBy("run_id", "block_id", "point")
    at = sought.join(points, ["run_id", "block_id"], "left").groupBy("key", "run_id", "block_id").agg(F.max(F.when(F.col("point") <= F.col("key"), F.col("point"))).alias("point"))
    found = entries.select("run_id", "block_id", "key", "point", F.lit(True).alias("hit")).distinct()
    return at.join(found, ["run_id", "block_id", "key", "point"], "left").select("key", "run_id", "block_id", "point", F.coalesce("hit", F.lit(False)).alias("found"))
