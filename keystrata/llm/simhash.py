"""SimHash fingerprints and their links, by multi-index hashing.

A bit of the fingerprint is 1 if it is set in over half of a text's shingle hashes. To find
all pairs within `radius` bits, a fingerprint is cut into segments: one of them differs by
no more than radius // segments bits, so each fingerprint is entered in a table under each
segment's value and asks for the values in the small ball around its own. What it meets is
kept if the whole distance is small enough. Only distinct fingerprints take part, whatever
the number of documents that share one; documents meet their component by their fingerprint.

A crowded table value (more than CROWD fingerprints under one segment value) is not joined
as it is: the other bits are cut into radius + 1 parts, one of which must agree as well, and
that part joins the key. No pair is lost, and none is made twice.

What a fingerprint asks for is some 33 rows, which the optimizer, going by the size of the
files they come from, does not know of: it would broadcast them. These joins are by sorting,
and fingerprints are broadcast up to a checked number of them only.

Rows: a null or empty text has no words and the fingerprint zero, which links like any
other; fewer words than a shingle form one shingle; null ids have a fingerprint, a component
without any id has the component null. Repeated rows share their result. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import BROADCAST_KEYS, Cut, pieces, read, texts
from keystrata.llm.graph import components

RADIUS = 2
SEGMENTS = 2
CROWD = 64
SHINGLE = 3
SEED = 42


def shingle_hashes(data: bytes, size: int) -> bytes:
    """XXH64 of each shingle of lower-cased words, eight bytes each."""
    words = data.lower().split()
    if not words:
        return b""
    if len(words) <= size:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = list(map(len, words))
    ends = np.cumsum(np.array(lengths, np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)])


def majority(hashes: bytes) -> int:
    """The signed 64-bit fingerprint of packed hashes."""
    n = len(hashes) // 8
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        count += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `fp`, bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                fp = [majority(shingle_hashes(t, shingle)) for t in texts(b.column("text"))]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(fp, pa.int64())], names=[*keep, "fp"])

    given = docs.select(*keep, "text")
    return given.mapInArrow(run, given.drop("text").schema.add("fp", "long"))


def _part(fp: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _distance() -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(fp, other): every pair of different fingerprints within `radius` bits, once or more."""
    width = 64 // segments
    ball = radius // segments
    if ball > 1 or segments != 2:
        raise ValueError("two segments, and a ball of one bit at most")
    table = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _part(F.col("fp"), s * width, width).alias("value")) for s in range(segments)])).alias("t")).select("t.seg", "t.value", F.col("fp").alias("other"))
    # of two segments that differ in one bit, the one with the 0 there asks for the other
    asked = table.withColumnRenamed("other", "fp")
    if ball:
        flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(width)])
        asked = asked.withColumn("flip", F.explode(F.filter(flips, lambda x: x.bitwiseAND(F.col("value")) == 0))).select("seg", F.col("value").bitwiseOR(F.col("flip")).alias("value"), "fp", "flip")
    else:
        asked = asked.withColumn("flip", F.lit(0).cast("bigint"))
    crowded = table.groupBy("seg", "value").count().filter(F.col("count") > crowd).select("seg", "value", F.lit(True).alias("crowded"))
    entered = table.join(crowded, ["seg", "value"], "left")
    once = (F.col("flip") != 0) | (F.col("fp") < F.col("other"))
    near = _distance() <= radius
    light = asked.join(entered.filter("crowded IS NULL").hint("merge"), ["seg", "value"]).filter(once & near)
    # a part of the bits outside the segment has to agree too
    rest = 64 - width
    cuts = [rest * i // (radius + 1) for i in range(radius + 2)]

    def outside(c: str) -> Column:
        fp = F.col(c)
        return F.array(*[F.struct(F.lit(i).alias("part"), F.when(F.col("seg") == 0, _part(F.shiftrightunsigned(fp, width), cuts[i], cuts[i + 1] - cuts[i])).otherwise(_part(fp, cuts[i], cuts[i + 1] - cuts[i])).alias("bits")) for i in range(radius + 1)])

    some = asked.join(crowded, ["seg", "value"], "left_semi")
    left = some.withColumn("p", F.explode(outside("fp"))).select("seg", "value", "fp", "flip", "p.part", "p.bits")
    right = entered.filter("crowded").withColumn("p", F.explode(outside("other"))).select("seg", "value", "other", "p.part", "p.bits")
    heavy = left.join(right.hint("merge"), ["seg", "value", "part", "bits"]).filter(once & near)
    return light.select("fp", "other").unionByName(heavy.select("fp", "other"))


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest id that links reach."""
    fps = Cut(docs.sparkSession)(fingerprints(docs, shingle))  # narrow, and read by several steps
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    small = lambda d: F.broadcast(d) if n <= BROADCAST_KEYS else d.hint("merge")
    n = distinct.count()
    roots = components(links(distinct.select("fp"), radius).select(F.col("fp").alias("u"), F.col("other").alias("v")))
    placed = distinct.join(small(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.join(smallest, "root").select("fp", "component_id")
    return fps.join(small(of_fp), "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(read(spark, sf_dir))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
