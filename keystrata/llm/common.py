"""What several operators share: the tables, words, and batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.sources.shared import Cut

#: Bytes of text that a Python worker works on at once; one longer text is its own piece.
PIECE_BYTES = 4 << 20
U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each row; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that no cut has more than `limit` bytes of text, or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    start = 0
    for end in [*edges.tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words, so that all bits serve for buckets and thresholds."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def input_bytes(df: DataFrame) -> int:
    """The size that the optimizer knows for the input: file sizes, without a pass over the rows."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sha256(column: Column) -> Column:
    return F.sha2(column, 256)


def fresh(name: str, columns: list[str]) -> str:
    """A column name like this one that is not in use."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hashable(schema: T.StructType) -> list[str]:
    """The columns that can be hashed and grouped by: not maps and variants."""
    return [f.name for f in schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


#: Equal rows that are more than so many are counted before they move.
COPIES = 256
#: Of hot rows so many keys are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
#: Copies that are made from one array.
RUN = 4096


def condensed(docs: DataFrame, most: int | None = None) -> DataFrame:
    """docs with `copies`: of rows that are equal in all columns and more than `most`, two
    stay, which stand for all of them. Two, so that what is in one is still there twice.

    Only eight bytes of a row move to find such rows. With a column that can't be compared,
    nothing is condensed.
    """
    most = COPIES if most is None else most
    if hashable(docs.schema) != docs.columns:
        return docs.withColumn("copies", F.lit(1).cast("bigint"))
    key = F.xxhash64(*docs.columns)
    hot = docs.select(key.alias("hot")).groupBy("hot").count().filter(F.col("count") > most).select("hot")
    hot = Cut(docs.sparkSession)(hot)
    n = hot.count()
    if not n:
        return docs.withColumn("copies", F.lit(1).cast("bigint"))
    near = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    keyed = docs.withColumn("hot", key)
    many = keyed.join(near, "hot", "left_semi").groupBy(*docs.columns).agg(F.count("*").alias("n"))
    two = many.select(*docs.columns, F.explode(F.expr("filter(array(n - n div 2, n div 2), x -> x > 0)")).alias("copies"))
    return keyed.join(near, "hot", "left_anti").select(*docs.columns, F.lit(1).cast("bigint").alias("copies")).unionByName(two)


def expanded(df: DataFrame) -> DataFrame:
    """Each row `copies` times, without that column."""
    runs = df.withColumn("copies", F.explode(F.expr(f"CASE WHEN copies = 1 THEN array(1L) ELSE transform(sequence(0L, (copies - 1) div {RUN}), i -> least(copies - i * {RUN}, {RUN}L)) END")))
    return runs.withColumn("copies", F.explode(F.expr("CASE WHEN copies = 1 THEN array(1L) ELSE sequence(1L, copies) END"))).drop("copies")
