"""Schemas of the mutation log, the run metadata and the manifest log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("level", T.LongType(), False),
        T.StructField("entries", T.LongType(), False),
        T.StructField("data_size", T.LongType(), False),
        T.StructField("min_key", T.BinaryType(), True),
        T.StructField("max_key", T.BinaryType(), True),
        T.StructField("max_seq", T.LongType(), True),
        T.StructField("path", T.StringType(), True),
    ]
)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("commit_id", T.LongType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("run", T.ArrayType(T.LongType()), True),
        T.StructField("arg", T.LongType(), True),
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """Project to ENTRY_SCHEMA's columns and types; extra columns go."""
    missing = [f.name for f in ENTRY_SCHEMA if f.name not in df.columns]
    if missing:
        raise ValueError(f"not a mutation log: no column {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTRY_SCHEMA])


def violations(df: DataFrame) -> DataFrame:
    """One row per broken invariant with its count: null keys, tombstones with a value,
    values missing without a tombstone, repeated (key, seq)."""
    repeated = df.groupBy("key", "seq").count().filter("count > 1")
    return (
        df.select(
            F.expr("count_if(key IS NULL)").alias("null_key"),
            F.expr("count_if(tombstone AND value IS NOT NULL)").alias("tombstone_with_value"),
            F.expr("count_if(NOT tombstone AND value IS NULL)").alias("value_missing"),
        )
        .selectExpr("stack(3, 'null_key', null_key, 'tombstone_with_value', tombstone_with_value, 'value_missing', value_missing) AS (rule, n)")
        .unionByName(repeated.agg(F.count("*").alias("n")).select(F.lit("repeated_key_seq").alias("rule"), "n"))
        .filter("n > 0")
    )
