"""The given tables, and the mutation logs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.codec import json_value, text_key

#: Mutations in one run of the primary log.
RUN_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def primary_log(spark: SparkSession, sf_dir: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """`events` as a log."""
    return as_log(table(spark, sf_dir, "events"), run_rows)


def as_log(events: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Events as puts and deletes per user: an error deletes, anything else puts its props."""
    dead = F.col("event_type") == "error"
    return events.select(
        text_key("user_id").alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        dead.alias("tombstone"),
        F.when(~dead, F.encode("props", "UTF-8")).alias("value"),
        F.floor(F.col("event_id") / run_rows).cast("bigint").alias("run_id"),
        run_level(F.floor(F.col("event_id") / run_rows)).alias("level"),
    )


def run_level(run_id):
    """The level given to a run of the primary log: a fixed spread over three levels."""
    m = run_id % 4
    return F.when(m == 3, 0).when(m == 0, 2).otherwise(1).cast("bigint")


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders`: one put for each order key, zero-padded so that byte order is numeric order."""
    return table(spark, sf_dir, "orders").select(
        F.encode(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), "UTF-8").alias("key"),
        (F.col("o_orderkey") + 1).cast("bigint").alias("seq"),
        F.lit(False).alias("tombstone"),
        json_value("o_custkey", "o_orderstatus", "o_totalprice").alias("value"),
    )


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents`: large values under the padded document id."""
    return table(spark, sf_dir, "documents").select(
        F.encode(F.lpad(F.col("doc_id").cast("string"), 12, "0"), "UTF-8").alias("key"),
        (F.col("doc_id") + 1).alias("seq"),
        F.lit(False).alias("tombstone"),
        F.encode("text", "UTF-8").alias("value"),
    )


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` under the composite key conv_id|turn."""
    return table(spark, sf_dir, "conversations").select(
        text_key("conv_id", "turn").alias("key"),
        F.lit(1).cast("bigint").alias("seq"),
        F.lit(False).alias("tombstone"),
        F.encode("text", "UTF-8").alias("value"),
    )
