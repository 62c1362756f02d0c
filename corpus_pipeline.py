"""A corpus from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns a DataFrame, which is written and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import bpe, mixing, near, quality, substring
from keystrata.llm.common import Cut, fresh, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules or likelihood ratio reject go."""
    return quality.passed(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go from the texts; no document does."""
    made = fresh("removal", docs.columns)
    out = substring.removed(docs, into=made)
    if "n_chars" in docs.columns:
        chars = F.when(F.col(made)["n_removed"] > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", chars)
    return out.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, their number, and the digest of what they decode to."""
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), keep=["doc_id", "lang", "source"])
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", source_mix),
    ("bpe", token_ids),
]

#: The ratio's hashes, the fingerprints and the tokens are beyond SQL; the tests hold each
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(spark, sf_dir)
    cut = Cut(spark)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
