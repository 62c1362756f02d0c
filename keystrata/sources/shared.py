"""Tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. Only a local session,
    as in tests, may name none and gets a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.gettempdir() + "/keystrata-checkpoints"


def session_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared one; it is deleted when the session ends."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path, files = _path(spark, at)
    files.deleteOnExit(path)
    return at


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Cut:
    """Tables that cut a lineage: each is written to the shared folder and read again, and
    the one before it goes once the next is there. The last one, which results may still
    read, goes with the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, session_folder(spark), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        before, files = _path(self.spark, f"{self.at}/{self.n - 1}")
        files.delete(before, True)
        return self.spark.read.schema(df.schema).parquet(path)
