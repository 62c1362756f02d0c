"""Typed columns to keys and values, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "|"


def text_key(*cols: str | Column) -> Column:
    """UTF-8 of the parts joined by a bar. Nulls are not keys: any null part gives null."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(SEPARATOR), p.cast("string"))
    return F.encode(joined, "UTF-8")


def ordered_long_key(col: str | Column) -> Column:
    """Eight bytes whose unsigned order is the order of the signed numbers."""
    c = (F.col(col) if isinstance(col, str) else col).cast("bigint")
    return F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def json_value(*cols: str) -> Column:
    """The columns as one JSON object in UTF-8."""
    return F.encode(F.to_json(F.struct(*cols)), "UTF-8")


def decoded(df: DataFrame, schema: str | None = None) -> DataFrame:
    """key and value as text; with a schema the value is parsed from JSON into its columns."""
    out = df.withColumn("key", F.decode("key", "UTF-8")).withColumn("value", F.decode("value", "UTF-8"))
    if schema is None:
        return out
    return out.withColumn("value", F.from_json("value", schema)).select(*[c for c in out.columns if c != "value"], "value.*")
