"""Column helpers: sizes, level limits and the key-range predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024
#: Bytes a level may hold before some of it moves down; deeper levels take the last one.
LEVEL_LIMIT = {1: 10 * MIB, 2: 100 * MIB, 3: 1000 * MIB, 4: 10_000 * MIB}
LEVEL_LIMIT_REST = 100_000 * MIB
#: Bytes of one run file by level.
FILE_TARGET = {0: 2 * MIB, 1: 2 * MIB, 2: 20 * MIB, 3: 200 * MIB, 4: 2000 * MIB}
FILE_TARGET_REST = 200_000 * MIB
#: A file counts as this much larger than what was written to it, for its index and filter.
FILE_OVERHEAD = 1.2
RECORD_OVERHEAD = 4


def _by_level(level: Column, table: dict[int, int], rest: int) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(level == k, F.lit(v)) if out is None else out.when(level == k, F.lit(v))
    return out.otherwise(F.lit(rest)).cast("bigint")


def level_limit(level: Column) -> Column:
    return _by_level(level, LEVEL_LIMIT, LEVEL_LIMIT_REST)


def level_limit_of(level: int) -> int:
    return LEVEL_LIMIT.get(level, LEVEL_LIMIT_REST)


def file_target(level: Column) -> Column:
    return _by_level(level, FILE_TARGET, FILE_TARGET_REST)


def file_target_of(level: int) -> int:
    return FILE_TARGET.get(level, FILE_TARGET_REST)


def entry_size(key: str = "key", value: str = "value") -> Column:
    """Bytes of key and value; a deleted entry's value counts as none."""
    return (F.octet_length(F.col(key)) + F.coalesce(F.octet_length(F.col(value)), F.lit(0))).cast("bigint")


def record_size(key: str = "key", value: str = "value") -> Column:
    """entry_size with the length field before each stored record."""
    return entry_size(key, value) + F.lit(RECORD_OVERHEAD)


def overlaps(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Do two closed key ranges share a key?"""
    return (a_min <= b_max) & (a_max >= b_min)


def checksum(key: str = "key", value: str = "value") -> Column:
    """CRC-32 over key and value bytes."""
    return F.crc32(F.concat(F.col(key), F.coalesce(F.col(value), F.lit(b""))))


def intact(stored: str, key: str = "key", value: str = "value") -> Column:
    """Does a record fit the checksum that was stored with it? A reader drops the others."""
    return checksum(key, value) == F.col(stored)
