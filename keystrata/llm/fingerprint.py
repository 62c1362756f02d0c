"""Threshold-scaled sketches of documents.

A sketch keeps every hash of a 5-word shingle (ASCII lower case) that lies below a fixed
fraction of the hash range. Sketches of parts merge into the sketch of the whole, and the
share of one sketch in another estimates containment whatever the two lengths are. Where no
hash lies below the fraction, the smallest one stays, so only a text without words has an
empty sketch; fewer words than a shingle form one shingle.

The query compares each document with its edited text, whose end comes from the next
document in descending id order. Texts move once, into parts of that order. The parts' bounds
come from a sample chosen by hash, some SAMPLES rows a part, of which ids and the first
characters of texts go to the driver, equal ones as one; there are MOST_PARTS at most. A
row's part is a function of the row and the bounds, so a part is the same whoever works it
out, and a hot id is cut by its texts. Within a part the next document is the next row; the
last row of a part meets the first one of the next part under that part's number.

Rows: a null text is the empty text; equal ids are ordered by text, null ids come last; of
equal rows each has its own next; a single document is its own next. Two empty sketches are
alike (1), an empty and another are not (0). An empty table gives an empty one; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import U64, input_bytes, mix, pieces, read, shuffle_partitions, texts

SHINGLE = 5
#: One hash in so many is kept.
SCALED = 4
POWERS = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(64)]
#: Stored input bytes of one part, and the most parts.
PART_BYTES, MOST_PARTS = 8 << 20, 20_000
#: Sampled rows for each part, and the characters of a text that order equal ids.
SAMPLES, HEAD = 16, 32


def sketch(data: bytes, shingle: int = SHINGLE, scaled: int = SCALED) -> np.ndarray:
    """The sorted hashes that a text keeps."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, U64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(U64)
    k = min(shingle, len(h))
    s = np.zeros(len(h) - k + 1, U64)
    for i in range(k):
        s += h[i : len(h) - k + 1 + i] * U64(POWERS[i])
    s = mix(s + U64(k))
    low = s[s < U64((1 << 64) // scaled)]
    return np.unique(low) if len(low) else s.min(keepdims=True)


def merged(a: np.ndarray, b: np.ndarray, scaled: int = SCALED) -> np.ndarray:
    """The sketch of two texts side by side (their shingles together)."""
    u = np.union1d(a, b)
    low = u[u < U64((1 << 64) // scaled)]
    return low if len(low) else u[:1]


def text_of(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common shingles in all of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    c = common(a, b)
    return c / (len(a) + len(b) - c)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return common(a, b) / len(a)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `fingerprint`, 16 hexadecimal digits a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array([text_of(sketch(t)) for t in texts(b.column("text"))], pa.string())], names=[*keep, "fingerprint"])

    given = docs.select(*keep, "text")
    return given.mapInArrow(run, given.drop("text").schema.add("fingerprint", "string"))


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double"
FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_edited"]


def compared(doc_id: int | None, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    n = len(text)
    k = n // 3
    edited = (text[: n - k] + following[:k]).encode()
    e = sketch(edited)
    return doc_id, n, hashlib.sha256(edited).hexdigest(), text_of(own), text_of(e), likeness(own, e), likeness(own, after), containment(own, e)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=FIELDS)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of each part but its last, against the next one. The rows are in order."""
    last, at = None, None
    for whole in batches:
        for b in pieces(whole, "text", 1 << 20):
            out = []
            for part, i, t in zip(*[b.column(c).to_pylist() for c in ("part", "doc_id", "text")], strict=True):
                s = sketch(t.encode())
                if last is not None and part == at:
                    out.append(compared(*last, t, s))
                last, at = (i, t, s), part
            if out:
                yield _batch(out)


def _order(doc_id: int | None, text: str) -> tuple:
    return doc_id is None, -(doc_id or 0), text.encode()


ENDS = "part int, head string, tail struct<doc_id: bigint, text: string>"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of each part."""
    first: dict[int, tuple] = {}
    last: dict[int, tuple] = {}
    for b in batches:
        for part, i, t in zip(*[b.column(c).to_pylist() for c in ("part", "doc_id", "text")], strict=True):
            k = _order(i, t)
            if part not in first or k < first[part][0]:
                first[part] = k, i, t
            if part not in last or k >= last[part][0]:
                last[part] = k, i, t
    for part, (_, _, head) in first.items():
        tail = pa.StructArray.from_arrays([pa.array([last[part][1]], pa.int64()), pa.array([last[part][2]], pa.string())], names=["doc_id", "text"])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([head], pa.string()), tail], names=["part", "head", "tail"])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [compared(tail["doc_id"], tail["text"], sketch(tail["text"].encode()), n, sketch(n.encode())) for tail, n in zip(b.column("tail").to_pylist(), b.column("head").to_pylist(), strict=True)]
        if rows:
            yield _batch(rows)


def bounds(d: DataFrame, parts: int) -> list[tuple]:
    """Where each part but the last ends, in the order of rows."""
    some = min(1.0, SAMPLES * parts / max(1, d.count()))
    chosen = d.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(some * (1 << 20)) + 1)
    rows = chosen.groupBy("doc_id", F.substring("text", 1, HEAD).alias("head")).count().collect()
    keys = sorted((_order(r.doc_id, r.head), r[2]) for r in rows)
    total, seen, out = sum(n for _, n in keys), 0, []
    for k, n in keys:
        if seen * parts // max(1, total) > len(out) and (not out or out[-1] < k):
            out.append(k)
        seen += n
    return out


def edits(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each document against its edited text and the next document."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = bounds(d, max(1, min(MOST_PARTS, input_bytes(docs) // part_bytes)))

    @F.pandas_udf("int")
    def part_of(none: pd.Series, doc_id: pd.Series, head: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, (n, -i, h.encode())) for n, i, h in zip(none.tolist(), doc_id.tolist(), head.tolist(), strict=True)], dtype="int32")

    part = part_of(F.isnull("doc_id"), F.coalesce("doc_id", F.lit(0)), F.substring("text", 1, HEAD))
    used = sorted(r.part for r in d.select(part.alias("part")).distinct().collect())
    spread = d.withColumn("part", part).repartition(max(len(used), shuffle_partitions(docs)), "part")
    inside = spread.sortWithinPartitions("part", F.col("doc_id").desc_nulls_last(), F.col("text").asc()).mapInArrow(_inside, RESULT)
    after = F.broadcast(docs.sparkSession.createDataFrame(list(zip(used, [*used[1:], *used[:1]], strict=True)), "part int, following int"))
    ends = spread.mapInArrow(_ends, ENDS).join(after, "part")
    # a head comes under its part's number, a tail under that of the next one
    both = ends.select(F.explode(F.array(F.struct(F.col("part").alias("at"), "head", F.lit(None).cast("struct<doc_id: bigint, text: string>").alias("tail")), F.struct(F.col("following").alias("at"), F.lit(None).cast("string").alias("head"), "tail"))).alias("x")).select("x.*")
    met = both.groupBy("at").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    return inside.unionByName(met.select("head", "tail").mapInArrow(_tails, RESULT))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(read(spark, sf_dir))
