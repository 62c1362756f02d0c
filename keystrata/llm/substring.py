"""Exact removal of repeated passages, found by Rabin-Karp hashes of word windows.

Documents are spread over chunks of a few MB by a hash of their row. A chunk hashes every
window of its documents (a polynomial in the words' 128-bit hashes, by running sums) and
asks about each, twice if it has it twice itself: so a passage in a third of all documents
is one entry of a chunk, however often it occurs. Asks move packed, 32 bits a window that
with their bucket make up the key, and Spark counts them: exploded within their bucket's
partition, in groups of equal keys. Keys that are there more than once go back to the chunks
that asked. What is left, a superset of all repeats, is counted in the same way once more by
96 bits of the hash, and the windows repeated by these are merged into maximal intervals.
All steps of a chunk read one exchange, so texts move once.

Nothing is counted over a sample. No group is larger than a chunk: Spark sorts, and spills,
what it counts. A chunk's rows depend on content only, so a part that is computed again after
an executor is lost is the same part. Hashes have 96 bits: among 1e13 windows less than a
thousandth of one agreement of two different ones is to be expected.

Rows: a null or blank text has no words and stays as it is; a text shorter than a window loses
nothing; equal rows are copies of each other and lose every covered word, and where they are
many they are counted before they move; null ids are ids. An empty table gives an empty one.
Extra columns stay whatever their names, but one named like the result (`into`), which is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import U64, condensed, expanded, hashable, input_bytes, mix, read, shuffle_partitions, texts
from keystrata.llm.quality import words_of

WINDOW = 35
#: Input bytes (as stored) of one chunk, in a corpus of up to WIDE bytes; chunks of a larger
#: one grow with the root of its size, up to MOST_CHUNK_BYTES.
CHUNK_BYTES, MOST_CHUNK_BYTES, WIDE = 3 << 20, 12 << 20, 16 << 30
#: Bytes of text that a worker hashes at once.
PIECE = 1 << 20
#: Partitions in which windows are counted, for one of the input, and buckets in each.
SPREAD, BUCKETS = 2, 2
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LOW = U64(0xFFFFFFFF)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of many texts in a row, with each text's first word's place."""

    def __init__(self, data: list[bytes]):
        self.lists = [t.split() for t in data]
        self.counts = np.array([len(x) for x in self.lists], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        digest = xxhash.xxh3_128_digest
        self.hashes = np.frombuffer(b"".join([digest(w) for x in self.lists for w in x]), ">u8").astype(U64).reshape(-1, 2)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, a, b) of every window that lies within one text: 64 and 32 bits of its
        hash; starts count over the words."""
        n = len(self.hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.uint32)
        ends = np.repeat(self.starts[1:], self.counts)[: n - size + 1]
        at = np.flatnonzero(np.arange(n - size + 1) + size <= ends)
        up, down = powers(BASE, n), powers(INVERSE, n - size + 1)
        out = []
        for k in range(2):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(self.hashes[:, k] * up)])
            out.append(mix((sums[size:] - sums[:-size]) * down)[at])
        return at, out[0], (out[1] >> U64(32)).astype(np.uint32)


def worded(data: list[bytes]) -> Iterator[tuple[list[bytes], Words]]:
    """Some PIECE bytes of texts at a time, or one longer text, with their words."""
    held, size = [], 0
    for t in data:
        if size and size + len(t) > PIECE:
            yield held, Words(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held, Words(held)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n places lie in a window of `size` from one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """By the high bits."""
    return ((hashes >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)


def lists(edges: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def twice(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes, each once, and those that were there more than once a second time."""
    u, n = np.unique(hashes, return_counts=True)
    return np.repeat(u, np.minimum(n, 2))


def within(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    at = np.searchsorted(sorted_set, h)
    return sorted_set[np.minimum(at, len(sorted_set) - 1)] == h


def both_within(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) are among the others, which are in the order of a, then b."""
    out = np.zeros(len(a), bool)
    if not len(in_a):
        return out
    first, last = np.searchsorted(in_a, a, "left"), np.searchsorted(in_a, a, "right")
    for k in range(int((last - first).max(initial=0))):
        q = first + k
        hit = q < last
        out[hit] |= in_b[q[hit]] == b[hit]
    return out


def chunked(docs: DataFrame, chunk_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """row, the other columns, text, copies and chunk, partitioned by the last; how many
    partitions, and how many chunks there are."""
    others = [c for c in docs.columns if c != "text"]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(True).alias(f"_{''.join(others)}")).alias("row"), "text")
    n, size = shuffle_partitions(docs), input_bytes(docs)
    chunk_bytes = chunk_bytes or int(min(MOST_CHUNK_BYTES, CHUNK_BYTES * max(1, size / WIDE) ** 0.5))
    chunks = max(n, min(1 << 26, size // chunk_bytes))
    keys = [F.col("row")[c] for c in hashable(docs.schema) if c != "text"]
    spread = condensed(given).withColumn("chunk", F.pmod(F.xxhash64(*keys, "text"), F.lit(chunks)))
    return spread.repartition(n, "chunk"), n, chunks


def restored(df: DataFrame, docs: DataFrame, into: str) -> DataFrame:
    """The columns of docs out of row and text, and `made` as `into`."""
    out = expanded(df)
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != into], F.col("made").alias(into))


def counted(asks: DataFrame, n: int, *hashes: str) -> DataFrame:
    """Of each asked list, packed again, what its bucket has more than once. The asks'
    exchange, by bucket, serves the counting and the packing too."""
    rows = asks.repartition(n, "bucket").select("bucket", "chunk", F.inline(F.arrays_zip(*hashes)))
    known = rows.withColumn("n", F.count("*").over(Window.partitionBy(*hashes, "bucket"))).filter("n > 1")
    return known.groupBy("bucket", "chunk").agg(*[F.collect_list(h).alias(h) for h in hashes])


def _flat(table: pa.Table, column: str, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[c.flatten().to_numpy(zero_copy_only=False).view(kind) for c in table.column(column).chunks]])


def removed(docs: DataFrame, window: int = WINDOW, into: str = "removal") -> DataFrame:
    """The columns of docs with text replaced by the kept words, joined by a space, where
    words were removed; and `into`, a struct of n_words, n_removed and spans, the removed
    word intervals."""
    spread, n, _ = chunked(docs)
    spread_out = SPREAD * n
    buckets = BUCKETS * spread_out

    def key(a: np.ndarray) -> np.ndarray:
        return bucket_of(a, buckets).astype(U64) << U64(32) | a & LOW

    def ask(table: pa.Table) -> pa.Table:
        a = twice(np.concatenate([w.windows(window)[1] for _, w in worded(texts(table.column("text")))]))
        bucket = bucket_of(a, buckets)
        full, edges = np.unique(bucket, return_index=True)
        chunk = pa.array(np.full(len(full), table.column("chunk")[0].as_py()), pa.int64())
        return pa.table({"bucket": pa.array(full, pa.int64()), "chunk": chunk, "a": lists(np.append(edges, len(a)), pa.array((a & LOW).astype(np.uint32).view(np.int32)))})

    def ask_again(table: pa.Table, replies: pa.Table) -> pa.Table:
        a, b = np.zeros(0, U64), np.zeros(0, np.uint32)
        if replies.num_rows and table.num_rows:
            sizes = pa.compute.list_value_length(replies.column("a")).to_numpy()
            known = np.sort(np.repeat(replies.column("bucket").to_numpy().astype(U64), sizes) << U64(32) | _flat(replies, "a", np.uint32).astype(U64))
            found = []
            for _, w in worded(texts(table.column("text"))):
                _, a, b = w.windows(window)
                hit = within(key(a), known)
                found.append((a[hit], b[hit]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        # each pair twice at most
        third = np.zeros(len(a), bool)
        third[2:] = (a[2:] == a[:-2]) & (b[2:] == b[:-2])
        a, b = a[~third], b[~third]
        full, edges = np.unique(bucket_of(a, buckets), return_index=True)
        ends = np.append(edges, len(a))
        chunk = pa.array(np.full(len(full), table.column("chunk")[0].as_py() if table.num_rows else 0), pa.int64())
        return pa.table({"bucket": pa.array(full, pa.int64()), "chunk": chunk, "a": lists(ends, pa.array(a.view(np.int64))), "b": lists(ends, pa.array(b.view(np.int32)))})

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        known_a, known_b = _flat(replies, "a", U64), _flat(replies, "b", np.uint32)
        order = np.lexsort((known_b, known_a))
        known_a, known_b = known_a[order], known_b[order]
        out, n_words, n_removed, spans = [], [], [], []
        for held, w in worded(texts(table.column("text"))):
            at, a, b = w.windows(window)
            gone = covered(len(w.hashes), at[both_within(a, b, known_a, known_b)], window)
            n_words += w.counts.tolist()
            for i, t in enumerate(held):
                g = gone[int(w.starts[i]) : int(w.starts[i + 1])]
                k = int(g.sum())
                n_removed.append(k)
                if not k:
                    out.append(t)
                    spans.append([])
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))).tolist()
                spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                out.append(b" ".join([x for x, gx in zip(w.lists[i], g.tolist(), strict=True) if not gx]))
        kept = pa.compute.if_else(table.column("text").is_valid(), pa.array(out, pa.binary()).cast(pa.string()), pa.scalar(None, pa.string()))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        made = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind)], names=["n_words", "n_removed", "spans"])
        return pa.table([table.column("row"), kept, table.column("copies"), made], names=["row", "text", "copies", "made"])

    first = counted(spread.groupBy("chunk").applyInArrow(ask, "bucket bigint, chunk bigint, a array<int>"), spread_out, "a")
    again = spread.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(ask_again, "bucket bigint, chunk bigint, a array<bigint>, b array<int>")
    replies = counted(again, spread_out, "a", "b")
    schema = T.StructType([*[spread.schema[c] for c in ("row", "text", "copies")], *T.StructType.fromDDL("made struct<n_words: bigint, n_removed: bigint, spans: array<struct<start: int, end: int>>>").fields])
    return restored(spread.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema), docs, into)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = removed(read(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "removal.*")
    # where nothing goes, the kept words still have single spaces between them
    kept = F.when(F.col("n_words") == F.col("n_removed"), "").otherwise(F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.array_join(words_of("text"), " ")))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
windows AS (SELECT doc, pos, md5(array_to_string(words[pos:pos + {WINDOW - 1}], ' ')) AS name FROM (SELECT doc, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM d)),
again AS (SELECT doc, pos FROM (SELECT doc, pos, count(*) OVER (PARTITION BY name) AS n FROM windows) WHERE n > 1),
marked AS (SELECT w.*, max(CASE WHEN a.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc ORDER BY w.pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN again a ON a.doc = w.doc AND a.pos = w.pos),
kept AS (SELECT doc, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY doc)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc = d.doc"""
