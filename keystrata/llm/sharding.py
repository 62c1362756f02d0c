"""A reproducible shuffle of all rows into shards, computed row by row.

Rows get global numbers 0 to N-1 in an order that depends on their content only: by a
bucket of doc_id, size and CRC, so that a hot id is spread by its texts, then by these. A Feistel network over Z_a x Z_b, with
a = ceil(sqrt N) and b = ceil(N / a), permutes the numbers; a value of N or more is put
through it again until it falls below N (cycle walking). Shard and slot are remainder and
quotient of the permuted number, so shards differ by one row at most and slots have no gaps:
the law is `rows`. The inverse needs no table either: the row at a shard's slot has the
permuted number slot * shards + shard.

Equal texts form groups under other laws; under `rows` they stay single rows, as a group
larger than a shard could not be kept whole. `grown_shard` belongs to the law `key` and is
null.

Rows: a null text has no bytes (size 16, CRC 0); a null doc_id is an id of its own that comes
first; rows equal in id, size and CRC are interchangeable and take neighbouring numbers,
counted before they move, so that a hot key stays small; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm.common import read

SHARDS = 40
#: Groups in which rows are numbered; also the most rows that are broadcast.
BUCKETS = 1 << 14
ROUNDS = 6
P = 2**31 - 1
KEYS = [(48271, 1013904223), (69621, 1664525), (16807, 374761393), (39373, 668265263), (40692, 1274126177), (40014, 2147483399)]
#: Walks that are tried. Up to N = 4096 a cycle can't leave [0, N) for so long, and above
#: that the chance is below 64**-64.
WALKS = 64
#: Equal rows that are numbered from one array.
RUN = 4096


def bucket_of() -> Column:
    v = F.coalesce(F.col("doc_id"), F.lit(0)) % P
    mixed = ((v + P) % P * 48271 + F.col("size") % P * 16807 + F.col("text_crc32")) % P
    return (mixed * 69621 % P % BUCKETS).cast("int")


def _mix(v: str, k: int) -> str:
    m, c = KEYS[k]
    y = f"(({v} * {m} + {c}) % {P})"
    return f"(({y} * {y} + {c % 65537}) % {P})"


def permuted(df: DataFrame, number: str, total: str, out: str) -> DataFrame:
    """Append the Feistel image of `number` in [0, total)."""
    d = df.withColumn("_a", F.expr(f"cast(ceil(sqrt({total})) as bigint)")).withColumn("_b", F.expr(f"({total} + _a - 1) div _a"))
    d = d.withColumn("_l", F.expr(f"{number} % _a")).withColumn("_r", F.expr(f"{number} div _a"))
    for k in range(ROUNDS):
        half, other, size = ("_l", "_r", "_a") if k % 2 == 0 else ("_r", "_l", "_b")
        d = d.withColumn(half, F.expr(f"({half} + {_mix(other, k)}) % {size}"))
    steps = "named_struct('l', v % _a, 'r', v div _a)"
    for k in range(ROUNDS):
        step = f"named_struct('l', (s.l + {_mix('s.r', k)}) % _a, 'r', s.r)" if k % 2 == 0 else f"named_struct('l', s.l, 'r', (s.r + {_mix('s.l', k)}) % _b)"
        steps = f"transform(array({steps}), s -> {step})[0]"
    again = f"transform(array({steps}), s -> s.l + s.r * _a)[0]"
    first = "_l + _r * _a"
    return d.withColumn(out, F.expr(first)).withColumn(out, F.expr(f"CASE WHEN {out} < {total} THEN {out} ELSE aggregate(sequence(1, {WALKS}), {out}, (v, i) -> CASE WHEN v < {total} THEN v ELSE {again} END) END")).drop("_a", "_b", "_l", "_r")


def numbered(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, the carried columns, `row_no` and `total`.

    Only rows that are equal in all of these are grouped. The shuffle carries these columns
    and no text, unless text is carried.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"), *carry)
    keys = ["doc_id", "size", "text_crc32", *carry]
    groups = rows.groupBy(*keys).count().withColumn("_bucket", bucket_of())
    up_to = Window.partitionBy("_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_in", F.coalesce(F.sum("count").over(up_to), F.lit(0)))
    sizes = rows.select(bucket_of().alias("_bucket")).groupBy("_bucket").count()
    whole = Window.partitionBy()
    offsets = sizes.select("_bucket", F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("count").over(whole).alias("total"))
    placed = groups.join(F.broadcast(offsets), "_bucket")
    runs = placed.withColumn("_run", F.explode(F.expr(f"sequence(0, (count - 1) div {RUN})")))
    single = runs.withColumn("_j", F.explode(F.expr(f"sequence(_run * {RUN}, least(_run * {RUN} + {RUN - 1}, count - 1))")))
    return single.select(*keys, (F.col("_before") + F.col("_in") + F.col("_j")).alias("row_no"), "total")


def shards(docs: DataFrame, n_shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """numbered() with `shard` and `slot`."""
    p = permuted(numbered(docs, carry), "row_no", "total", "_p")
    return p.withColumn("shard", (F.col("_p") % n_shards).cast("int")).withColumn("slot", F.expr(f"_p div {n_shards}")).drop("_p")


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """The rows of id and text as one folder for each shard, in slot order."""
    d = shards(docs, n_shards, carry=("text",))
    d.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").drop("row_no", "total").write.partitionBy("shard").mode("overwrite").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


def _feistel(source: str, value: str, keep: str) -> str:
    """SQL for the Feistel image `v` of a value of a table that has a and b."""
    out = f"SELECT {keep}, total, a, b, {value} % a AS l, {value} // a AS r FROM {source}"
    for k in range(ROUNDS):
        half, other, size = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        m, c = KEYS[k]
        mixed = f"((({other} * {m} + {c}) % {P}) * (({other} * {m} + {c}) % {P}) + {c % 65537}) % {P}"
        out = f"SELECT * REPLACE (({half} + {mixed}) % {size} AS {half}) FROM ({out})"
    return f"SELECT {keep}, total, a, b, l + r * a AS v FROM ({out})"


def oracle() -> str:
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    byte = "('0x' || substr(bytes, 2 * i - 1, 2))::BIGINT"
    return f"""WITH RECURSIVE t AS (SELECT {table}::BIGINT[] AS t),
given AS (SELECT doc_id, hex(coalesce(text, '')) AS bytes FROM documents),
sized AS (SELECT doc_id, (length(bytes) // 2 + 16)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(bytes) // 2 + 1), lambda i: {byte})),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS crc FROM given, t),
grouped AS (SELECT *, ((coalesce(doc_id, 0) % {P} + {P}) % {P} * 48271 + size % {P} * 16807 + crc) % {P} * 69621 % {P} % {BUCKETS} AS bucket FROM sized),
numbered AS (SELECT doc_id, size, crc, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, crc) - 1 AS row_no, count(*) OVER () AS total FROM grouped),
shaped AS (SELECT row_no, total, ceil(sqrt(total))::BIGINT AS a, (total + ceil(sqrt(total))::BIGINT - 1) // ceil(sqrt(total))::BIGINT AS b FROM numbered),
walk AS ({_feistel("shaped", "row_no", "row_no")} UNION ALL ({_feistel("(SELECT * FROM walk WHERE v >= total)", "v", "row_no")}))
SELECT n.doc_id, n.size, n.crc AS text_crc32, 'rows' AS law, (v % {SHARDS})::INT AS shard, v // {SHARDS} AS slot, NULL::INT AS grown_shard, n.row_no
FROM numbered n JOIN walk w ON w.row_no = n.row_no AND w.v < w.total"""
