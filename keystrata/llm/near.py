"""Near duplicates by SimHash at a similarity of 0.8, one document of each group staying.

The set of a text's 5-word shingles (ASCII lower case) gives a fingerprint of segments x
width bits. Sets of Jaccard similarity 0.8 differ in 15 % of the bits, and in one bit or
none of some segment with probability 0.95; 0.9 and more are practically always found. So a
fingerprint is entered in a table under each segment's value and asks for the ball of one
bit around each; what it meets within `radius` of all bits, 3.3 standard deviations more than
those 15 %, is verified by the shingle sets themselves: only pairs of Jaccard similarity 0.8
or more are links. The first segments, as one number, go with each entry, so that what meets
by chance is told by these bits, with the same margin, before it moves. The width is log2 of the number of
documents and two bits more, so that chance meetings of a fingerprint stay as many whatever
the size, and the segments are as many as that probability takes (see `shape`).

Copies of one text, however many, don't make all their pairs. First each fingerprint is
compared only with the least one that has a segment's value with it and lies within the
radius; what is verified of that makes components, and the search for pairs keeps those
alone whose ends are in two of them. A pair inside a component would connect nothing.

A value that more than CROWD fingerprints share, as those of documents with one passage, is
joined whole as well: its holders and those who ask for it are cut into blocks of BLOCK, and
every block of one meets every block of the other. No pair is lost; the work grows with the
square of a crowd, at some nanoseconds a pair and segment, and only pairs of two components
within the radius leave a block. The largest component of a crowd, such as a family of
copies, asks for nothing there: each pair has an end outside of it, and that one asks.

The sets that are compared hold 32 bits of each shingle's hash: of two texts of n shingles n
* n / 2^32 agree by chance, a ten-thousandth of a percent of 4000. Where pairs are still many
more than texts, each text is verified against the least one that it met, and pairs that are
connected by then are left out; links only have to connect a group. All others are verified.

Rows: texts without words have one fingerprint of their own and are copies of each other; a
shorter text than a shingle is one shingle. Each row is decided by itself, whatever rows
share its id: of a group the row with the smallest id stays, null after all others, then by
hash of the text and of the row; of wholly equal rows one does. Extra columns stay, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrata.llm.common import BROADCAST_KEYS, U64, Cut, hashable, mix, pieces, texts
from keystrata.llm.graph import components

SHINGLE = 5
#: The share of bits in which sets of similarity 0.8 differ, and that of such pairs to be met.
APART, MET = 0.15, 0.95
#: Bits of a segment.
LEAST_WIDTH, MOST_WIDTH = 20, 30
#: Linked fingerprints differ in so many standard deviations more than APART at most.
DEVIATIONS = 3.3
CROWD = 64
BLOCK = 2048
#: With more pairs a text than MANY, up to ROUNDS rounds of one pair a text go first.
MANY, ROUNDS = 16, 6
#: What tells rows apart: the id, and hashes of the text and of the whole row.
KEY = ["doc_id", "_text", "_row"]
POWERS = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(SHINGLE)]


class Shape(NamedTuple):
    segments: int = 16
    width: int = LEAST_WIDTH

    @property
    def bits(self) -> int:
        return self.segments * self.width

    @property
    def radius(self) -> int:
        """Bits in which linked fingerprints may differ."""
        return apart_at_most(self.bits)

    @property
    def ahead(self) -> int:
        """Segments that fit one number."""
        return min(self.segments, 63 // self.width)


def apart_at_most(bits: int) -> int:
    return math.ceil(APART * bits + DEVIATIONS * math.sqrt(APART * (1 - APART) * bits))


def head(form: Shape) -> Column:
    """The first segments as one number. Pairs are held against these before they move."""
    out = F.lit(0).cast("bigint")
    for i in range(form.ahead):
        out = out.bitwiseOR(F.shiftleft(F.get("segs", F.lit(i)).cast("bigint"), i * form.width))
    return out


def _alike(x: str, y: str, form: Shape) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= apart_at_most(form.ahead * form.width)


def shape(n: int) -> Shape:
    """The segments for up to n different fingerprints."""
    width = min(max(LEAST_WIDTH, math.ceil(math.log2(max(n, 1))) + 2), MOST_WIDTH)
    agree = (1 - APART) ** width + width * APART * (1 - APART) ** (width - 1)
    return Shape(math.ceil(math.log(1 - MET) / math.log(1 - agree)), width)


def shingles(data: bytes) -> np.ndarray:
    """The sorted hashes of a text's shingles, each once."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, U64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(U64)
    k = min(SHINGLE, len(h))
    s = np.zeros(len(h) - k + 1, U64)
    for i in range(k):
        s += h[i : len(h) - k + 1 + i] * U64(POWERS[i])
    return np.unique(mix(s + U64(k)))


def fingerprint(s: np.ndarray, form: Shape = Shape()) -> list[int]:
    """form.segments numbers of form.width bits each, of a set of shingles."""
    lanes = -(-form.bits // 64)
    count = np.zeros(lanes * 64, np.int64)
    for at in range(0, len(s), 1 << 14):
        part = s[at : at + (1 << 14)]
        wide = np.stack([mix(part + U64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) for j in range(lanes)], 1)
        count += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * count > len(s))[: form.bits].reshape(form)
    return (bits @ (1 << np.arange(form.width))).tolist()


def fingerprints(docs: DataFrame, form: Shape = Shape()) -> DataFrame:
    """KEY, node, the hash of the shingle set, and segs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                nodes, segs = [], []
                for t in texts(b.column("text")):
                    s = shingles(t)
                    nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                    segs.append(fingerprint(s, form))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in KEY], pa.array(nodes, pa.int64()), pa.array(segs, pa.list_(pa.int32()))], names=[*KEY, "node", "segs"])

    given = docs.select(*KEY, "text")
    return given.mapInArrow(run, T.StructType([*given.schema.fields[:-1], T.StructField("node", T.LongType()), T.StructField("segs", T.ArrayType(T.IntegerType()))]))


def _key(segment: Column, value: Column) -> Column:
    return segment.cast("bigint") * (1 << 32) + value


def _met(form: Shape):
    """Of the askers and the holders of a block: the pairs within the radius, each under the
    first segment in which they differ by one bit at most."""

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        def segs(x: pa.Table) -> np.ndarray:
            return x.column("segs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.uint32).reshape(-1, form.segments)

        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if asking.num_rows and held.num_rows:
            x, y, segment = segs(asking), segs(held), asking.column("key")[0].as_py() >> 32
            of_x, of_y = asking.column("comp").to_numpy(), held.column("comp").to_numpy()
            a, b = asking.column("node").to_numpy(), held.column("node").to_numpy()
            for at in range(0, len(a), 64):
                apart = np.bitwise_count(x[at : at + 64, None] ^ y[None])
                near = apart.sum(axis=2, dtype=np.int64) <= form.radius
                near &= (apart <= 1).argmax(axis=2) == segment
                near &= of_x[at : at + 64, None] != of_y[None]
                i, j = np.nonzero(near)
                low.append(np.minimum(a[at + i], b[j]))
                high.append(np.maximum(a[at + i], b[j]))
        return pa.table({"a": np.concatenate(low), "b": np.concatenate(high)})

    return run


def hubs(nodes: DataFrame, form: Shape = Shape()) -> DataFrame:
    """(a, b): each node b with the least node that has a segment's value with it, a < b."""
    entered = nodes.select("node", head(form).alias("head"), F.posexplode("segs").alias("i", "value")).select(_key(F.col("i"), F.col("value")).alias("key"), "node", "head")
    least = entered.groupBy("key").agg(F.min(F.struct("node", "head")).alias("x"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("x.node").alias("a"), F.col("x.head").alias("of_a"))
    return entered.join(least, "key").filter((F.col("a") != F.col("node")) & _alike("head", "of_a", form)).select("a", F.col("node").alias("b")).distinct()


def close(pairs: DataFrame, nodes: DataFrame, form: Shape) -> DataFrame:
    """The pairs within the radius."""
    one = nodes.select(F.col("node").alias("a"), F.col("segs").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("segs").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    return pairs.join(one, "a").join(two, "b").filter(apart <= form.radius).select("a", "b")


def candidates(nodes: DataFrame, form: Shape = Shape()) -> DataFrame:
    """(a, b), a < b: distinct pairs of nodes of two components that have a segment in which
    they differ by one bit at most. nodes: node, comp, segs."""
    table = nodes.select("node", "comp", head(form).alias("head"), F.posexplode("segs").alias("i", "value"))
    entered = table.select(_key(F.col("i"), F.col("value")).alias("key"), F.col("node").alias("other"), F.col("comp").alias("of_other"), F.col("head").alias("ahead"))
    flips = F.array(F.lit(0), *[F.lit(1 << k) for k in range(form.width)])
    asked = table.select("node", "comp", "head", "i", "value", F.explode(F.filter(flips, lambda x: x.bitwiseAND(F.col("value")) == 0)).alias("flip"))
    asked = asked.select(_key(F.col("i"), F.col("value").bitwiseOR(F.col("flip"))).alias("key"), "node", "comp", "head")
    full = Cut(nodes.sparkSession)(entered.groupBy("key").agg(F.count("*").alias("holders")).filter(F.col("holders") > CROWD))
    n = full.count()
    small = lambda d: F.broadcast(d) if n <= BROADCAST_KEYS else d
    light = entered.join(small(full), "key", "left_anti") if n else entered
    # by sorting: the asks are many more than the files they come from tell
    met = asked.join(light.hint("merge"), "key").filter((F.col("comp") != F.col("of_other")) & _alike("head", "ahead", form)).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    if not n:
        return met
    # of each crowd its largest component; any one would do
    shares = entered.join(small(full), "key").groupBy("key", "holders", "of_other").count()
    crowded = small(Cut(nodes.sparkSession)(shares.groupBy("key", "holders").agg(F.max_by("of_other", "count").alias("main"))))
    # of a pair that a crowd has part in, one end is not of its main component: as the one
    # who asks, or as a holder, which then asks by the other bits, those that it has
    outside = asked.join(crowded, "key").filter(F.col("comp") != F.col("main")).select("key", "node", "comp", "holders")
    few = entered.join(crowded, "key").filter(F.col("of_other") != F.col("main")).select("key", F.col("other").alias("node"), F.col("of_other").alias("comp"))
    back = few.select("node", "comp", F.shiftright("key", 32).alias("i"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("value"))
    back = back.withColumn("flip", F.explode(F.filter(F.transform(flips, lambda x: x.cast("bigint")), lambda x: x.bitwiseAND(F.col("value")) != 0)))
    back = back.select(_key(F.col("i"), F.col("value").bitwiseXOR(F.col("flip"))).alias("key"), "node", "comp")
    sizes = entered.join(back.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("holders"))
    asking = Cut(nodes.sparkSession)(outside.unionByName(back.join(sizes, "key").select("key", "node", "comp", "holders")).distinct())
    grid = asking.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("rows"), F.ceil(F.first("holders") / BLOCK).alias("columns"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    asking = asking.join(grid, "key").select("key", "node", "comp", mine("rows").alias("r"), every("columns").alias("c")).join(nodes.select("node", "segs"), "node")
    held = entered.select("key", F.col("other").alias("node"), F.col("of_other").alias("comp")).join(grid, "key").select("key", "node", "comp", every("rows").alias("r"), mine("columns").alias("c")).join(nodes.select("node", "segs"), "node")
    heavy = asking.groupBy("key", "r", "c").cogroup(held.groupBy("key", "r", "c")).applyInArrow(_met(form), "a bigint, b bigint")
    return met.unionByName(heavy).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """row, all columns of docs, and KEY; maps and variants have no hash and don't count."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in hashable(docs.schema)]).alias("_row"))


def shingle_sets(texts_of: DataFrame) -> DataFrame:
    """node and shingles, 32 bits of each, of the table of node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                sets = [np.unique((shingles(t) >> U64(32)).astype(np.uint32)).view(np.int32) for t in texts(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return texts_of.select("node", "text").mapInArrow(run, T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.IntegerType(), False))]))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have four fifths or more of their union in common."""
    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").filter(9 * common >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def links(pairs: DataFrame, sets: DataFrame, many: int) -> DataFrame:
    """(u, v): similar pairs enough to connect all that similar pairs connect."""
    cut, kept, edges = Cut(pairs.sparkSession), Cut(pairs.sparkSession), None
    for _ in range(ROUNDS):
        if pairs.count() <= many:
            break
        star = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        found = similar(star, sets)
        edges = kept(found if edges is None else edges.unionByName(found))
        roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        left = pairs.join(star, ["a", "b"], "left_anti")
        for c in "ab":
            left = left.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
        pairs = cut(left.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    found = similar(pairs, sets)
    return (found if edges is None else edges.unionByName(found)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _placed(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KEY, node and root of each keyed row; and of each root the least row, `best`."""
    docs = keyed.select(*KEY, F.col("row")["text"].alias("text"))
    spark = docs.sparkSession
    form = shape(docs.count())
    fps = Cut(spark)(fingerprints(docs, form))
    least = F.struct(F.col("doc_id").isNull().alias("none"), *KEY)
    nodes = Cut(spark)(fps.groupBy("node").agg(F.first("segs").alias("segs"), F.min(least).alias("least")))

    def sets_of(some: DataFrame) -> DataFrame:
        """The shingles of the nodes of a table. Texts only move for more of them than are
        broadcast, a few bytes each."""
        named = Cut(spark)(nodes.join(some, "node", "left_semi").select("node", *[F.col("least")[c].alias(f"k_{c}") for c in KEY]))
        named = F.broadcast(named) if named.count() <= BROADCAST_KEYS else named
        of_node = docs.join(named, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in KEY]).groupBy("node").agg(F.first("text").alias("text"))
        return Cut(spark)(shingle_sets(of_node))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    star = Cut(spark)(close(hubs(nodes, form), nodes, form).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    sets = sets_of(ends(star))
    first = Cut(spark)(similar(star, sets).select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = Cut(spark)(nodes.select("node", "segs").join(components(first), "node", "left").select("node", "segs", F.coalesce("root", "node").alias("comp")))
    pairs = Cut(spark)(close(candidates(labelled, form), nodes, form))
    sets = sets.unionByName(sets_of(ends(pairs).join(sets.select("node"), "node", "left_anti")))
    roots = components(first.unionByName(links(pairs, sets, MANY * nodes.count())))
    placed = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min("least").alias("best"))
    return fps.select(*KEY, "node").join(placed.select("node", "root"), "node"), best


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest id of its group."""
    rows, best = _placed(_keyed(docs.select("doc_id", "text")))
    return rows.join(best, "root").select("doc_id", F.col("best.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The least row of each group, all columns."""
    keyed = _keyed(docs)
    rows, best = _placed(keyed)
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("root").alias("root")).join(best, "root")
    stays = F.lit(True)
    for c in KEY:
        stays = stays & F.col(c).eqNullSafe(F.col("best")[c])
    # keys that go, and those of which one row stays
    decided = Cut(docs.sparkSession)(keys.withColumn("stays", stays).filter("NOT stays OR n > 1").select(*[F.col(c).alias(f"k_{c}") for c in KEY], "stays"))
    on = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in KEY]
    # the rows with their texts only move for more keys than are broadcast
    small = F.broadcast if decided.count() <= BROADCAST_KEYS else lambda d: d
    out = keyed.join(small(decided), on, "left_anti")
    if decided.filter("stays").limit(1).count():
        out = out.unionByName(keyed.join(small(decided.filter("stays")), on, "left_semi").dropDuplicates(KEY))
    return out.select("row.*")
