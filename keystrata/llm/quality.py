"""Quality rules: base counts of every document, and a likelihood ratio between trusted
text and the raw corpus. DataFrame expressions only.

The ratio. The n-grams of a document are its words, its pairs and its triples of words, each
hashed to one of DIMENSIONS buckets. The raw multinomial counts the n-grams of every
document; the target multinomial those of trusted ones, all that are labelled good and not
toxic, of which one half, by a hash of the id, teaches. A document's score is the sum of
log(target / raw) over its n-grams, divided by their number; logarithms are in whole 1/SCALE
of a nat, so that sums are exact. The other half of the trusted documents, which the target
has not seen, sets the threshold: as far below its LOW quantile as that lies below its
median, both exact. So a corpus of any size, with as many trusted documents as it has, keeps
what looks like them; the same rows give the same verdicts, one by one.

Repeated windows. The hashes of a document's 3-word windows are sorted with their positions
packed below them (a document of n words spends log2 n of the 64 bits on positions). What
equals a neighbour is compared by its words; a document in which two different windows have
one hash is sorted by the windows' words instead. That is exact, and takes n log n steps.

Rows: a null, empty or blank text has no words, all counts 0, and fails the base rule; where
no document is trusted, all scores are 0 and the base rule alone decides. Repeated rows are
judged alike, null ids are no one's label, an empty table gives an empty one. Extra columns
stay in `judged`, but those with the name of a result, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import Cut, read

DIMENSIONS = 1 << 14
SCALE = 4096
LOW = 0.01
#: So many scores are sorted by the driver; of more a histogram of BINS tells where to look.
FEW, BINS = 10_000, 4096
#: Ids of trusted documents that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
MIN_WORDS = 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def words_of(text: str) -> Column:
    """array<string>, empty for a text without a word."""
    t = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[ \t-\r]+"))


def _trusted(labels: DataFrame) -> DataFrame:
    """doc_id and teaches, of all trusted documents."""
    good = labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).filter("good AND doc_id IS NOT NULL")
    return good.select("doc_id", (F.xxhash64(F.lit(7), "doc_id") % 2 == 0).alias("teaches"))


def known(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, text and teaches of the trusted documents. Ids are broadcast up to a checked
    number; for more of them the texts move to them once, and those met are written."""
    cut = Cut(docs.sparkSession)
    trusted = cut(trusted)
    few = trusted.count() <= MOST_BROADCAST
    met = docs.select("doc_id", "text").join(F.broadcast(trusted) if few else trusted.hint("merge"), "doc_id").select("doc_id", "text", "teaches")
    return met if few else Cut(docs.sparkSession)(met)


def _buckets(docs: DataFrame) -> dict[int, int]:
    """How many n-grams of all texts fall in each bucket. Collects DIMENSIONS rows at most."""
    d = docs.select(words_of("text").alias("words"))
    rows = d.selectExpr("words AS a", "slice(words, 2, size(words)) AS b", "slice(words, 3, size(words)) AS c").select(F.inline(F.arrays_zip("a", "b", "c")))
    # as far as the text goes: no pair begins at the last word, and no triple at the last two
    hashes = rows.selectExpr("xxhash64(a) AS x", "CASE WHEN b IS NOT NULL THEN xxhash64(b) END AS y", "CASE WHEN c IS NOT NULL THEN xxhash64(c) END AS z")
    grams = hashes.selectExpr("explode(array(x, CASE WHEN y IS NOT NULL THEN xxhash64(x, y) END, CASE WHEN z IS NOT NULL THEN xxhash64(x, y, z) END)) AS h").filter("h IS NOT NULL")
    return dict(grams.selectExpr(f"cast(h & {DIMENSIONS - 1} AS int) AS bucket").groupBy("bucket").count().collect())


def weights(docs: DataFrame, teaching: DataFrame) -> list[int]:
    """The log ratio of each bucket, of all documents and all that teach."""
    out = [0] * DIMENSIONS
    of_target = _buckets(teaching)
    if of_target:
        of_raw = _buckets(docs)
        base = math.log((sum(of_raw.values()) + 0.5 * DIMENSIONS) / (sum(of_target.values()) + 0.5 * DIMENSIONS))
        for b, n in of_raw.items():
            out[b] = round(SCALE * (math.log((of_target.get(b, 0) + 0.5) / (n + 0.5)) + base))
    return out


def _repeats(d: DataFrame) -> DataFrame:
    """Add n_repeat_words to words, n_words and win, the hashes of the 3-word windows."""
    d = d.withColumn("bits", F.length(F.bin("n_words")))
    # most texts have no two windows of one hash, and are done
    d = d.withColumn("packed", F.expr("CASE WHEN size(array_distinct(win)) = size(win) THEN cast(array() AS array<bigint>) ELSE sort_array(transform(win, (x, i) -> (x & shiftleft(-1L, bits)) | i)) END"))
    # the places in packed of windows with the hash of the next one
    d = d.withColumn("again", F.expr("CASE WHEN size(packed) < 2 THEN cast(array() AS array<int>) ELSE filter(sequence(0, size(packed) - 2), i -> shiftrightunsigned(packed[i] ^ packed[i + 1], bits) = 0) END"))
    one, two = (f"cast(packed[{i}] & ~shiftleft(-1L, bits) AS int)" for i in ("i", "i + 1"))
    differ = " OR ".join(f"words[{one} + {k}] <> words[{two} + {k}]" for k in range(3))
    d = d.withColumn("mixed", F.expr(f"size(again) > 0 AND exists(again, i -> {differ})"))
    spelt = "sort_array(transform(win, (x, i) -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS w, i AS at)))"
    d = d.withColumn("spelt", F.expr(f"CASE WHEN mixed THEN {spelt} END"))
    of_spelt = "transform(filter(spelt, (x, i) -> x.w <=> get(spelt, i + 1).w OR x.w <=> get(spelt, i - 1).w), x -> x.at)"
    d = d.withColumn("places", F.expr(f"CASE WHEN size(again) = 0 THEN cast(array() AS array<int>) WHEN mixed THEN {of_spelt} ELSE flatten(transform(again, i -> array({one}, {two}))) END"))
    covered = "cast(size(array_distinct(flatten(transform(places, p -> array(p, p + 1, p + 2))))) AS bigint)"
    return d.withColumn("n_repeat_words", F.expr(f"CASE WHEN size(places) = 0 THEN 0L ELSE {covered} END"))


def counted(docs: DataFrame, table: Column | None = None) -> DataFrame:
    """r, the row of docs, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed; with a table of weights also total and n_grams."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), words_of("text").alias("words"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    d = d.withColumn("n_words", F.size("words").cast("bigint"))
    # a line has a word if something but spaces is in it
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    d = d.withColumn("hw", F.expr("transform(words, w -> xxhash64(w))"))
    d = d.withColumn("win", F.expr("CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>) ELSE transform(slice(hw, 1, cast(n_words AS int) - 2), (x, i) -> xxhash64(x, hw[i + 1], hw[i + 2])) END"))
    scored = []
    if table is not None:
        weight = lambda h: F.get(table, h.bitwiseAND(F.lit(DIMENSIONS - 1)).cast("int"))
        # of each word but the last the weights of it, its pair and its triple, if it has one
        each = F.transform(F.slice("hw", F.lit(1), F.greatest(F.size("hw") - 1, F.lit(0))), lambda x, i: weight(x) + weight(F.xxhash64(x, F.get("hw", i + 1))) + F.coalesce(weight(F.get("win", i)), F.lit(0)))
        total = F.aggregate(each, F.lit(0).cast("bigint"), lambda s, v: s + v) + F.coalesce(weight(F.get("hw", F.size("hw") - 1)), F.lit(0))
        scored = [total.alias("total"), (F.size("hw") + F.greatest(F.size("hw") - 1, F.lit(0)) + F.size("win")).cast("bigint").alias("n_grams")]
    return _repeats(d).select(
        "r",
        "n_words",
        F.length(F.translate("t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        *scored,
    )


def _score() -> Column:
    return F.when(F.col("n_grams") > 0, F.col("total") / (SCALE * F.col("n_grams"))).otherwise(F.lit(0.0))


def _ranked(scores: DataFrame, k: int) -> float:
    """The score of rank k, from 0: histograms of ever narrower ranges, until few are left or all are one."""
    n, low, high = scores.agg(F.count("*"), F.min("score"), F.max("score")).first()
    while n > FEW and low < high:
        bin_of = F.least(F.floor((F.col("score") - low) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        for r in sorted(scores.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()):
            if k < r.n:
                break
            k -= r.n
        n, low, high = r.n, r.low, r.high
        scores = scores.filter(F.col("score").between(low, high))
    return low if low == high else sorted(r.score for r in scores.collect())[k]


def quantile(scores: DataFrame, share: float) -> float:
    """Exact, between two ranks in proportion, as percentile has it, but with no buffer of
    all scores."""
    at = share * (scores.count() - 1)
    low, high = _ranked(scores, math.floor(at)), _ranked(scores, math.ceil(at))
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def threshold(unseen: DataFrame, table: Column) -> float:
    """By the trusted documents that did not teach and pass the base rules."""
    # no filter before the cut, which would be pushed below the counts
    seen = Cut(unseen.sparkSession)(counted(unseen, table).select(F.when(~F.col("base_failed"), _score()).alias("score"))).filter("score IS NOT NULL")
    if not seen.limit(1).count():
        return 0.0
    low, middle = quantile(seen, LOW), quantile(seen, 0.5)
    return low - (middle - low)


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """r, the rows of docs, and v, a struct of MADE."""
    trusted = known(docs, _trusted(labels))
    w = weights(docs, trusted.filter("teaches"))
    table = F.split(F.lit(",".join(map(str, w))), ",").cast("array<bigint>")
    least = threshold(trusted.filter("NOT teaches"), table) if any(w) else 0.0
    d = counted(docs, table).withColumn("score", _score()).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
    # a filter on the results is not to be pushed below them, where it would work out the
    # word arrays once for each of their elements; it does not pass a generator
    return d.select("r", F.explode(F.array(F.struct(*MADE))).alias("v"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, which has doc_id and text, with MADE: the counts, `score` and `kept`."""
    return _judged(docs, labels).select(*[F.col("r")[c].alias(c) for c in docs.columns if c not in MADE], "v.*")


def passed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, as they are."""
    return _judged(docs, labels).filter("v.kept").select("r.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir).select("doc_id", "text")
    return judged(docs, read(spark, sf_dir, "labels")).select("doc_id", *[c for c in MADE if c != "score"], "score")
