"""The quality rules against a plain-Python version of counts, ratio, threshold and verdict."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from keystrata.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def h_text(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode(), 42)


def h_longs(xs: list[int]) -> int:
    h = 42
    for x in xs:
        h = xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), h)
    return h


def grams(words: list[str]) -> list[int]:
    hs = [h_text(w) for w in words]
    return [h % quality.DIMENSIONS for h in hs] + [h_longs(hs[i : i + k]) % quality.DIMENSIONS for k in (2, 3) for i in range(len(hs) - k + 1)]


def repeats(words: list[str]) -> int:
    wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(wins)
    return len({p for k, s in enumerate(wins) if n[s] > 1 for p in (k, k + 1, k + 2)})


def brute(docs: list[tuple], good: set[int]) -> list[tuple]:
    """(id, score, kept) of (id, text)."""
    words = [WORD.findall(t or "") for _, t in docs]
    failed = [len(w) < 50 or 100 * repeats(w) > 50 * len(w) for w in words]
    # the rows of F.xxhash64(7, doc_id): an int and a bigint
    teaches = lambda i: signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42))) % 2 == 0
    raw, target = Counter(), Counter()
    for (i, _), w in zip(docs, words, strict=True):
        g = grams(w)
        raw.update(g)
        if i in good and teaches(i):
            target.update(g)
    table = {}
    if target:
        base = math.log((raw.total() + 0.5 * quality.DIMENSIONS) / (target.total() + 0.5 * quality.DIMENSIONS))
        table = {b: round(quality.SCALE * (math.log((target[b] + 0.5) / (n + 0.5)) + base)) for b, n in raw.items()}
    scores = [sum(table.get(b, 0) for b in grams(w)) / (quality.SCALE * max(1, len(grams(w)))) for w in words]
    unseen = [s for (i, _), s, f in zip(docs, scores, failed, strict=True) if i in good and not teaches(i) and not f]
    low, middle = np.percentile(unseen, [1, 50]) if unseen and target else (0.0, 0.0)
    return [(i, round(s, 9), not f and s >= 2 * low - middle) for (i, _), s, f in zip(docs, scores, failed, strict=True)]


def test_verdicts(spark):
    import random

    r = random.Random(11)
    common = [f"w{k}" for k in range(40)]
    say = lambda n: " ".join(r.choice(common) if r.random() < 0.7 else f"x{r.randrange(10**6)}" for _ in range(n))
    docs = [(i, say(r.randrange(40, 200))) for i in range(60)]
    docs += [(100 + i, " ".join(f"{r.choice(common)}!!" for _ in range(120))) for i in range(10)] + [(200, None), (201, ""), (None, say(80)), (3, say(90)), (7, docs[7][1])]
    labels = [(i, 1, 0) for i in range(40)] + [(5, 0, 0), (6, 1, 1), (None, 1, 0), (100, 0, 0), (10, 1, 0)]
    good = set(range(40)) - {5, 6}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    out = quality.judged(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).select("doc_id", "score", "kept").collect()
    want = brute(docs, good)
    assert Counter((x.doc_id, round(x.score, 9), x.kept) for x in out) == Counter(want)
    kept = {i for i, _, k in want if k}
    assert len(kept & set(range(60))) > 40 and not kept & set(range(100, 110))


def test_nobody_is_trusted(spark):
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, "short")], "doc_id bigint, text string")
    out = {x.doc_id: (x.score, x.kept) for x in quality.judged(d, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()}
    assert out == {1: (0.0, True), 2: (0.0, False)}


def test_windows_with_one_hash_are_told_apart(spark):
    rows = [(1, "a b c d a b c"), (2, "a b c d e f g"), (3, "a a a a a a a"), (4, "a b"), (5, "x y z x y z x y z q r s")]
    d = spark.createDataFrame(rows, "id int, text string").withColumn("words", quality.words_of("text")).withColumn("n_words", F.size("words").cast("bigint"))
    same = d.withColumn("win", F.expr("CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(1, cast(n_words AS int) - 2), x -> -1L) END"))
    out = quality._repeats(same).select("id", "n_repeat_words", "mixed").collect()
    assert {x.id: x.n_repeat_words for x in out} == {i: repeats(t.split()) for i, t in rows}
    assert {x.id for x in out if x.mixed} == {1, 2, 5}


def test_columns_with_names_of_the_inside_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, text, "mine", "en", 3, 4, 5)], "doc_id bigint, text string, t string, bits string, words int, r int, kept int")
    x = quality.judged(d, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")).first()
    assert (x.text, x.t, x.bits, x.words, x.r, x.kept, x.n_words) == (text, "mine", "en", 3, 4, True, 60)


def test_all_trusted_documents_count(spark):
    n = 25_000
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    t = quality._trusted(labels)
    assert t.count() == n and 0.49 * n < t.filter("teaches").count() < 0.51 * n


def test_quantiles_are_exact(spark, monkeypatch):
    import random

    monkeypatch.setattr(quality, "FEW", 20)
    monkeypatch.setattr(quality, "BINS", 4)
    r = random.Random(2)
    for xs in ([r.gauss(0, 1) for _ in range(501)] + [0.25] * 60, [1.5] * 90, [0.0] * 50 + [1e9] * 50, [3.0, 1.0], [2.0]):
        d = spark.createDataFrame([(x,) for x in xs], "score double").repartition(3)
        for share in (0.01, 0.5):
            assert math.isclose(quality.quantile(d, share), np.percentile(xs, 100 * share), rel_tol=1e-12)


def test_trusted_documents_beyond_a_broadcast(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"w{i % 7} " * (50 + i)) for i in range(80)] + [(None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    want = quality.judged(d, labels).collect()
    monkeypatch.setattr(quality, "MOST_BROADCAST", 10)
    teaching = quality.known(d, quality._trusted(labels))
    assert teaching.count() == 60
    assert Counter(quality.judged(d, labels).collect()) == Counter(want)
